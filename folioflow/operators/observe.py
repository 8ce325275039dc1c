"""Logs of runs and queries, and what is read from them."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflow.storage import filesystem, materialize

CHAT_LOG = "ts string, query string, answer string, sources array<string>, retrieval_ms double, generation_ms double, avg_chunk_score double"
QUERY_LOG = (
    "query_id string, user_id string, query_text string, embed_duration_seconds double, sql_duration_seconds double, rerank_duration_seconds double, "
    "total_duration_seconds double, cache_hit boolean, results_returned int, top_similarity double, candidates_considered int, embedding_model string, "
    "estimated_cost_usd double, error string, timestamp double"
)
RUN_LOG = "run_number long, timestamp string, chunks_processed long, chunks_skipped long, chunks_failed long, total_cost_usd double, total_duration_seconds double"
# Characters of an answer that the log keeps; the mean distance above which confidence is low.
KEPT, LOW_CONFIDENCE = 300, 0.5


def append_lines(spark: SparkSession, path: str, schema: str, rows: list[tuple]) -> None:
    """Rows as JSON lines in a new file of a table's folder, written in one piece and without a Spark job."""
    names = StructType.fromDDL(schema).names
    text = "".join(json.dumps(dict(zip(names, row)), ensure_ascii=False) + "\n" for row in rows)
    name = f"part-{time.time_ns()}-{uuid.uuid4().hex}.json"
    fs, hidden = filesystem(spark, f"{path.rstrip('/')}/.{name}")
    stream = fs.create(hidden, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.rename(hidden, filesystem(spark, f"{path.rstrip('/')}/{name}")[1])


class ChatLog:
    """Appends answered questions to a JSON-lines table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, query: str, answer: str, sources: list[str], retrieval_ms: float, generation_ms: float, score: float) -> None:
        row = (datetime.now(UTC).isoformat(), query, answer, sources, retrieval_ms, generation_ms, score)
        ts, query, answer, sources, retrieval_ms, generation_ms, score = row
        kept = (ts, query, answer[:KEPT] if answer is not None else None, sources, *(round(v, n) if v is not None else None for v, n in ((retrieval_ms, 1), (generation_ms, 1), (score, 3))))
        append_lines(self.spark, self.path, CHAT_LOG, [kept])

    def read(self) -> DataFrame:
        return self.spark.read.schema(CHAT_LOG).option("mode", "FAILFAST").json(self.path)


@dataclass
class QueryContext:
    """What is known of one query as it runs; a row of the query log at the end, also when it failed."""

    query_text: str
    user_id: str | None = None
    query_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    embed_duration_seconds: float = 0.0
    sql_duration_seconds: float = 0.0
    rerank_duration_seconds: float = 0.0
    total_duration_seconds: float = 0.0
    cache_hit: bool = False
    results_returned: int = 0
    top_similarity: float | None = None
    candidates_considered: int = 0
    embedding_model: str | None = None
    estimated_cost_usd: float = 0.0
    error: str | None = None
    timestamp: float = field(default_factory=time.time)

    def row(self) -> tuple:
        order = ("query_id", "user_id", "query_text", *list(self.__dataclass_fields__)[3:])
        return tuple(getattr(self, n) for n in order)


class QueryLog:
    """Appends queries, failed ones too, to a JSON-lines table; named metrics go to a table of their own beside it.

    ``every`` rows make a file; :meth:`flush`, or the end of a ``with`` block, writes what is held back.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 1):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every
        self._rows: list[tuple] = []

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.flush()

    def flush(self) -> None:
        rows, self._rows = self._rows, []
        if rows:
            append_lines(self.spark, self.path, QUERY_LOG, rows)

    @contextmanager
    def query(self, text: str, user_id: str | None = None):
        context, began = QueryContext(text, user_id), time.monotonic()
        try:
            yield context
        except Exception as error:
            context.error = f"{type(error).__name__}: {error}"
            raise
        finally:
            context.total_duration_seconds = time.monotonic() - began
            self._rows.append(context.row())
            if len(self._rows) >= self.every:
                self.flush()

    def metric(self, name: str, value: float) -> None:
        append_lines(self.spark, self.path + "_metrics", "name string, value double, timestamp double", [(name, float(value), time.time())])

    def read(self) -> DataFrame:
        return self.spark.read.schema(QUERY_LOG).option("mode", "FAILFAST").json(self.path)


def log_rows(answers: DataFrame) -> DataFrame:
    """Answers as they are logged: cut to 300 characters, times to 1 decimal, scores to 3."""
    return answers.withColumns(
        {
            "answer": F.substring("answer", 1, KEPT),
            "retrieval_ms": F.round("retrieval_ms", 1),
            "generation_ms": F.round("generation_ms", 1),
            "avg_chunk_score": F.round("avg_chunk_score", 3),
        }
    )


def session_statistics(log: DataFrame) -> DataFrame:
    """One row: queries, mean latency (0 without queries; a missing part counts 0), answers of low confidence."""
    latency = F.coalesce("retrieval_ms", F.lit(0.0)) + F.coalesce("generation_ms", F.lit(0.0))
    return log.agg(
        F.count("*").alias("total_queries"),
        F.coalesce(F.round(F.avg(latency), 1), F.lit(0.0)).alias("avg_latency_ms"),
        F.count_if(F.col("avg_chunk_score") > LOW_CONFIDENCE).alias("low_confidence_answers"),
    )


def nearest_rank(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row: the value at the 0-based place int(n * share) of the ascending order; NULLs don't count, nothing gives NULL.

    Values are split by range; the parts' sizes tell which part holds the place, and only that part is ranked.
    """
    parts = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v")).repartitionByRange("v").withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "ranks")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row per part
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(whole)
    place = F.least(F.floor(total * F.lit(share)), total - 1)
    held = sizes.withColumn("place", place - before).where((F.col("place") >= 0) & (F.col("place") < F.col("n"))).select("part", "place")
    ranked = parts.join(F.broadcast(held), "part").withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1)
    return ranked.where("rank = place").agg(F.max("v").alias("value"))


def slowest(log: DataFrame, duration: str, error: Column, k: int = 10) -> DataFrame:
    """The slowest queries that didn't fail."""
    return log.where(error.isNull()).orderBy(F.desc_nulls_last(duration), "query_id").limit(k)


def log_summary(log: DataFrame) -> DataFrame:
    """One row of a query log: queries, share of cache hits (0 without queries), total cost, failures."""
    return log.agg(
        F.count("*").alias("queries"),
        F.coalesce(F.round(F.avg(F.col("cache_hit").cast("int")), 6), F.lit(0.0)).alias("cache_hit_rate"),
        F.coalesce(F.round(F.sum("estimated_cost_usd"), 6), F.lit(0.0)).alias("total_cost_usd"),
        F.count_if(F.col("error").isNotNull()).alias("failures"),
    )


def estimated_cost(query: Column, cache_hit: Column, per_1k: float = 0.00013) -> Column:
    """Price of embedding a query by its characters; nothing on a cache hit."""
    return F.when(cache_hit, 0.0).otherwise(F.floor(F.length(query) / 4) / 1000 * per_1k)


def number_runs(runs: DataFrame, order: str) -> DataFrame:
    """Run numbers in order of time; a run table is small."""
    return runs.withColumn("run_number", F.row_number().over(Window.orderBy(order, "run_id")).cast("long"))


def append_run(spark: SparkSession, path: str, metrics: dict, at: str) -> dict:
    """Adds a run to a run log. Its number is the next free one: a file of that number is made, which only one of several runs can."""
    fs, where = filesystem(spark, path)
    number = 1 + max([int(s.getPath().getName()[:-5]) for s in (fs.listStatus(where) if fs.exists(where) else []) if s.getPath().getName()[:-5].isdigit()], default=0)
    row = {"run_number": number, "timestamp": at} | {k: metrics[k] for k in ("chunks_processed", "chunks_skipped", "chunks_failed")}
    row |= {"total_cost_usd": round(metrics["total_cost_usd"], 6), "total_duration_seconds": round(metrics["total_duration_seconds"], 2)}
    while True:
        _, mine = filesystem(spark, f"{path.rstrip('/')}/{row['run_number']}.json")
        try:
            stream = fs.create(mine, False)
        except Exception:
            if not fs.exists(mine):
                raise
            row["run_number"] += 1
            continue
        stream.write(bytearray((json.dumps(row) + "\n").encode()))
        stream.close()
        return row


def rates(metrics: DataFrame) -> DataFrame:
    """Adds tokens per chunk and chunks per second, 0 where nothing was done."""
    per_chunk = F.round(F.try_divide(F.col("total_tokens").cast("double"), F.col("chunks_processed")), 1)
    per_second = F.round(F.try_divide(F.col("chunks_processed").cast("double"), F.col("total_duration_seconds")), 1)
    return metrics.withColumn("avg_tokens_per_chunk", F.coalesce(per_chunk, F.lit(0.0))).withColumn("throughput_chunks_per_second", F.coalesce(per_second, F.lit(0.0)))
