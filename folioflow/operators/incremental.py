"""Processing only new or changed records, with failures neither skipping nor repeating any.

:func:`embedding_run` is one run. Its sources are read above the watermark of the last commit and up to limits fixed when the run
starts, and merged with the state that commit left: a row per chunk, with the hash of its current text and what covers it. The
records that are due, processed, the new state and the new watermark become visible with one rename (:class:`CommitLog`).
:func:`pending` says the same of whole tables without a log.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.commits import CommitLog
from folioflow.functions.text import content_hash
from folioflow.operators.current import current_rows

SUCCESSFUL = ("completed", "partial")


def holding_entries(checkpoint: DataFrame, runs: DataFrame, successful: tuple[str, ...] = SUCCESSFUL) -> DataFrame:
    """Of each chunk the entry of a successful run with the greatest ``embedded_at``; NULL and NaN rank lowest."""
    good = runs.where(F.col("status").isin(*successful)).select(F.col("run_id").alias("_run"))
    at = F.when(~F.isnan("embedded_at"), F.col("embedded_at"))
    counting = checkpoint.join(good, checkpoint["run_id"] == good["_run"], "left_semi").withColumn("_at", at)
    columns = {"held_hash": F.lower("content_hash"), "held_version": F.col("model_version"), "held_at": F.col("_at"), "held": F.lit(True)}
    return current_rows(counting, "chunk_id", "_at", columns)


def pending(chunks: DataFrame, checkpoint: DataFrame, runs: DataFrame, documents: DataFrame, started_at: str) -> DataFrame:
    """``chunk_id``, ``doc_id``, ``content_hash``, ``embedding_model_version``, ``reason`` of the chunks a run must process.

    ``reason`` is ``new``, ``changed`` (another text) or ``version``. The hash is computed from the current text. A chunk
    whose document was ingested after ``started_at`` belongs to the next run; one whose document is unknown, or has no
    ingestion time, to this one. NULL texts are never processed; a NULL hash or version equals only another NULL. Replays
    and repeated entries change nothing; an empty checkpoint leaves every chunk pending.
    """
    fields = {"hash": content_hash(F.col("text_for_embedding")), "version": F.col("embedding_model_version"), "doc": F.col("doc_id")}
    current = current_rows(chunks, "chunk_id", "updated_at", fields).where(F.col("hash").isNotNull())
    later = documents.where(F.col("last_ingested_at") > F.to_timestamp(F.lit(started_at))).select(F.col("doc_key").alias("_later"))
    both = current.join(holding_entries(checkpoint, runs), "chunk_id", "left")
    reason = (
        F.when(F.col("held").isNull(), "new")
        .when(~F.col("hash").eqNullSafe(F.col("held_hash")), "changed")
        .when(~F.col("version").eqNullSafe(F.col("held_version")), "version")
    )
    due = both.withColumn("reason", reason).where(F.col("reason").isNotNull())
    due = due.join(later, due["doc"] == later["_later"], "left_anti")
    return due.select("chunk_id", F.col("doc").alias("doc_id"), F.col("hash").alias("content_hash"), F.col("version").alias("embedding_model_version"), "reason")


STATE = "chunk_id string, at long, hash string, version string, doc string, held_at double, held_hash string, held_version string"


def _above(column: str, lower: int | None, upper: int | None) -> Column:
    """Rows of a commit sequence, a timestamp, in (lower, upper] microseconds; those without a number are read by every run."""
    time = lambda us: F.timestamp_micros(F.lit(us))
    inside = F.lit(True) if upper is None else F.col(column) <= time(upper)
    inside = inside if lower is None else inside & (F.col(column) > time(lower))
    return F.col(column).isNull() | inside


def _newest(df: DataFrame, column: str, lower: int | None) -> int | None:
    """The limit of a run: the greatest number there is at its start, or the watermark if nothing is above it."""
    above = df.where(F.col(column).isNotNull() & _above(column, lower, None))
    top = above.agg(F.unix_micros(F.max(F.col(column).cast("timestamp")))).first()[0]
    return lower if top is None else top


def _covers(state: DataFrame) -> Column:
    """Why a chunk is due: ``new``, ``changed`` or ``version``; NULL if its text is NULL, or covered."""
    return F.when(F.col("hash").isNull(), None).otherwise(
        F.when(F.col("held_at").isNull(), "new").when(~F.col("hash").eqNullSafe(F.col("held_hash")), "changed").when(~F.col("version").eqNullSafe(F.col("held_version")), "version")
    )


def embedding_run(
    log: CommitLog, chunks: DataFrame, checkpoint: DataFrame, runs: DataFrame, documents: DataFrame, started_at: str, process: Callable[[DataFrame], DataFrame] = lambda due: due
) -> dict:
    """One run over what came since the last commit; the commit's ``output`` is ``process`` of the due records, once each.

    Commit sequences: of chunk versions ``updated_at``, of checkpoint entries the ``completed_at`` of their run, which an entry doesn't
    count before. Rows without one can't be placed and are merged by every run, which changes nothing the second time. Limits: the
    greatest numbers at the start; ``started_at`` for the documents' ``last_ingested_at``: chunks of documents ingested later stay in the state
    and are due in a following run. What a commit hands to ``process`` counts as covered from then on. Due records: ``chunk_id``, ``doc_id``,
    ``content_hash``, ``embedding_model_version``, ``reason``, as of :func:`pending`; NULLs, replays and empty tables as there. A run
    that dies before its commit leaves the state as it was. With nothing new there is no commit, and the last one is returned.
    """
    done = log.last()
    low = done["upper"] if done else {"chunks": None, "runs": None, "started_at": None}
    good = runs.where(F.col("status").isin(*SUCCESSFUL))
    up = {"chunks": _newest(chunks, "updated_at", low["chunks"]), "runs": _newest(good, "completed_at", low["runs"]), "started_at": started_at}
    if done and up == low:
        return done
    fields = {"hash": content_hash(F.col("text_for_embedding")), "version": F.col("embedding_model_version"), "doc": F.col("doc_id"), "at": F.unix_micros(F.col("updated_at").cast("timestamp"))}
    fresh = current_rows(chunks.where(_above("updated_at", low["chunks"], up["chunks"])), "chunk_id", "updated_at", fields)
    held = holding_entries(checkpoint, good.where(_above("completed_at", low["runs"], up["runs"])))
    # A NULL or NaN time covers, but any other entry replaces it.
    held = held.withColumn("held_at", F.coalesce("held_at", F.lit(float("-inf")))).drop("held")
    merged = fresh.withColumn("seen", F.lit(True)).join(held, "chunk_id", "full")
    before = log.table("state")
    if before is None:
        before = log.spark.createDataFrame([], STATE)
    old = before.select("chunk_id", *[F.col(c).alias(f"old_{c}") for c in before.columns if c not in ("chunk_id", "reason")], F.lit(True).alias("old_seen"))
    both = merged.join(old, "chunk_id", "full")
    least = lambda c: F.coalesce(c, F.lit(-(2**63)))
    newer = F.col("seen").isNotNull() & (F.col("old_seen").isNull() | (least("at") >= least("old_at")))
    later_held = F.col("held_at").isNotNull() & (F.col("old_held_at").isNull() | (F.col("held_at") >= F.col("old_held_at")))
    pick = lambda cond, names: [F.when(cond, F.col(n)).otherwise(F.col(f"old_{n}")).alias(n) for n in names]
    state = both.select("chunk_id", *pick(newer, ["at", "hash", "version", "doc"]), *pick(later_held, ["held_at", "held_hash", "held_version"]))
    later = documents.where(F.col("last_ingested_at") > F.to_timestamp(F.lit(started_at))).select(F.col("doc_key").alias("doc"), F.lit(True).alias("later")).distinct()
    state = state.join(later, "doc", "left").withColumn("reason", F.when(F.col("later").isNull(), _covers(state)))
    due, now = F.col("reason").isNotNull(), F.lit(dt.datetime.fromisoformat(started_at).replace(tzinfo=dt.UTC).timestamp())
    taken = {"held_at": F.greatest("held_at", now), "held_hash": F.col("hash"), "held_version": F.col("version")}
    state = state.select("chunk_id", "at", "hash", "version", "doc", *[F.when(due, new).otherwise(F.col(n)).alias(n) for n, new in taken.items()], "reason")
    place = log.place()
    state.write.option("compression", "zstd").parquet(f"{place}/state")
    ready = log.spark.read.schema(STATE + ", reason string").parquet(f"{place}/state").where(due)
    output = process(ready.select("chunk_id", F.col("doc").alias("doc_id"), F.col("hash").alias("content_hash"), F.col("version").alias("embedding_model_version"), "reason"))
    output.write.option("compression", "zstd").parquet(f"{place}/output")
    return log._commit({"number": (done["number"] if done else 0) + 1, "lower": low, "upper": up, "tables": {"state": f"{place}/state", "output": f"{place}/output"}})
