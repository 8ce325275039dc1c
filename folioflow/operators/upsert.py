"""Keyed upserts into parquet tables, which know no MERGE: a full join decides per row and column.

The results are new versions of the tables; the writer swaps them in. Both sides are shuffled once, on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a repeated document changes; what a changed chunk changes; the metadata keys that become columns.
DOCUMENT_UPDATES = ("title", "source_path", "content_hash", "pipeline_version", "metadata")
CHUNK_UPDATES = ("embedding", "embedding_model", "embedding_model_version", "text_for_embedding", "content_hash", "section_path", "metadata", "run_id")
PROMOTED = ("doc_title", "doc_type", "source_system", "source_path", "content_hash", "page_count", "author", "publication_date", "effective_date", "expiry_date", "access_classification", "access_groups")
REQUIRED = ("chunk_id", "doc_id", "embedding", "embedding_model", "embedding_model_version", "text_for_embedding", "content_hash")
DEFAULT_GROUPS = "all_advisors"


def _sides(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    old = stored.select(F.col(key).alias("_key"), F.struct("*").alias("o"))
    new = incoming.select(F.col(key).alias("_key"), F.struct("*").alias("n"))
    return old.join(new, "_key", "full")


def upsert_documents(stored: DataFrame, incoming: DataFrame, now: Column, key: str = "doc_id") -> DataFrame:
    """Stored and incoming documents; a known one takes only the incoming title, source path, hash, pipeline version and metadata,
    is ingested ``now`` and no longer deleted. Author, pages, type and access columns keep their old values. ``action`` tells
    ``inserted``, ``updated`` and ``unchanged``. Keys must be unique on both sides (:func:`first_records`); NULL keys match nothing.
    """
    both = _sides(stored, incoming, key)
    both = both.withColumn("action", F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "unchanged").otherwise("updated"))
    hit = F.col("action") == "updated"
    given = set(incoming.columns)
    out = []
    for c in stored.columns:
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}") if c in given else F.lit(None)
        if c == "last_ingested_at":
            value = F.when(F.col("action") == "unchanged", old).otherwise(now)
        elif c == "is_deleted":
            value = F.when(F.col("action") == "unchanged", old).otherwise(F.lit(False))
        elif c == "created_at":
            value = F.when(F.col("action") == "inserted", now).otherwise(old)
        elif c in DOCUMENT_UPDATES:
            value = F.when(hit, new).otherwise(F.coalesce(old, new) if c == key else F.when(F.col("o").isNull(), new).otherwise(old))
        else:
            value = F.when(F.col("o").isNull(), new).otherwise(old)
        out.append(value.alias(c))
    return both.select(*out, "action")


def upsert_chunks(stored: DataFrame, incoming: DataFrame, now: Column, key: str = "chunk_id") -> DataFrame:
    """Stored and incoming chunks; a known one changes, in the columns of ``CHUNK_UPDATES`` and ``updated_at`` only, if its hash or
    model version differs. A NULL on either side of a comparison is no difference. ``action`` as in :func:`upsert_documents`.
    """
    both = _sides(stored, incoming, key)
    differs = F.coalesce(F.col("o.content_hash") != F.col("n.content_hash"), F.lit(False)) | F.coalesce(F.col("o.embedding_model_version") != F.col("n.embedding_model_version"), F.lit(False))
    both = both.withColumn("action", F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNotNull() & differs, "updated").otherwise("unchanged"))
    given = set(incoming.columns)
    out = []
    for c in stored.columns:
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}") if c in given else F.lit(None)
        fresh = F.when(F.col("o").isNull(), new)
        if c == "updated_at":
            value = F.when(F.col("action") == "unchanged", old).otherwise(now)
        elif c == "created_at":
            value = F.when(F.col("action") == "inserted", now).otherwise(old)
        elif c in CHUNK_UPDATES:
            value = fresh.when(F.col("action") == "updated", new).otherwise(old)
        else:
            value = fresh.otherwise(old)
        out.append(value.alias(c))
    return both.select(*out, "action")


def split_malformed(records: DataFrame, required: tuple[str, ...] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """Records with all required fields, and the others with ``missing``, their missing fields."""
    absent = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    marked = records.withColumn("missing", absent)
    return marked.where(F.size("missing") == 0).drop("missing"), marked.where(F.size("missing") > 0)


def dead_letters(failed: DataFrame, run_id: str, failed_at: Column) -> DataFrame:
    return failed.withColumn("_failed_at", failed_at).withColumn("_run_id", F.lit(run_id))


def first_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """The first record of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last()))
    return records.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def document_from_chunk(chunks: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Document columns out of a chunk's metadata, with defaults; what isn't promoted stays metadata."""
    m = F.col(metadata)
    got = lambda k: F.try_element_at(m, F.lit(k))
    return chunks.select(
        "doc_id",
        F.coalesce(got("doc_type"), F.lit("unknown")).alias("doc_type"),
        F.coalesce(got("doc_title"), F.col("doc_id")).alias("title"),
        F.coalesce(got("source_system"), F.lit("unknown")).alias("source_system"),
        F.coalesce(got("source_path"), F.lit("")).alias("source_path"),
        F.coalesce(got("content_hash"), F.lit("")).alias("content_hash"),
        got("page_count").try_cast("int").alias("page_count"),
        got("author").alias("author"),
        F.coalesce(got("access_classification"), F.lit("internal")).alias("access_classification"),
        F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*PROMOTED)).alias("metadata"),
    )


def chunk_access(groups: Column) -> Column:
    """Chunks without groups are open to all advisors; documents without groups to nobody in particular."""
    return F.when(groups.isNull() | (F.size(groups) == 0), F.array(F.lit(DEFAULT_GROUPS))).otherwise(groups)


def run_outcome(actions: DataFrame, failed: Column, errors: Column) -> DataFrame:
    """One row: inserted, updated, unchanged and failed chunks, the run's status, and its first five errors as JSON."""
    n = lambda a: F.count_if(F.col("action") == a)
    out = actions.agg(n("inserted").alias("chunks_inserted"), n("updated").alias("chunks_updated"), n("unchanged").alias("chunks_unchanged"))
    out = out.withColumn("chunks_failed", failed).withColumn("status", F.when(F.col("chunks_failed") == 0, "completed").otherwise("partial"))
    return out.withColumn("error_summary", F.when(F.size(errors) > 0, F.to_json(F.slice(errors, 1, 5))))


def start_run(runs: DataFrame, run_id: str, started_at: Column, **known: str) -> DataFrame:
    """The run table with a new run; running until :func:`finish_run`. Columns it isn't told are NULL."""
    row = runs.sparkSession.range(1).select(
        *[
            (F.lit(run_id) if c == "run_id" else started_at if c == "started_at" else F.lit("running") if c == "status" else F.lit(known.get(c))).cast(t).alias(c)
            for c, t in runs.dtypes
        ]
    )
    return runs.unionByName(row)


def finish_run(runs: DataFrame, run_id: str, completed_at: Column, outcome: DataFrame | None, error: str | None = None) -> DataFrame:
    """The run table with the run's outcome (a row of :func:`run_outcome`), or failed with ``error`` if there is none."""
    mine = F.col("run_id") == run_id
    if outcome is None:
        set_to = {"status": F.lit("failed"), "completed_at": completed_at, "error_summary": F.to_json(F.array(F.lit(error)))}
        return runs.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in set_to.items()})
    one = outcome.select(
        F.lit(run_id).alias("_run"), F.col("status").alias("_status"), (F.col("chunks_inserted") + F.col("chunks_updated")).cast("int").alias("_loaded"),
        F.col("chunks_failed").cast("int").alias("_failed"), F.col("error_summary").alias("_errors"),
    )
    both = runs.join(F.broadcast(one), F.col("run_id") == F.col("_run"), "left")  # one row
    hit = F.col("_run").isNotNull()
    set_to = {"status": F.col("_status"), "completed_at": completed_at, "chunks_loaded": F.col("_loaded"), "chunks_failed": F.col("_failed"), "error_summary": F.col("_errors")}
    return both.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in set_to.items()}).select(*runs.columns)
