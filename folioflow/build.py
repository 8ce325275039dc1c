"""python -m folioflow.build FOLDER OUT [--pattern *.txt] [--only TEXT] [--limit N] [--rebuild] [--no-embed]

Builds or extends a corpus: pages to sections to chunks to vectors, upserted into tables under OUT.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.commits import CommitLog
from folioflow.operators.embedding import HashEmbedder
from folioflow.operators.upsert import chunk_access, document_from_chunk, first_records, upsert_chunks, upsert_documents
from folioflow.plans.pipeline import build_chunks, embed_new
from folioflow.sources.files import non_empty_pages, read_pages, select_files, swap_table, write_metrics
from folioflow.storage import filesystem, materialize

CHECKPOINT = "chunk_id string, content_hash string, model_version string, embedded_at double, vector_path string"


def build(spark: SparkSession, folder: str, out: str, pattern: str = "*.txt", only: str | None = None, limit: int | None = None, rebuild: bool = False, make=HashEmbedder, embed: bool = True) -> dict:
    """Counts of what was done. Unreadable files are counted and don't stop the others; chunks that didn't change aren't embedded again."""
    if rebuild:
        fs, where = filesystem(spark, out)
        fs.delete(where, True)
    pages = materialize(read_pages(spark, folder, pattern), "pages")
    names = select_files(pages.select("source_file").distinct(), "source_file", only)
    chosen = names.limit(limit) if limit else names
    readable = pages.join(chosen, "source_file", "left_semi")
    failed = readable.where("error is not null").count()
    texts = non_empty_pages(readable.where("error is null").drop("error"))
    chunks = materialize(build_chunks(texts), "chunks")
    report = {"files_failed": failed, "chunks": chunks.count()}
    if not embed:
        swap_table(chunks, f"{out}/chunk_list")
        return report
    log = CommitLog(spark, out)
    stored = lambda name, schema: table if (table := log.table(name)) is not None else spark.createDataFrame([], schema)
    checkpoint, number = stored("checkpoint", CHECKPOINT), log.number() + 1
    tried = embed_new(chunks, checkpoint, make)
    fresh = tried.where("embedding_error is null").drop("embedding_error")
    now = F.current_timestamp()
    incoming = fresh.withColumns(
        {"access_classification": F.lit("internal"), "access_groups": chunk_access(F.lit(None).cast("array<string>")), "run_id": F.lit(None).cast("string"), "referenced_tables": F.array().cast("array<string>")}
    )
    merged = upsert_chunks(stored("chunks", schemas.CHUNKS_TABLE), incoming, now)
    merged = materialize(merged, "merged")
    first = first_records(fresh.withColumn("_o", F.struct("chunk_id")), "doc_id", "_o")
    documents = upsert_documents(stored("documents", schemas.DOCUMENTS_TABLE), document_from_chunk(first), now).drop("action")
    done = fresh.select("chunk_id", "content_hash", F.col("embedding_model_version").alias("model_version"), "embedded_at", F.lit(f"{out}/chunks").alias("vector_path"))
    covered = checkpoint.join(done.select("chunk_id"), "chunk_id", "left_anti").unionByName(done)
    # Together or not at all: what the checkpoint covers is in the tables. A second build that began at the same commit fails here.
    log.publish({"documents": documents, "chunks": merged.drop("action"), "checkpoint": covered}, number=number)
    log.vacuum(keep=2)
    bad = tried.select(F.col("embedding_error").alias("error"))
    report |= {k: v for k, v in write_metrics(spark, f"{out}/metrics.json", {"chunks": report["chunks"]}, bad).items() if k == "failed"}
    return report | {r["action"]: r["count"] for r in merged.groupBy("action").count().collect()} | {"embedded": fresh.count()}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("folder")
    p.add_argument("out")
    p.add_argument("--pattern", default="*.txt")
    p.add_argument("--only")
    p.add_argument("--limit", type=int)
    p.add_argument("--rebuild", action="store_true")
    p.add_argument("--no-embed", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("folioflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(build(spark, a.folder, a.out, a.pattern, a.only, a.limit, a.rebuild, embed=not a.no_embed))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
