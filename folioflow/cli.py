"""python -m folioflow.cli QUERY --data FOLDER [--mode vector|keyword|hybrid] [--k N] [--json]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from folioflow.commits import CommitLog
from folioflow.config import load_settings
from folioflow.operators.embedding import HashEmbedder
from folioflow.plans.pipeline import Engine
from folioflow.sources.files import results_json


def format_result(row, number: int) -> str:
    """A result for the terminal; scores with 4 decimals, the path cut at 77 characters, the preview at 237."""
    scores = [(n, row[c]) for n, c in (("vec", "vector_similarity"), ("kw", "keyword_score"), ("combined", "combined_score"), ("rerank", "rerank_score"))]
    path, text = row["section_path"], (row["text"] or "").strip().replace("\n", " ")
    lines = [
        f"[{number}] " + "  ".join(f"{n}={v:.4f}" for n, v in scores if v is not None),
        f"    chunk_id:  {row['chunk_id']}",
        f"    heading:   {row['section_heading'] or '(none)'}",
    ]
    if path:
        lines.append(f"    path:      {path if len(path) <= 80 else path[:77] + '...'}")
    if row["page_range"]:
        lines.append(f"    pages:     {row['page_range']['lo']}-{row['page_range']['hi']}")
    return "\n".join([*lines, f"    preview:   {text if len(text) <= 240 else text[:237] + '...'}"])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("query")
    p.add_argument("--data", required=True, help="folder of a build, or one with chunks.parquet and documents.parquet")
    p.add_argument("--mode", choices=("vector", "keyword", "hybrid"))
    p.add_argument("--k", type=int)
    p.add_argument("--min-similarity", type=float)
    p.add_argument("--as-of")
    p.add_argument("--doc-type", action="append", default=[])
    p.add_argument("--group", action="append", default=[])
    p.add_argument("--no-rerank", action="store_true")
    p.add_argument("--json", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("folioflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    settings = load_settings()
    built = CommitLog(spark, a.data)
    names = ("chunks", "documents")
    chunks, documents = (built.table(t) for t in names) if built.last() else (spark.read.parquet(f"{a.data}/{t}.parquet") for t in names)
    key = "doc_key" if "doc_key" in documents.columns else "doc_id"
    engine = Engine(spark, settings, HashEmbedder(settings.embedding.dimension), chunks, documents, doc_key=key)
    given = {"mode": a.mode, "top_k": a.k, "min_similarity": a.min_similarity, "as_of": a.as_of}
    wanted = {k: v for k, v in given.items() if v is not None} | {"doc_types": tuple(a.doc_type), "groups": tuple(a.group)}
    rows = engine.search(a.query, **wanted, **({"rerank": False} if a.no_rerank else {})).orderBy("rank")
    if a.json:
        print("[" + ",\n".join(r[0] for r in rows.select(results_json(rows)).collect()) + "]")
    else:
        print("\n\n".join(format_result(r, i) for i, r in enumerate(rows.collect(), 1)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
