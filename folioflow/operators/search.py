"""Vector, keyword and hybrid search over chunks and documents, with filters before ranking."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import STOP_WORDS, preview
from folioflow.functions.vectors import cosine_to, matrix
from folioflow.operators.current import current_rows

RESULT = ("chunk_id", "doc_id", "text", "section_heading", "section_path", "page_range", "embedding_model")


@dataclass(frozen=True)
class Request:
    """What is asked. ``as_of`` is the day whose validity counts; None turns the date filter off, and soft deletion with it."""

    query: str
    vector: list[float] | None = None
    top_k: int = 5
    mode: str = "hybrid"
    classifications: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    doc_types: tuple[str, ...] = ()
    as_of: str | None = None
    min_similarity: float = 0.0
    full_text: bool = True
    weights: tuple[float, float] = (0.7, 0.3)
    candidates: int = 50
    rerank: bool = False


def check(request: Request, most: int = 50) -> None:
    if request.top_k > most:
        raise ValueError(f"top_k is {request.top_k}; the most is {most}")
    if request.top_k < 1:
        raise ValueError("top_k must be positive")
    if not request.query.strip():
        raise ValueError("the query is empty")
    if request.mode not in ("vector", "keyword", "hybrid"):
        raise ValueError(f"unknown mode: {request.mode}")


def fetch_limit(request: Request) -> int:
    """Rows to fetch: as many as are reranked, else as many as are wanted."""
    return max(request.top_k, request.candidates) if request.rerank else request.top_k


def may_read(request: Request, access: Column, groups: Column) -> Column:
    """Any of the classifications and an overlap of groups; an empty list of either allows nothing to be asked of it."""
    cond = F.lit(True)
    if request.classifications:
        cond = cond & access.isin(*request.classifications)
    if request.groups:
        cond = cond & F.coalesce(F.arrays_overlap(groups, F.array(*map(F.lit, request.groups))), F.lit(False))
    return cond


def is_valid(as_of: str, deleted: Column, effective: Column, expiry: Column) -> Column:
    """Not deleted, in force on the day and not expired before it; a NULL date doesn't limit, a NULL flag isn't deleted."""
    day = F.to_date(F.lit(as_of))
    return ~F.coalesce(deleted, F.lit(False)) & (effective.isNull() | (effective <= day)) & (expiry.isNull() | (expiry >= day))


def eligible(chunks: DataFrame, documents: DataFrame, request: Request, doc_key: str = "doc_key") -> DataFrame:
    """Chunks of valid documents of the wanted types that the asker may read. Only keys of documents travel; which side is sent
    round, if any, is left to the sizes Spark sees."""
    cond = F.lit(True)
    if request.doc_types:
        cond = cond & F.col("doc_type").isin(*request.doc_types)
    if request.as_of:
        cond = cond & is_valid(request.as_of, F.col("is_deleted"), F.col("effective_date"), F.col("expiry_date"))
    docs = documents.where(cond).select(F.col(doc_key).alias("doc_id"))
    return chunks.where(may_read(request, F.col("access_classification"), F.col("access_groups"))).join(docs, "doc_id", "left_semi")


def text_column(request: Request) -> Column:
    return F.col("text_for_embedding") if request.full_text else preview(F.col("text_for_embedding"), 500)


def latest(chunks: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row per chunk, that of its latest version (``updated_at``, if the table has one). ``columns``, scores too, are computed
    before the shuffle: neither vectors nor texts travel."""
    versioned = chunks if "updated_at" in chunks.columns else chunks.withColumn("updated_at", F.lit(0))
    return current_rows(versioned, "chunk_id", "updated_at", columns)


def scored(chunks: DataFrame, documents: DataFrame, request: Request, scores: dict[str, Column], doc_key: str = "doc_key") -> DataFrame:
    """Latest chunks that :func:`eligible` lets through, with ``scores``."""
    columns = {c: F.col(c) for c in ("doc_id", "access_classification", "access_groups")}
    return eligible(latest(chunks, columns | scores), documents, request, doc_key)


def similarity(request: Request) -> dict[str, Column]:
    """``vector_similarity``: NULL for unusable vectors, which never match."""
    return {"vector_similarity": cosine_to(request.vector)(F.col("embedding"))}


def nearest(frame: DataFrame, request: Request, limit: int) -> DataFrame:
    """``chunk_id`` and ``vector_similarity`` of the nearest chunks at or above the threshold; ties by id."""
    near = frame.select("chunk_id", "vector_similarity").where(F.col("vector_similarity") >= request.min_similarity)
    return near.orderBy(F.desc("vector_similarity"), "chunk_id").limit(limit)


def query_terms(query: str) -> list[str]:
    """Distinct search terms of a query, by the rule of :func:`folioflow.functions.text.terms`."""
    return sorted({w for w in re.findall(r"[^\W_]+", query.lower()) if w not in STOP_WORDS})


def cover_density(words: Column, wanted: list[str]) -> Column:
    """Rank of a text by the density of its covers (Clarke et al.): over the shortest stretches of ``words`` that hold all of
    ``wanted``, the sum of 0.1 / (1 + words in the stretch that aren't wanted); NULL without any.

    One fold over the places of wanted words keeps the last place of each; where the earliest of these moves on, a cover ends.
    """
    array = F.array(*map(F.lit, wanted))
    spots = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), F.array_position(array, w).cast("int").alias("term"))), lambda s: s["term"] > 0)
    spots = F.transform(spots, lambda s, i: F.struct(s["at"].alias("at"), i.alias("nth"), s["term"].alias("term")))
    place = "struct<at:int,nth:int>"
    nowhere = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("nth")).cast(place)
    start = F.struct(F.array(*[nowhere] * len(wanted)).alias("last"), F.lit(-1).alias("left"), F.lit(0.0).alias("sum"))

    def step(state: Column, spot: Column) -> Column:
        here = F.struct(spot["at"].alias("at"), spot["nth"].alias("nth")).cast(place)
        last = F.transform(state["last"], lambda p, t: F.when(t + 1 == spot["term"], here).otherwise(p))
        first = F.array_min(last)
        other = (spot["at"] - first["at"]) - (spot["nth"] - first["nth"])
        ends = first["at"] > state["left"]
        return F.struct(last.alias("last"), F.when(ends, first["at"]).otherwise(state["left"]).alias("left"), (state["sum"] + F.when(ends, 0.1 / (1.0 + other)).otherwise(0.0)).alias("sum"))

    return F.aggregate(spots, start, step, lambda s: F.nullif(s["sum"], F.lit(0.0)))


def keyword_score(text: Column, wanted: list[str]) -> dict[str, Column]:
    """``keyword_score``: the cover density of a text that has all the terms, else NULL. No terms match nothing.

    A plain substring test goes before the split into words, which only texts that pass it undergo.
    """
    if not wanted:
        return {"keyword_score": F.lit(None).cast("double")}
    low = F.lower(text)
    maybe = functools.reduce(Column.__and__, [F.contains(low, F.lit(w)) for w in wanted])
    words = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return {"keyword_score": F.round(F.when(maybe, cover_density(words, wanted)), 6)}


def matching(frame: DataFrame) -> DataFrame:
    """``chunk_id`` and ``keyword_score`` of the chunks that have one."""
    return frame.select("chunk_id", "keyword_score").where(F.col("keyword_score").isNotNull())


def with_results(hits: DataFrame, chunks: DataFrame, request: Request) -> DataFrame:
    """Late materialization: the few hits meet the table in its scan, and only what is left of it is ranked by version and shuffled."""
    versioned = chunks if "updated_at" in chunks.columns else chunks.withColumn("updated_at", F.lit(0))
    wide = versioned.withColumn("text", text_column(request)).select(*RESULT, "updated_at")
    found = F.broadcast(hits).join(wide, "chunk_id")  # at most the fetch limit, which check() bounds
    version = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.col("updated_at").desc_nulls_last()))
    return found.withColumn("_version", version).where("_version = 1").drop("_version", "updated_at")


def hybrid_scores(vector_hits: DataFrame, keyword_hits: DataFrame, request: Request) -> DataFrame:
    """Full outer join of both candidate lists; keyword scores are divided by their greatest; the threshold is on the combined score."""
    top = F.max("keyword_score").over(Window.partitionBy())  # over the capped candidates only
    scaled = keyword_hits.withColumn("keyword_score", F.coalesce(F.try_divide(F.col("keyword_score"), F.nullif(top, F.lit(0.0))), F.lit(0.0)))
    both = vector_hits.join(scaled, "chunk_id", "full").na.fill(0.0, ["vector_similarity", "keyword_score"])
    v, k = request.weights
    combined = F.round(F.lit(v) * F.col("vector_similarity") + F.lit(k) * F.col("keyword_score"), 6)
    return both.withColumn("keyword_score", F.round("keyword_score", 6)).withColumn("combined_score", combined).where(F.col("combined_score") >= request.min_similarity)


def candidates(chunks: DataFrame, documents: DataFrame, request: Request, doc_key: str = "doc_key") -> DataFrame:
    """The best chunks by the request's mode with their three scores (NULL where the mode has none), before reranking."""
    check(request)
    limit, none = fetch_limit(request), F.lit(None).cast("double")
    frame = lambda scores: scored(chunks, documents, request, scores, doc_key)
    by_keyword = lambda n: matching(frame(keyword_score(F.col("text_for_embedding"), query_terms(request.query)))).orderBy(F.desc("keyword_score"), "chunk_id").limit(n)
    if request.mode == "vector":
        return nearest(frame(similarity(request)), request, limit).withColumn("keyword_score", none).withColumn("combined_score", none)
    if request.mode == "keyword":  # the threshold doesn't apply to raw keyword scores
        return by_keyword(limit).withColumn("vector_similarity", none).withColumn("combined_score", none)
    pool = max(request.candidates, limit)
    # Candidates aren't thresholded one by one: the combined score is. Either list reads what it scores by, and nothing else.
    vector_hits = nearest(frame(similarity(request)), replace(request, min_similarity=-1.0), pool)
    return hybrid_scores(vector_hits, by_keyword(pool), request).orderBy(F.desc("combined_score"), "chunk_id").limit(limit)


def effective_score() -> Column:
    """What a result is reported by: its similarity, or the combined score where that is NULL or 0."""
    return F.coalesce(F.nullif("vector_similarity", F.lit(0.0)), "combined_score")


def retrieve(chunks: DataFrame, documents: DataFrame, request: Request, reranker=None, doc_key: str = "doc_key") -> DataFrame:
    """Ranked results of a request: search, rerank if wanted and there is more than one hit, keep ``top_k`` and number them.

    ``chunks`` may hold several versions of a chunk; the latest counts, whether or not it matches.
    """
    hits = candidates(chunks, documents, request, doc_key)
    key = {"vector": "vector_similarity", "keyword": "keyword_score", "hybrid": "combined_score"}[request.mode]
    rows = with_results(hits, chunks, request).withColumn("retrieval_rank", F.row_number().over(Window.orderBy(F.desc(key), "chunk_id")))
    if request.rerank and reranker is not None:
        rows = reranker.score(rows, request.query)
        order = [F.desc("rerank_score"), F.asc("retrieval_rank")]
    else:
        rows = rows.withColumn("rerank_score", F.lit(None).cast("double"))
        order = [F.asc("retrieval_rank")]
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= request.top_k).drop("retrieval_rank")


def batch_nearest(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, id_col: str, vector: str, dim: int, block: int = 200_000) -> DataFrame:
    """``query_id``, ``id``, ``similarity``, ``rank``: exact nearest neighbours of a bounded set of queries in the whole corpus.

    The queries, at most ``block`` of them, are sent round as one matrix; each task keeps its own best ``k`` per query, and
    only these are shuffled. More queries raise.
    """
    asked = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).orderBy("q").limit(block + 1).toArrow()
    if asked.num_rows > block:
        raise ValueError(f"more than {block} queries; search in several calls")
    x, at = matrix(asked["v"].combine_chunks(), dim)
    names = asked["q"].combine_chunks().take(pa.array(at))
    shared = queries.sparkSession.sparkContext.broadcast((x / np.linalg.norm(x, axis=1, keepdims=True), names))
    q_type, i_type = queries.schema[query_id].dataType.simpleString(), corpus.schema[id_col].dataType.simpleString()

    def run(batches):
        q, qn = shared.value
        if not len(q):
            return
        for batch in batches:
            y, kept = matrix(batch.column(1), dim)
            if not len(y):
                continue
            ids = batch.column(0).take(pa.array(kept))
            order = np.asarray(pc.sort_indices(ids))
            y, ids = y[order], ids.take(pa.array(order))
            y = y / np.linalg.norm(y, axis=1, keepdims=True)
            for s in range(0, len(q), max(1, 8_000_000 // len(y))):
                score = np.round(q[s : s + max(1, 8_000_000 // len(y))] @ y.T, 6)
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(s, s + len(score)), best.shape[1])
                yield pa.RecordBatch.from_arrays([qn.take(pa.array(rows)), ids.take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, 1).ravel())], ["query_id", "id", "similarity"])

    near = corpus.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).mapInArrow(run, f"query_id {q_type}, id {i_type}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
