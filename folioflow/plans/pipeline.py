"""From pages to searchable chunks: one lazy chain, materialized where a model runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.cache import CachedEmbedder, VectorMemo
from folioflow.config import Settings
from folioflow.functions.text import content_hash, document_slug, pretty_title
from folioflow.operators import health, search, sections
from folioflow.operators.chunking import chunk_sections
from folioflow.operators.embedding import Embedder, embed, embedding_plan
from folioflow.operators.rerank import TermOverlap
from folioflow.operators.sections import pack_pages
from folioflow.storage import materialize


def sections_from_outline(outline: DataFrame, pages: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """Sections of documents with a table of contents, in the shape that chunking takes.

    ``outline``: ``doc_id``, ``ord``, ``title``, ``level``, ``page_start``; ``pages``: ``doc_id``, ``page``, ``text``; ``figures``: ``doc_id``,
    ``page``, ``element_id``, ``decision``. A section's text is that of its pages, from its own to the one before the next heading's; a page
    with two headings belongs to the later one, and the earlier one, left without pages, to no chunk. Missing pages have no text.
    """
    last = pages.groupBy("doc_id").agg(F.max("page").alias("page_count"))
    toc = sections.page_ends(sections.walk_outline(outline).join(last, "doc_id"))
    spelled = toc.where("page_end >= page_start").select("doc_id", "ord", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n\n")
    texts = spelled.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"]).groupBy("doc_id", "ord").agg(text.alias("text"))
    kind = "array<struct<element_id:string,description:string,decision:string>>"
    whole = toc.join(texts, ["doc_id", "ord"])
    if figures is None:
        whole = whole.withColumn("figures", F.array().cast(kind))
    else:
        found = sections.figures_in_sections(toc, figures)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("page", "element_id", "description", "decision"))), lambda x: F.struct(x["element_id"].alias("element_id"), x["description"].alias("description"), x["decision"].alias("decision")))
        whole = whole.join(found.groupBy("doc_id", "ord").agg(listed.alias("figures")), ["doc_id", "ord"], "left").withColumn("figures", F.coalesce("figures", F.array().cast(kind)))
    return whole.select("doc_id", "ord", F.col("title").alias("heading"), "level", "parent_path", F.struct(F.col("page_start").alias("lo"), F.col("page_end").alias("hi")).alias("page_range"), "text", "figures")


def sections_from_pages(pages: DataFrame) -> DataFrame:
    """Sections for documents without a table of contents, in the shape that chunking takes."""
    packed = pack_pages(pages.withColumn("_doc", document_slug(F.regexp_replace("source_file", r"\.[^.]*$", ""))), "_doc", "page", "text")
    return packed.select(
        "doc_id", F.col("section").alias("ord"), "heading", F.lit(1).alias("level"), F.array().cast("array<string>").alias("parent_path"),
        F.struct(F.col("page_start").alias("lo"), F.col("page_end").cast("int").alias("hi")).alias("page_range"), "text",
        F.array().cast("array<struct<element_id:string,description:string,decision:string>>").alias("figures"),
    )


def build_chunks(pages: DataFrame, outline: DataFrame | None = None, figures: DataFrame | None = None) -> DataFrame:
    """Chunks of documents' pages: by their outline where they have one, else by packed pages."""
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    titles = pages.select(document_slug(stem).alias("doc_id"), pretty_title(stem).alias("doc_title")).distinct()
    plain, parts = pages, None
    if outline is not None:
        named = pages.withColumn("doc_id", document_slug(stem))
        has = outline.where("page_start is not null").select("doc_id").distinct()
        parts = sections_from_outline(outline, named.join(has, "doc_id", "left_semi"), figures)
        plain = named.join(has, "doc_id", "left_anti").drop("doc_id")
    packed = sections_from_pages(plain)
    chunks = chunk_sections(packed if parts is None else parts.select(packed.columns).unionByName(packed)).join(titles, "doc_id")
    meta = F.create_map(F.lit("doc_title"), F.col("doc_title"), F.lit("doc_type"), F.lit("ebook"), F.lit("access_classification"), F.lit("internal"))
    return chunks.withColumn("metadata", meta).drop("doc_title")


def embed_new(chunks: DataFrame, checkpoint: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """Chunks the checkpoint doesn't cover, with vectors; the anti-join comes before the model, and its output is written once.

    A chunk whose batch failed for good has ``embedding_error`` instead of a vector, and stays uncovered.
    """
    model = make()
    due = embedding_plan(chunks, checkpoint, model.version).where("status = 'pending'").drop("status", "model_version")
    out = embed(due, "text_for_embedding", make, errors=True)
    return materialize(
        out.withColumns(
            {
                "embedding_model": F.lit(model.name), "embedding_model_version": F.lit(model.version), "embedding_dimension": F.lit(model.dimension),
                "embedded_at": F.unix_micros(F.current_timestamp()) / 1e6, "content_hash": content_hash(F.col("text_for_embedding")),
            }
        ),
        "embedded",
    )


class Engine:
    """Search over a corpus with the given settings; refuses a corpus that isn't fit.

    ``chunks`` may hold several versions of a chunk; only the latest of each is looked at and found.
    """

    def __init__(self, spark: SparkSession, settings: Settings, model: Embedder, chunks: DataFrame, documents: DataFrame, reranker=None, doc_key: str = "doc_id"):
        current = search.latest(chunks, {c: F.col(c) for c in ("embedding_model", "embedding")})
        report = health.inspect(current.where("embedding is not null"), settings.embedding.model_name, settings.embedding.dimension)
        if not report.ok:
            raise RuntimeError("; ".join(report.problems))
        self.spark, self.settings, self.chunks, self.documents, self.doc_key = spark, settings, chunks, documents, doc_key
        self.embedder = CachedEmbedder(model, VectorMemo(*settings.cache.limits()), settings.embedding.max_retries)
        self.reranker = reranker or TermOverlap()

    def search(self, query: str, **wanted) -> DataFrame:
        r = self.settings.retrieval
        base = {
            "top_k": r.default_top_k, "mode": r.default_mode, "min_similarity": r.min_similarity, "weights": (r.vector_weight, r.keyword_weight),
            "candidates": r.candidates, "rerank": r.rerank,
        }
        request = search.Request(query, **(base | wanted))
        search.check(request, r.max_top_k)
        if request.mode != "keyword" and request.vector is None:
            vector, _ = self.embedder.embed(query)
            request = search.Request(query, **(base | wanted | {"vector": vector}))
        return search.retrieve(self.chunks, self.documents, request, self.reranker, self.doc_key)
