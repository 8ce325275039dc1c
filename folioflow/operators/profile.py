"""Profiles of documents and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import count_tokens, strip

# The shortest page text that counts, the share of blank pages of a scan, the mean text of a native page.
BLANK_BELOW, SCANNED_SHARE, NATIVE_ABOVE = 50, 0.7, 200


def is_blank_page(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) < BLANK_BELOW


def document_profile(pages: DataFrame, doc: str, text: str, images: str) -> DataFrame:
    """A row per document: pages, characters, images, blank pages, kind and how to process it. NULL texts are blank, NULL image counts none."""
    size = F.length(strip(F.coalesce(F.col(text), F.lit("")))).cast("long")
    n_images = F.coalesce(F.col(images), F.lit(0))
    profile = pages.groupBy(F.col(doc).alias("doc_id")).agg(
        F.count("*").alias("page_count"),
        F.sum(size).alias("total_text_chars"),
        F.count_if(n_images > 0).alias("pages_with_images"),
        F.sum(n_images).cast("long").alias("total_images"),
        F.count_if(is_blank_page(F.col(text))).alias("scanned_pages"),
    )
    mean = F.col("total_text_chars") / F.col("page_count")
    kind = (
        F.when(F.col("scanned_pages") > F.col("page_count") * F.lit(SCANNED_SHARE), "scanned")
        .when((F.col("total_images") > 0) & (mean > NATIVE_ABOVE), "mixed_content")
        .when(mean > NATIVE_ABOVE, "native_text")
        .otherwise("sparse_text")
    )
    return (
        profile.withColumn("avg_chars_per_page", F.round(mean, 6))
        .withColumn("primary_type", kind)
        .withColumn("processing_strategy", F.when(F.col("primary_type") == "mixed_content", "full_layout_analysis").otherwise("text_extraction"))
    )


def histogram(df: DataFrame, column: str, known: tuple[str, ...] = ()) -> DataFrame:
    """Rows per value; every ``known`` value appears, with 0 if need be."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    if not known:
        return counts
    spark = df.sparkSession
    names = spark.createDataFrame([(k,) for k in known], f"{column} string")
    both = names.join(counts, column, "full")
    return both.select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def token_statistics(df: DataFrame, text: str, cost_per_1k: float = 0.00013) -> DataFrame:
    """One row: number of texts, their least, greatest, mean and total tokens, and the price of embedding them."""
    tokens = count_tokens(F.col(text))
    stats = df.where(F.col(text).isNotNull()).agg(
        F.count("*").alias("n_chunks"), F.min(tokens).alias("min_tokens"), F.max(tokens).alias("max_tokens"), F.round(F.avg(tokens), 4).alias("avg_tokens"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("total_tokens")
    )
    return stats.withColumn("cost_usd", F.round(F.col("total_tokens") / 1000 * cost_per_1k, 6))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Per strategy: chunks, mean tokens of their texts, and chunks that refer to figures."""
    return chunks.groupBy(F.coalesce("chunk_strategy", F.lit("unknown")).alias("strategy")).agg(
        F.count("*").alias("n_chunks"),
        F.round(F.avg(count_tokens(F.col("text_for_embedding"))), 4).alias("avg_tokens"),
        F.count_if(F.coalesce(F.size("referenced_figures"), F.lit(0)) > 0).alias("with_figures"),
    )


def routing_cost(routings: DataFrame, decision: str = "decision") -> DataFrame:
    """Price of describing figures by a vision model and of reading scans, and what skipping saves."""
    n = lambda *names: F.count_if(F.col(decision).isin(*names))
    return routings.agg(
        F.round(n("skip_decorative") * 0.01, 4).alias("saved_usd"),
        F.round(n("process_as_chart", "process_as_diagram") * 0.01, 4).alias("vision_usd"),
        F.round(n("process_as_scan") * 0.001, 4).alias("ocr_usd"),
    )


def corpus_summary(chunks: DataFrame, source: str, status: Column) -> DataFrame:
    return chunks.groupBy(F.col(source).alias("source"), status.alias("status")).agg(F.count("*").alias("n_chunks"))
