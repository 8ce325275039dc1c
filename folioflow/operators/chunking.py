"""Cutting texts into chunks: by separators and characters, or by sections, paragraphs and tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from folioflow.functions import text as T

# Limits of section-aware chunks in tokens; size and overlap of character chunks; paragraphs merged below.
MAX_TOKENS, OVERLAP_TOKENS, RESERVE = 1000, 80, 50
SIZE, OVERLAP, SEPARATORS = 750, 100, ("\n\n", "\n", ".", " ", "")
SMALL_PARAGRAPH = 50
PARAGRAPH = r"\n[ \t\r\f\x0B]*\n[ \t\n\r\f\x0B]*"


def keeps_chunk(t: Column) -> Column:
    """More than 50 characters, fewer than 10 line breaks, and not all digits; NULL doesn't pass."""
    bare = T.strip(t)
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.coalesce((F.length(bare) > 50) & (breaks < 10) & ~bare.rlike("^[0-9]+$"), F.lit(False))


def paragraphs(t: Column, separator: str = PARAGRAPH) -> Column:
    """Paragraphs of a text, small ones merged with what follows while their tokens stay below 50 together."""
    raw = F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), separator, -1), T.strip), lambda x: x != "")
    return F.transform(_merged(F.transform(raw, T.count_tokens)), lambda r: F.array_join(F.slice(raw, r["at"], r["n"]), "\n\n"))


@F.arrow_udf(ArrayType(StructType([StructField("at", IntegerType()), StructField("n", IntegerType())])))
def _merged(sizes: pa.Array) -> pa.Array:
    """First and number of the paragraphs that are merged into one, by their tokens."""
    out = []
    for one in sizes.to_pylist():
        runs, total = [], 0
        for i, n in enumerate(one, 1):
            total += n
            if runs and total < SMALL_PARAGRAPH:
                runs[-1]["n"] += 1
            else:
                runs.append({"at": i, "n": 1})
                total = n
        out.append(runs)
    return pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))


def windows(sizes: list[int], base: int, room: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of consecutive items, each ending before the item that would take it beyond ``room``.

    A range starts with as many of its predecessor's last items as have ``overlap`` tokens together. ``base`` is spent in each
    range; an item above the room stands in a range all the same.
    """
    out, first, load = [], 0, base
    for i, size in enumerate(sizes):
        if i > first and load + size > room:
            out.append((first, i))
            start, first, carried = first, i, 0
            while first > start and carried + sizes[first - 1] <= overlap:
                first -= 1
                carried += sizes[first]
            load = base + carried
        load += size
    if sizes:
        out.append((first, len(sizes)))
    return out


def _split_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        found = [windows([len(p) // 4 for p in ps], len(prefix) // 4, MAX_TOKENS - len(prefix) // 4 - RESERVE, OVERLAP_TOKENS) for ps, prefix in zip(batch.column(names.index("_paragraphs")).to_pylist(), batch.column(names.index("_prefix")).to_pylist())]
        kept = [c for n, c in zip(names, batch.columns) if n != "_windows"]
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*kept, pa.array([[{"lo": a, "hi": b} for a, b in w] for w in found], kind)], [*(n for n in names if n != "_windows"), "_windows"])


def chunk_sections(sections: DataFrame) -> DataFrame:
    """Token-bounded chunks of sections (``doc_id``, ``ord``, ``heading``, ``level``, ``parent_path``, ``page_range``, ``text``, ``figures``).

    A section whose text, heading and breadcrumb have at most 1,000 tokens is one chunk. A larger one is cut between
    paragraphs; its chunks carry the heading without the breadcrumb, share up to 80 tokens with their neighbour, and the
    heading counts twice against the limit. A paragraph is never cut. Figures go to the first chunk. Sections without text
    give none. ``chunk_id`` gets the section's number when a document repeats a path, which would else repeat ids.
    """
    base = sections.select(
        "doc_id", "ord", "heading", "level", "parent_path", "page_range", "figures", T.strip(F.coalesce("text", F.lit(""))).alias("text")
    ).where(F.col("text") != "")
    base = base.withColumn("_path", T.section_path(F.col("parent_path"), F.col("heading"))).withColumn("_prefix", T.heading_prefix(F.col("heading")))
    base = base.withColumn("_full", F.concat(T.breadcrumb(F.col("_path"), F.col("heading")), F.col("_prefix"), F.col("text")))
    fits = T.count_tokens(F.col("_full")) <= MAX_TOKENS
    whole = base.where(fits).withColumn("_chunks", F.array("_full")).withColumn("chunk_strategy", F.lit("whole_section"))
    large = base.where(~fits).withColumn("_paragraphs", paragraphs(F.col("text")))
    shape = large.withColumn("_windows", F.lit(None).cast("array<struct<lo:int,hi:int>>"))
    cut = large.mapInArrow(_split_windows, shape.schema)
    pieces = F.transform("_windows", lambda w: F.concat(F.col("_prefix"), F.array_join(F.slice("_paragraphs", w["lo"] + 1, w["hi"] - w["lo"]), "\n\n")))
    split = cut.withColumn("_chunks", pieces).withColumn("chunk_strategy", F.lit("section_split"))
    both = whole.unionByName(split.drop("_paragraphs", "_windows"))
    flat = both.select("*", F.posexplode("_chunks").alias("chunk_index", "text_for_embedding"))
    nth = F.dense_rank().over(Window.partitionBy("doc_id", "_path").orderBy("ord")) - 1
    named = flat.withColumn("_nth", nth)
    own = T.chunk_id(F.col("doc_id"), F.col("_path"), F.col("chunk_index"))
    has_figures = F.coalesce(F.size("figures"), F.lit(0)) > 0
    first = (F.col("chunk_index") == 0) & has_figures
    return named.select(
        F.when(F.col("_nth") > 0, F.concat(own, F.lit("__s"), F.col("_nth").cast("string"))).otherwise(own).alias("chunk_id"),
        "doc_id",
        "text_for_embedding",
        F.when(first, "prose_with_figure").otherwise("prose").alias("chunk_type"),
        F.col("_path").alias("section_path"),
        F.col("heading").alias("section_heading"),
        F.col("level").alias("section_level"),
        "page_range",
        T.count_tokens(F.col("text_for_embedding")).cast("int").alias("token_count"),
        F.length("text_for_embedding").alias("char_count"),
        "chunk_index",
        "chunk_strategy",
        F.when(first, F.col("figures")).otherwise(F.slice("figures", 1, 0)).alias("referenced_figures"),
    )


def recursive_pieces(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that helps; a separator begins the piece after it.

    Parts too long for one separator go to the next; neighbouring short parts are packed, and each pack begins with parts of
    its predecessor of up to ``overlap`` characters. Pieces are stripped, empty ones dropped.
    """
    k = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[k], separators[k + 1 :]
    parts = [p for p in (re.split(f"(?={re.escape(mark)})", text) if mark else list(text)) if p]
    out: list[str] = []
    run: list[str] = []

    def pack() -> None:
        lo = total = 0
        for hi, p in enumerate(run):
            if total + len(p) > size and hi > lo:
                out.append("".join(run[lo:hi]).strip())
                while lo < hi and (total > overlap or total + len(p) > size):
                    total -= len(run[lo])
                    lo += 1
            total += len(p)
        if lo < len(run):
            out.append("".join(run[lo:]).strip())
        run.clear()

    for p in parts:
        if len(p) < size:
            run.append(p)
            continue
        pack()
        if finer:
            out.extend(recursive_pieces(p, size, overlap, finer))
        else:
            out.append(p.strip())
    pack()
    return [p for p in out if p]


def character_chunks(pages: DataFrame, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of page texts that pass :func:`keeps_chunk`, with all other columns of the page and ``seq`` from 0. NULL texts give none."""
    @F.arrow_udf("array<string>")
    def pieces(v: pa.Array) -> pa.Array:
        return pa.array([recursive_pieces(t, size, overlap) if t else [] for t in v.to_pylist()], pa.list_(pa.string()))

    flat = pages.select(*[c for c in pages.columns if c != text], F.posexplode(pieces(F.col(text))).alias("seq", "text"))
    return flat.where(keeps_chunk(F.col("text")))
