"""Sections of documents: from tables of contents, or packed from pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.layout import figure_placeholder
from folioflow.functions.text import count_tokens, strip

#: Tokens at which a packed section is closed.
PACK_TOKENS = 850

#: Levels of blocks of 4 ** level pages: enough for all numbers an INT can be.
BLOCK_LEVELS = range(17)


def page_ends(toc: DataFrame, doc: str = "doc_id", order: str = "ord", start: str = "page_start", pages: str = "page_count") -> DataFrame:
    """Adds ``page_end``: the page before the next heading's, whatever its level; for the last heading the document's last page.

    Two headings on one page give the first an end before its start: it has no text and vanishes when chunked.
    """
    following = F.lead(start).over(Window.partitionBy(doc).orderBy(order)) - 1
    return toc.withColumn("page_end", F.coalesce(following, F.col(pages)).cast("int"))


def walk_outline(outline: DataFrame) -> DataFrame:
    """Parent paths of a flattened outline (``doc_id``, ``ord``, ``title``, ``level`` from 1): the last title of each higher level.

    One ordered pass with a stack per document, however deep its outline. Entries without a page are skipped first. An entry of NULL
    level stands outside the hierarchy: it has no parents and is nobody's.
    """
    flat = outline.where(F.col("page_start").isNotNull())
    names = flat.columns
    shape = flat.withColumn("parent_path", F.lit(None).cast("array<string>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, stack = None, []
        for batch in batches:
            paths = []
            for doc, title, level in zip(*(batch.column(names.index(c)).to_pylist() for c in ("doc_id", "title", "level"))):
                if doc != document:
                    document, stack = doc, []
                if level is None:
                    paths.append([])
                    continue
                while stack and stack[-1][0] >= level:
                    stack.pop()
                paths.append([t for _, t in stack])
                stack.append((level, title))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.string()))], [*names, "parent_path"])

    return flat.repartition("doc_id").sortWithinPartitions("doc_id", "ord").mapInArrow(run, shape)



def pack_pages(pages: DataFrame, doc: str, page: str, text: str, target: int = PACK_TOKENS) -> DataFrame:
    """Consecutive pages packed into sections that close when their tokens reach ``target``.

    ``doc_id``, ``section``, ``page_start``, ``page_end``, ``tokens``, ``heading``, ``element_id``, ``text``. Blank pages hold no
    text; an unfinished last section ends at the document's last page, blank or not. A document without text gives none.
    The fold runs over page sizes only; texts join their sections by page, so no document is held as one value before that.
    """
    base = pages.select(F.col(doc).alias("doc_id"), F.col(page).cast("int").alias("page"), strip(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    sized = base.withColumn("tokens", count_tokens(F.col("text")))
    whole = sized.groupBy("doc_id").agg(
        F.max("page").alias("last_page"),
        F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("page", "tokens")))).alias("sizes"),
    )

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def section_numbers(sizes: pa.Array) -> pa.Array:
        """The section of each page, and last the one that is still open."""
        out = []
        for one in sizes.to_pylist():
            ids, total = [0], 0
            for n in one:
                total += n
                ids.append(ids[-1] + (total >= target))
                total *= total < target
            out.append(ids)
        return pa.array(out, pa.list_(pa.int32()))

    folded = whole.withColumn("ids", section_numbers(F.col("sizes.tokens"))).withColumn("n", F.size("sizes"))
    zipped = F.arrays_zip(F.col("sizes.page").alias("page"), F.slice("ids", 1, F.col("n")).alias("section"))
    placed = folded.where("n > 0").select("doc_id", "last_page", F.element_at("ids", -1).alias("open"), F.explode(zipped).alias("z"))
    placed = placed.select("doc_id", "last_page", "open", F.col("z.page").alias("page"), F.col("z.section").alias("section"))
    full = placed.join(sized.where(F.col("text") != ""), ["doc_id", "page"])
    out = full.groupBy("doc_id", "section", "open", "last_page").agg(
        F.min("page").alias("page_start"),
        F.max("page").alias("_end"),
        F.sum("tokens").alias("tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"),
    )
    out = out.withColumn("page_end", F.when(F.col("section") == F.col("open"), F.col("last_page")).otherwise(F.col("_end")))
    return out.select(
        "doc_id", "section", "page_start", "page_end", "tokens", "text",
        F.format_string("Pages %d-%d", "page_start", "page_end").alias("heading"),
        F.format_string("p%04d", "page_start").alias("element_id"),
    )


def useful_figures(figures: DataFrame) -> DataFrame:
    """Figures that were routed and aren't decoration."""
    return figures.where(F.col("decision").isNotNull() & (F.col("decision") != "skip_decorative"))


def _block(page: Column, level: Column) -> Column:
    """The number of the block of ``4 ** level`` pages that a page lies in."""
    return F.call_function("shiftright", page.cast("bigint"), 2 * level)


def page_blocks(ranged: DataFrame) -> DataFrame:
    """Each range ``page_start`` to ``page_end`` (inclusive) as the fewest aligned blocks of 1, 4, 16, ... pages: adds ``_level`` and ``_block``.

    A page of the range lies in exactly one of them, and there are at most six of a level, however long the range is.
    """
    leveled = ranged.withColumn("_level", F.explode(F.array(*map(F.lit, BLOCK_LEVELS))))

    def whole(level: Column) -> tuple[Column, Column]:
        """The first block of this level that begins in the range, and the first that doesn't end in it."""
        ahead = F.call_function("shiftleft", F.lit(1).cast("bigint"), 2 * level) - 1
        return _block(F.col("page_start") + ahead, level), _block(F.col("page_end").cast("bigint") + 1, level)

    (first, after), (up, past) = whole(F.col("_level")), whole(F.col("_level") + 1)
    ends = leveled.select("*", first.alias("_first"), after.alias("_after"), (up * 4).alias("_up"), F.greatest(up * 4, past * 4).alias("_past")).where("_first < _after")
    left = [F.col("_first") + i for i in range(3)]
    right = [F.col("_after") - i for i in range(1, 4)]
    blocks = [F.when(b < F.least("_up", "_after"), b) for b in left] + [F.when(b >= F.col("_past"), b) for b in right]
    return ends.select(*ranged.columns, "_level", F.explode(F.array(*blocks)).alias("_block")).where("_block is not null")


def figures_in_sections(sections: DataFrame, figures: DataFrame) -> DataFrame:
    """Each section with the useful figures on its pages; a figure may lie in several sections.

    The range join is an equi-join on document and block: a section's blocks against the one block of each level around a figure's
    page. Its pairs are the result's rows, so neither long sections nor many of them on few figures cost more than their blocks. Spark
    doesn't see that rows multiply here and would broadcast a side, however large, so the join is a merge join.
    """
    ranged = sections.where(F.col("page_end") >= F.col("page_start")).select("doc_id", "ord", "page_start", "page_end")
    blocks = page_blocks(ranged).select("doc_id", "ord", "_level", "_block")
    found = useful_figures(figures).where("page is not null").select("doc_id", "page", "element_id", "decision", F.explode(F.array(*map(F.lit, BLOCK_LEVELS))).alias("_level"))
    placed = found.withColumn("_block", _block(F.col("page"), F.col("_level")))
    joined = blocks.hint("merge").join(placed, ["doc_id", "_level", "_block"])
    return joined.select("doc_id", "ord", "page", "element_id", "decision", figure_placeholder(F.col("page")).alias("description"))
