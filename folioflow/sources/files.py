"""Files in and out: documents through pluggable extractors, JSON and JSON lines, keyed tables, vector collections."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow import schemas
from folioflow.commits import CommitLog
from folioflow.functions.vectors import cosine_to
from folioflow.storage import filesystem

#: From the bytes of a file to the texts of its pages.
Extractor = Callable[[bytes], list[str]]


def plain_pages(data: bytes) -> list[str]:
    """Pages of a text file are separated by form feeds. Extractors of other formats are given by the caller; a file that isn't text is refused."""
    if data[:5] == b"%PDF-" or b"\0" in data[:1024]:
        raise ValueError("not a text file; give an extractor of its format")
    return data.decode("utf-8", "replace").split("\f")


def ensure_folder(path: str | Path) -> Path:
    folder = Path(path)
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def read_pages(spark: SparkSession, folder: str, pattern: str = "*.txt", extract: Extractor = plain_pages) -> DataFrame:
    """``source_file``, ``page`` from 1, ``text``, ``total_pages``, ``error``: the pages of the files directly in a folder.

    Files are read and taken apart where they lie; a file whose extraction fails is one row with the error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    schema = "source_file string, page int, text string, total_pages int, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("source_file", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("total_pages", pa.int32()), ("error", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = os.path.basename(path)
                try:
                    texts = extract(content)
                    rows = [(name, i, t or "", len(texts), None) for i, t in enumerate(texts, 1)]
                except Exception as e:
                    rows = [(name, None, None, 0, f"{type(e).__name__}: {e}"[:200])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return files.mapInArrow(run, schema)


def extract_rows(spark: SparkSession, folder: str, pattern: str, extract: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Rows of any shape out of the files of a folder: words, tables, figures, outlines, metadata.

    ``extract`` opens a file's bytes once and gives dicts with the fields of ``schema``; ``source_file`` and ``error`` are
    added. A file that can't be read is one row with the error and no fields.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    shape = spark.createDataFrame([], f"source_file string, {schema}, error string").schema
    names = shape.names[1:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(shape)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = os.path.basename(path)
                try:
                    rows = [{"source_file": name, "error": None} | {n: r.get(n) for n in names} for r in extract(content)]
                except Exception as e:
                    rows = [{"source_file": name, "error": f"{type(e).__name__}: {e}"[:200]} | dict.fromkeys(names)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return files.mapInArrow(run, shape)


def document_metadata(spark: SparkSession, folder: str, pattern: str, extract: Callable[[bytes], dict]) -> DataFrame:
    """``source_file``, ``page_count``, ``author``: unknown authors are "Unknown", and so is everything of an unreadable file."""
    rows = extract_rows(spark, folder, pattern, lambda data: [extract(data)], "page_count int, author string")
    return rows.select("source_file", "page_count", F.coalesce(F.nullif("author", F.lit("")), F.lit("Unknown")).alias("author"))


def render_regions(figures: DataFrame, files: DataFrame, render: Callable[[bytes, list[tuple]], list[bytes]]) -> DataFrame:
    """Adds ``image``: the regions (``page``, ``bbox``) of each document drawn by ``render``, which opens a document once.

    ``files`` has ``source_file`` and ``content``. Documents that can't be drawn leave NULL images.
    """
    grouped = figures.groupBy("source_file").agg(F.collect_list(F.struct("element_id", "page", "bbox")).alias("regions")).join(files.select("source_file", "content"), "source_file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, regions, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    drawn = render(content, [(r["page"], tuple(r["bbox"].values())) for r in regions])
                except Exception:
                    drawn = [None] * len(regions)
                rows = [{"source_file": name, "element_id": r["element_id"], "image": d} for r, d in zip(regions, drawn, strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("source_file", pa.string()), ("element_id", pa.string()), ("image", pa.binary())]))

    images = grouped.mapInArrow(run, "source_file string, element_id string, image binary")
    return figures.join(images, ["source_file", "element_id"], "left")


def select_files(names: DataFrame, column: str, contains: str | None = None, loaded: DataFrame | None = None) -> DataFrame:
    """File names with a substring, whatever its case, whose stem isn't loaded yet, in order."""
    out = names
    if contains:
        out = out.where(F.contains(F.lower(column), F.lit(contains.lower())))
    if loaded is not None:
        stem = F.regexp_replace(F.col(column), r"\.[^.]*$", "")
        out = out.withColumn("_stem", stem).join(loaded.select(F.col("doc_id").alias("_stem")), "_stem", "left_anti").drop("_stem")
    return out.orderBy(column)


def non_empty_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.withColumn(text, F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")).where(F.length(text) > 0)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed one fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, schemas.CHUNKS)


def read_embedded(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, schemas.EMBEDDED)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def open_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of :func:`swap_table` as it is now; None before the first swap."""
    return CommitLog(spark, path).table("table")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    found = open_table(spark, path)
    return spark.createDataFrame([], schema) if found is None else found


def swap_table(df: DataFrame, path: str) -> None:
    """Replace a table by one commit: readers see the old one or the new one, at every moment one of them. ``df`` may read the table
    itself, and who reads the version before keeps its files until the swap after the next. One writer at a time."""
    log = CommitLog(df.sparkSession, path)
    log.publish({"table": df})
    log.vacuum(keep=2)


def write_json(spark: SparkSession, path: str, document) -> None:
    """A whole-file JSON document, of a size that the driver holds, replaced with one rename."""
    fs, where = filesystem(spark, path)
    _, fresh = filesystem(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(json.dumps(document, ensure_ascii=False, indent=2, default=str).encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    options = getattr(jvm.org.apache.hadoop.fs.Options, "Rename")
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(fresh, where, over)


def write_metrics(spark: SparkSession, path: str, metrics: dict, errors: DataFrame, message: str = "error") -> dict:
    """A run's numbers with how many records failed and, in the order of their text, the first ten messages."""
    first = [r[0] for r in errors.where(F.col(message).isNotNull()).select(message).orderBy(message).limit(10).collect()]
    document = metrics | {"failed": errors.where(F.col(message).isNotNull()).count(), "errors": first}
    write_json(spark, path, document)
    return document


class VectorCollection:
    """A named table of chunks with vectors in a folder; named the same when written and read."""

    def __init__(self, spark: SparkSession, folder: str, name: str = "chunks"):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/{name}"

    def create(self, chunks: DataFrame) -> int:
        """Write the collection, replacing it, every chunk of it. An empty input is an error."""
        if chunks.isEmpty():
            raise ValueError("no chunks to index")
        swap_table(chunks, self.path)
        return self.load().count()

    @contextmanager
    def temporary(self, chunks: DataFrame, view: str) -> Iterator[DataFrame]:
        """A cached view instead of a table, released at the end of the block. An empty input is an error."""
        if chunks.isEmpty():
            raise ValueError("no chunks to index")
        kept = chunks.cache()
        kept.createOrReplaceTempView(view)
        try:
            yield kept
        finally:
            self.spark.catalog.dropTempView(view)
            kept.unpersist()

    def load(self) -> DataFrame:
        found = open_table(self.spark, self.path)
        if found is None:
            raise FileNotFoundError(f"no collection at {self.path}")
        return found

    def search(self, vector: list[float], k: int = 3) -> DataFrame:
        """The ``k`` nearest chunks with their cosine distance, nearest first."""
        scored = self.load().withColumn("distance", F.round(1 - cosine_to(vector)(F.col("embedding")), 6))
        return scored.where(F.col("distance").isNotNull()).orderBy("distance", "chunk_id").limit(k)

    def stats(self) -> dict:
        found = open_table(self.spark, self.path)
        return {"count": 0 if found is None else found.count(), "path": self.path}

    def delete(self) -> None:
        fs, where = filesystem(self.spark, self.path)
        fs.delete(where, True)


def results_json(rows: DataFrame) -> Column:
    """A retrieval result as JSON with its twelve keys, NULLs included."""
    keys = ("chunk_id", "doc_id", "text", "section_heading", "section_path", "page_range", "vector_similarity", "keyword_score", "combined_score", "rerank_score", "rank", "embedding_model")
    return F.to_json(F.struct(*[F.col(k) for k in keys if k in rows.columns]), {"ignoreNullFields": "false"})
