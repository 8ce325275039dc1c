"""Whether a corpus is fit to be searched: everything that is wrong with it, found in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.storage import filesystem


def model_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("embedding_model").agg(F.count("*").alias("n_chunks"))


def dimensions(chunks: DataFrame) -> DataFrame:
    """One row: least and greatest vector length, vectors and rows without one. All rows are looked at, not one."""
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return chunks.agg(F.min(size).alias("min_dim"), F.max(size).alias("max_dim"), F.count("embedding").alias("n_vectors"), F.count_if(F.col("embedding").isNull()).alias("n_missing"))


def lengths(chunks: DataFrame) -> DataFrame:
    """``embedding_model``, ``length`` (NULL: no vector), ``n``: a row for each model and vector length there is."""
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return chunks.groupBy("embedding_model", size.alias("length")).agg(F.count("*").alias("n"))


@dataclass
class Report:
    """What :func:`inspect` found. ``problems`` is empty for a fit corpus; its order is that of severity."""

    chunks: dict[str | None, int] = field(default_factory=dict)
    wrong_length: dict[int, int] = field(default_factory=dict)
    without_vector: int = 0
    has_index: bool = False
    problems: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.problems


def inspect(chunks: DataFrame | None, model: str, dimension: int, index: str | None = None) -> Report:
    """A corpus is unfit if it isn't there, is empty, holds nothing of ``model``, or any vector of ``model`` whose length isn't ``dimension``.

    Chunks without a vector are counted, not held against it. ``index`` is the folder of an index, looked up, not believed.
    """
    report = Report()
    if chunks is None:
        report.problems.append("there is no table of chunks")
        return report
    if index:
        fs, where = filesystem(chunks.sparkSession, index)
        report.has_index = fs.exists(where)
    for row in lengths(chunks).collect():  # a row per model and length
        name, length, n = row
        report.chunks[name] = report.chunks.get(name, 0) + n
        if name == model and length is None:
            report.without_vector += n
        elif name == model and length != dimension:
            report.wrong_length[length] = n
    if not report.chunks:
        report.problems.append("the table of chunks has no rows")
    elif model not in report.chunks:
        report.problems.append(f"no chunk was embedded by {model}, only by {', '.join(sorted(map(str, report.chunks)))}")
    if report.wrong_length:
        found = ", ".join(f"{n} of {length}" for length, n in sorted(report.wrong_length.items()))
        report.problems.append(f"vectors should have {dimension} numbers; there are {found}")
    return report


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
