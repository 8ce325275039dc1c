"""Shared scratch space: where lineage is cut without tying a result to one executor's disk."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    made = "file://" + tempfile.mkdtemp(prefix="folioflow-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed with what is in it when the driver exits."""
    path = f"{shared_dir(spark)}/folioflow/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as a compressed table in the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation, and a Python stage that feeds
    several consumers runs once. The table is removed when the driver exits.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(df: DataFrame | None) -> None:
    """Remove a table of :func:`materialize` that nothing reads any more, before the driver exits."""
    path = getattr(df, "_folder", None)
    if path:
        fs, where = filesystem(df.sparkSession, path)
        fs.delete(where, True)
        _written.remove((df.sparkSession, path))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over all cores, for heavy work per row: a small table lies in fewer files than there are cores.

    A table with as many partitions as cores stays as it is, so large ones aren't shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            fs, where = filesystem(spark, path)
            fs.delete(where, True)
        except Exception:  # the session is already gone; the folder belongs to the cluster
            pass
