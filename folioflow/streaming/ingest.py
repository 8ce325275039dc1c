"""Structured Streaming: new chunks into the keyed table, and windowed counts over logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.embedding import last_of_key
from folioflow.operators.upsert import upsert_chunks
from folioflow.sources.files import read_or_empty, swap_table
from folioflow.storage import shared_dir


def upsert_stream(spark: SparkSession, source: str, schema: str, target: str, target_schema: str, checkpoint: str, sequence: str = "embedded_at"):
    """A query that upserts chunk files as they arrive, once each, and ends when there are none left.

    A batch that is repeated after a failure changes nothing the second time: its rows equal what is stored. Within a batch the
    row written last counts.
    """

    def merge(batch: DataFrame, _: int) -> None:
        stored = read_or_empty(spark, target, target_schema)
        once = last_of_key(batch, "chunk_id", sequence)
        swap_table(upsert_chunks(stored, once, F.current_timestamp()).drop("action"), target)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind; those later than the watermark are dropped once their window is closed."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, size), kind)
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("window.start").alias("window_start"), kind, "n", "total")
    )


def deduplicated(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote as a batch table."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def appended(stream: DataFrame) -> DataFrame:
    """All rows a stream emits from what is there, in the shared folder."""
    root = f"{shared_dir(stream.sparkSession)}/folioflow/stream-{uuid.uuid4().hex}"
    return run_to_table(stream, f"{root}/out", f"{root}/checkpoint")


def final_state(stream: DataFrame) -> DataFrame:
    """All rows a stream's aggregate holds after reading what is there, written batch by batch to the shared folder."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/folioflow/stream-{uuid.uuid4().hex}"
    last = {}

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{root}/batch-{number}"
        batch.write.mode("overwrite").parquet(path)
        last["path"] = path

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(last["path"]) if last else spark.createDataFrame([], stream.schema)
