"""Latest version of each keyed record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str, version: str, columns: dict[str, Column]) -> DataFrame:
    """One row per ``key``: that with the greatest ``version``; ``columns`` are computed before the shuffle.

    Rows without a key name nothing and are dropped. A NULL version ranks below any other; rows that
    tie are taken to be replays, and one of them is kept. An empty input gives an empty result. Only the key,
    the version and ``columns`` travel, so further columns of ``df``, whatever their names, don't matter.
    The rank filter also runs before the shuffle, so a key with very many rows sends one row per task.
    """
    narrow = df.select(F.col(key).alias("_key"), F.col(version).alias("_version"), *[c.alias(f"_c_{n}") for n, c in columns.items()])
    ranked = narrow.where(F.col("_key").isNotNull()).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_key").orderBy(F.col("_version").desc_nulls_last()))
    )
    return ranked.where("_rank = 1").select(F.col("_key").alias(key), *[F.col(f"_c_{n}").alias(n) for n in columns])
