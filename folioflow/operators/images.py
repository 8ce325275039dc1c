"""Figures: pixel statistics and routing, cheap tests first."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.layout import early_routing, position_zone, size_info, visual_routing

VISUAL = "struct<unique_colors:int,top_5_color_share:double,edge_density:double,whitespace_ratio:double,pixel_variance:double>"


def decode_raw(data: bytes) -> np.ndarray:
    """Height, width and RGB pixels of a binary PPM (P6) image; other formats need a decoder of their own."""
    head = io.BytesIO(data)
    if head.readline().strip() != b"P6":
        raise ValueError("not a binary PPM")
    width, height = map(int, head.readline().split())
    head.readline()
    return np.frombuffer(head.read(), np.uint8, width * height * 3).reshape(height, width, 3)


def pixel_statistics(rgb: np.ndarray) -> tuple[int, float, float, float, float]:
    """Colours in steps of 32, share of the five commonest, mean step of grey between neighbours, share of near-white, variance."""
    codes = (rgb.reshape(-1, 3) >> 5).astype(np.int32) @ np.array([64, 8, 1], np.int32)
    counts = np.bincount(codes, minlength=512)
    counts = np.sort(counts[counts > 0])[::-1]
    grey = rgb.mean(axis=2)
    steps = [np.abs(np.diff(grey, axis=a)) for a in (1, 0)]
    edge = sum(float(s.mean()) if s.size else 0.0 for s in steps) / 2
    white = float((rgb.min(axis=2) > 240).mean())
    return len(counts), float(counts[:5].sum() / counts.sum()), edge, white, float(rgb.var())


def measure_pixels(figures: DataFrame, image: str, decode: Callable[[bytes], np.ndarray] = decode_raw) -> DataFrame:
    """Adds ``visual`` and ``error``: statistics of the decoded image, or why there are none."""
    names = figures.columns
    kind = figures.withColumn("visual", F.lit(None).cast(VISUAL)).withColumn("error", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("unique_colors", "top_5_color_share", "edge_density", "whitespace_ratio", "pixel_variance")
        types = (pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64())
        shape = pa.struct(list(zip(fields, types)))
        for batch in batches:
            stats, errors = [], []
            for data in batch.column(names.index(image)).to_pylist():
                try:
                    stats.append(dict(zip(fields, pixel_statistics(decode(data)))))
                    errors.append(None)
                except Exception as e:  # a broken image is one figure's error, not the job's
                    stats.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stats, shape), pa.array(errors, pa.string())], [*names, "visual", "error"])

    return figures.mapInArrow(run, kind)


def prepare_figures(figures: DataFrame) -> DataFrame:
    """Adds ``size`` and ``zone`` from pixel size, box and page size."""
    return figures.withColumn("size", size_info(F.col("width_px"), F.col("height_px"), F.col("bbox"), F.col("page_width"), F.col("page_height"))).withColumn(
        "zone", position_zone(F.col("bbox"), F.col("page_width"), F.col("page_height"))
    )


def route_measured(figures: DataFrame) -> DataFrame:
    """Adds ``routing`` to prepared figures whose ``visual`` is known already: no Python, one pass."""
    return figures.withColumn("routing", F.coalesce(early_routing(F.col("size"), F.col("zone")), visual_routing(F.col("size"), F.col("visual"))))


def route_images(figures: DataFrame, image: str, decode: Callable[[bytes], np.ndarray] = decode_raw) -> DataFrame:
    """Adds ``routing``, ``visual`` and ``error``; only figures that size and position don't decide are decoded."""
    ready = prepare_figures(figures).withColumn("routing", early_routing(F.col("size"), F.col("zone")))
    settled = ready.where(F.col("routing").isNotNull()).withColumn("visual", F.lit(None).cast(VISUAL)).withColumn("error", F.lit(None).cast("string"))
    open_ = measure_pixels(ready.where(F.col("routing").isNull()).drop("routing"), image, decode)
    open_ = open_.withColumn("routing", F.when(F.col("visual").isNotNull(), visual_routing(F.col("size"), F.col("visual"))))
    return settled.unionByName(open_)


def explode_figures(pages: DataFrame) -> DataFrame:
    """Figures out of nested pages: one row per element of type FIGURE."""
    flat = pages.select("page_number", "width", "height", F.explode("elements").alias("element"))
    return flat.where(F.col("element.type") == "FIGURE").select("page_number", F.col("width").alias("page_width"), F.col("height").alias("page_height"), "element.*")
