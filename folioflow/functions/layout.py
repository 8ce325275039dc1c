"""Geometry and image-routing expressions. Boxes are structs of x0, top, x1, bottom; y grows downward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The decisions a figure can be routed to, in the order of reports.
DECISIONS = ("skip_decorative", "process_as_chart", "process_as_diagram", "process_as_scan", "process_as_screenshot")


def block_class(size: Column, bold: Column, length: Column) -> Column:
    """Kind of a text block by font size, weight and length. The misspelt label is the emitted value."""
    return (
        F.when(size >= 18, "TITLE")
        .when((size >= 14) | (bold & (length < 100)), "SECTION_HEADER")
        .when((size >= 12) & bold, "SUBSECTION_HEAADER")
        .otherwise("TEXT")
    )


def boxes_overlap(a: Column, b: Column) -> Column:
    """Touching edges overlap."""
    return (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"]) & (a["top"] <= b["bottom"]) & (a["bottom"] >= b["top"])


def box_area(box: Column) -> Column:
    return (box["x1"] - box["x0"]) * (box["bottom"] - box["top"])


def size_info(width_px: Column, height_px: Column, box: Column, page_width: Column, page_height: Column) -> Column:
    """Pixel size, least dimension, share of the page (0 without a page area) and aspect (1 without a height)."""
    page = page_width * page_height
    return F.struct(
        width_px.cast("int").alias("width_px"),
        height_px.cast("int").alias("height_px"),
        F.least(width_px, height_px).cast("int").alias("min_dimension_px"),
        box_area(box).cast("double").alias("bbox_area"),
        F.when(page > 0, box_area(box) / page).otherwise(0.0).cast("double").alias("area_ratio"),
        F.when(height_px > 0, width_px.cast("double") / height_px).otherwise(1.0).alias("aspect_ratio"),
    )


def position_zone(box: Column, page_width: Column, page_height: Column) -> Column:
    """Where on the page the middle of the box lies; NULL on a page without extent."""
    x = F.try_divide((box["x0"] + box["x1"]) / 2, page_width)
    y = F.try_divide((box["top"] + box["bottom"]) / 2, page_height)
    return (
        F.when(x.isNull() | y.isNull(), F.lit(None))
        .when((y < 0.10) & ((x < 0.15) | (x > 0.85)), "header_corner")
        .when(y < 0.10, "header")
        .when(y > 0.90, "footer")
        .when((x < 0.10) | (x > 0.90), "margin")
        .otherwise("body")
    )


def early_routing(size: Column, zone: Column) -> Column:
    """The decision that needs no pixels, or NULL."""
    least = size["min_dimension_px"]
    small = (least < 80) | (size["area_ratio"] < 0.01)
    edge = zone.isin("header_corner", "footer") & (least < 150)
    return F.when(
        small,
        _routing("skip_decorative", F.format_string("too_small: %dx%d, area=%.4f", size["width_px"], size["height_px"], size["area_ratio"]), 0.95, "size"),
    ).when(edge, _routing("skip_decorative", F.concat(F.lit("position_decorative: zone="), zone), 0.85, "size", "position"))


def visual_routing(size: Column, visual: Column) -> Column:
    """The decision on a figure that passed :func:`early_routing`; conditions in order, the first that holds decides."""
    least, seen = size["min_dimension_px"], ("size", "position", "visual")
    colours, share = visual["unique_colors"], visual["top_5_color_share"]
    return (
        F.when(
            (colours < 8) & (least < 200),
            _routing("skip_decorative", F.format_string("few_colors_and_small: colors=%d, dim=%d", colours, least), 0.80, *seen),
        )
        .when((share > 0.95) & (least < 300), _routing("skip_decorative", F.format_string("uniform_colors: top_5_share=%.2f", share), 0.75, *seen))
        .when((visual["edge_density"] > 15) & (visual["whitespace_ratio"] > 0.4), _routing("process_as_scan", F.lit("high_text_density_pattern"), 0.75, *seen))
        .when((size["aspect_ratio"] > 1.3) & (size["area_ratio"] > 0.1), _routing("process_as_diagram", F.lit("large_wide_image_in_body"), 0.70, *seen))
        .otherwise(_routing("process_as_chart", F.lit("body_image_passed_all_filters"), 0.60, *seen))
    )


def _routing(decision: str, reason: Column, confidence: float, *filters: str) -> Column:
    return F.struct(
        F.lit(decision).alias("decision"), reason.alias("reason"), F.lit(confidence).alias("confidence"), F.array(*map(F.lit, filters)).alias("filters_evaluated")
    )


def figure_placeholder(page: Column) -> Column:
    """What stands for a figure until something describes it."""
    return F.format_string("[Figure on page %d: would be described by VLM in production]", page)


def page_range(lo: Column, hi: Column) -> Column:
    """Inclusive range; NULL unless both ends are known."""
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))


def parse_half_open(text: Column) -> Column:
    """Inclusive range from the text form of a half-open one, ``[a,b)``; NULL if it isn't two numbers."""
    lo = F.regexp_extract(text, r"^\[\s*(-?\d+)\s*,\s*(-?\d+)\s*\)$", 1)
    hi = F.regexp_extract(text, r"^\[\s*(-?\d+)\s*,\s*(-?\d+)\s*\)$", 2)
    return F.when(lo != "", F.struct(lo.try_cast("int").alias("lo"), (hi.try_cast("int") - 1).alias("hi")))


def to_half_open(pages: Column) -> Column:
    return F.when(pages.isNotNull(), F.format_string("[%d,%d)", pages["lo"], pages["hi"] + 1))
