import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import layout as L
from folioflow.operators import blocks, images

WORD = "page int, ord int, text string, x0 double, top double, x1 double, bottom double, fontname string, size double"


@pytest.mark.parametrize(
    ("size", "bold", "n", "kind"),
    [(18.0, False, 5, "TITLE"), (17.9, False, 500, "SECTION_HEADER"), (14.0, False, 5, "SECTION_HEADER"), (10.0, True, 99, "SECTION_HEADER"), (12.0, True, 100, "SUBSECTION_HEAADER"), (11.9, True, 100, "TEXT"), (13.9, False, 5, "TEXT")],
)
def test_block_class(spark, size, bold, n, kind):
    assert spark.range(1).select(L.block_class(F.lit(size), F.lit(bold), F.lit(n))).first()[0] == kind


def test_word_blocks_boundaries(spark):
    w = [
        (1, 1, "a", 0.0, 0.0, 5.0, 10.0, "X-Bold", 10.0),
        (1, 2, "b", 5.0, 4.9, 9.0, 15.0, "X", 30.0),  # tops less than 5 apart
        (1, 3, "c", 0.0, 59.9, 5.0, 70.0, None, 30.0),  # gap 44.9 below 45
        (1, 4, "d", 0.0, 115.0, 5.0, 125.0, "X", 30.0),  # gap 45: new block
        (1, 5, "e", 0.0, 126.0, 5.0, 130.0, "X", 28.0),  # sizes differ by 2: new block
        (1, 6, "f", 0.0, 1.0, 5.0, 5.0, "X", 28.0),  # a negative gap goes on
        (2, 1, " ", 0.0, 0.0, 1.0, 1.0, "X", None),
    ]
    out = blocks.word_blocks(spark.createDataFrame(w, WORD), ["page"]).orderBy("page", "block").collect()
    assert [r["text"] for r in out] == ["a b c", "d", "e f"]
    assert out[0]["is_bold"] and out[0]["font_size"] == 30.0 and (out[0]["x0"], out[0]["bottom"]) == (0.0, 70.0)


def test_touching_boxes_overlap(spark):
    words = spark.createDataFrame([(1, 1, "in", 0.0, 0.0, 5.0, 5.0, "X", 9.0), (1, 2, "out", 10.1, 0.0, 12.0, 5.0, "X", 9.0), (2, 1, "other", 0.0, 0.0, 5.0, 5.0, "X", 9.0)], WORD)
    boxes = spark.createDataFrame([(1, 5.0, 5.0, 10.0, 9.0)], "page int, x0 double, top double, x1 double, bottom double")
    assert sorted(r["text"] for r in blocks.outside_boxes(words, boxes, ["page"]).collect()) == ["other", "out"]


def ppm(a):
    return b"P6\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def test_routing_decodes_only_what_is_open(spark):
    rng = np.random.default_rng(1)
    noisy = ppm(rng.integers(0, 256, (300, 500, 3)))
    white = ppm(np.full((150, 150, 3), 255))
    fig = "id int, width_px int, height_px int, bbox struct<x0:double,top:double,x1:double,bottom:double>, page_width double, page_height double, image binary"
    big, corner = (100.0, 200.0, 500.0, 600.0), (0.0, 0.0, 80.0, 100.0)
    rows = [
        (1, 79, 500, big, 600.0, 800.0, None),
        (2, 149, 149, corner, 600.0, 800.0, None),
        (3, 150, 150, big, 600.0, 800.0, white),
        (4, 500, 300, big, 600.0, 800.0, noisy),
        (5, 300, 300, big, 600.0, 800.0, b"broken"),
        (6, 400, 300, big, 0.0, 0.0, noisy),
    ]
    out = {r["id"]: r for r in images.route_images(spark.createDataFrame(rows, fig), "image").collect()}
    assert out[1]["routing"]["reason"].startswith("too_small: 79x500") and out[2]["routing"]["reason"] == "position_decorative: zone=header_corner"
    assert out[3]["routing"]["confidence"] == 0.8 and out[4]["routing"]["decision"] == "process_as_diagram"
    assert out[5]["routing"] is None and "ValueError" in out[5]["error"]
    assert out[6]["routing"]["decision"] == "skip_decorative"


def test_pixel_statistics():
    a = np.zeros((2, 2, 3), np.uint8)
    a[0, 0] = 255
    n, share, edge, white, variance = images.pixel_statistics(a)
    assert (n, share, white) == (2, 1.0, 0.25) and edge == 127.5 and variance == pytest.approx(a.var())


def test_page_ranges(spark):
    row = spark.range(1).select(L.parse_half_open(F.lit("[3,8)")).alias("a"), L.parse_half_open(F.lit("x")).alias("b"), L.to_half_open(L.page_range(F.lit(3), F.lit(7))).alias("c")).first()
    assert tuple(row["a"]) == (3, 7) and row["b"] is None and row["c"] == "[3,8)"
