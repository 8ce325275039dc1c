import hashlib

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "n"), [("", 0), ("abc", 0), ("abcd", 1), ("é😀ab", 1), (None, None)])
def test_tokens_are_quarters_of_code_points(spark, text, n):
    assert one(spark, T.count_tokens(F.lit(text).cast("string"))) == n


def test_slug_is_cut_after_trimming(spark):
    assert one(spark, T.slugify(F.lit("  Hello, World! "))) == "hello_world"
    long = "a" * 49 + " b"
    assert one(spark, T.slugify(F.lit(long))) == "a" * 49 + "_"


def test_chunk_id_numbers_above_999_are_kept(spark):
    path = "One > Two words"
    made = one(spark, T.chunk_id(F.lit("doc"), F.lit(path), F.lit(1234)))
    assert made == f"doc__two_words__{hashlib.sha256(path.encode()).hexdigest()[:8]}__chunk1234"
    assert one(spark, T.chunk_id(F.lit("doc"), F.lit("x"), F.lit(7))).endswith("__chunk007")


def test_title_keeps_inner_capitals(spark):
    assert one(spark, T.pretty_title(F.lit("building-ML_apps"))) == "Building ML apps"


def test_hashes(spark):
    assert one(spark, T.content_hash(F.lit("x"))) == hashlib.sha256(b"x").hexdigest()[:16]
    assert one(spark, T.cache_key(F.lit("x"), F.lit("m"))) == hashlib.sha256(b"m::x").hexdigest()[:32]


def test_breadcrumb_only_below_another_section(spark):
    assert one(spark, T.breadcrumb(F.lit("A"), F.lit("A"))) == ""
    assert one(spark, T.breadcrumb(F.lit("A > B"), F.lit("B"))) == "_Section: A > B_\n\n"


def test_preview(spark):
    assert one(spark, T.preview(F.lit("a\nb"), 240, dots=True)) == "a b"
    cut = one(spark, T.preview(F.lit("x" * 241), 240, dots=True))
    assert len(cut) == 240 and cut.endswith("...")


def test_terms_drop_stop_words(spark):
    assert one(spark, T.terms(F.lit("The Cache, and the  LOAD-balancer"))) == ["cache", "load", "balancer"]
    assert one(spark, T.terms(F.lit(None).cast("string"))) == []
