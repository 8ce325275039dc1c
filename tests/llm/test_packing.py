import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import packing

SCHEMA = "doc_id long, text string, piece string"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plans_place_every_text_once(lengths):
    h = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, int)
    plan = packing.plan(h, 64)
    used = np.zeros(65, int)
    for content, n in plan:
        assert n > 0 and sum(k * m for k, m in content.items()) <= 64
        for k, m in content.items():
            used[k] += n * m
    assert used.tolist() == h.tolist()


def test_fit_reproduces_a_histogram_of_patterns():
    h = np.zeros(65)
    h[[10, 20, 34]] = 100
    h[32] = 50
    triples, times = packing.patterns(np.flatnonzero(h), 64)
    x = packing.fit(h, triples, times)
    assert (x >= 0).all()
    plan = packing.plan(h.astype(int), 64)
    assert sum(n for _, n in plan) == 125  # nothing left unused


def test_plans_waste_little():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(5.5, 0.9, 30_000).astype(int), 1, 2048)
    plan = packing.plan(np.bincount(lengths, minlength=2049), 2048)
    n = sum(n for _, n in plan)
    assert lengths.sum() / (n * 2048) > 0.995


def test_plans_of_large_collections_stay_small_and_full():
    rng = np.random.default_rng(2)
    shape = np.bincount(np.clip(rng.lognormal(5.5, 0.9, 10_000_000).astype(int), 1, 2048), minlength=2049)
    for times in (1, 1000):
        packed = packing.plan(shape * times, 2048)
        found = packing.steps(packed)
        tokens = int((shape * times * np.arange(2049)).sum())
        assert len(found.key) <= 3 * packing.SUPPORT * 2048 + 4096 * 4 and tokens / (found.sequences * 2048) > 0.999
        patterns = sum(n for content, n in packed if sum(k * m for k, m in content.items()) == 2048)
        assert patterns > 0.98 * found.sequences


def test_each_text_finds_one_place():
    rng = np.random.default_rng(3)
    h = np.bincount(np.clip(rng.lognormal(2.5, 0.8, 20_000).astype(int), 1, 64), minlength=65)
    found = packing.steps(packing.plan(h, 64))
    length = np.repeat(np.arange(65), h)
    rank = np.concatenate([np.arange(n) for n in h])
    sequence, position = found.find(length, rank)
    assert (position >= 0).all() and (position + length <= 64).all() and sequence.max() < found.sequences
    order = np.lexsort((position, sequence))
    same = sequence[order][1:] == sequence[order][:-1]
    assert ((position + length)[order][:-1] <= position[order][1:])[same].all()


def test_pack(spark):
    rows = [(i, "word " * (i % 50), "x") for i in range(200)] + [(1000, "several different words of text " * 1200, "x"), (1001, None, "x"), (1002, "", "x"), (None, "text", "x"), (5, "again", "x")]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), capacity=256).collect()
    encode = packing.tokenizer(packing.TOKENIZERS, "byte_bpe_50k").encode_ordinary
    want = sum(len(encode(t)) for i, t, _ in rows if i is not None and t)
    assert sum(r["n_tokens"] for r in out) == want
    filled = {}
    for r in out:
        filled.setdefault(r["sequence_id"], []).append((r["position"], r["n_tokens"]))
    for spans in filled.values():
        spans.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= 256
    pieces = sorted((r["piece"], r["token_start"], r["n_tokens"]) for r in out if r["doc_id"] == 1000)
    assert [p[0] for p in pieces] == list(range(len(pieces))) and all(s == k * 256 for k, s, _ in pieces) and all(n == 256 for *_, n in pieces[:-1])
    assert {r["doc_id"] for r in out if r["piece"] > 0} == {1000} and len([r for r in out if r["doc_id"] == 5]) == 2


def test_many_texts_of_one_length(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("").alias("piece"))
    out = packing.pack(df, capacity=8)
    assert out.count() == 5000 and out.groupBy("sequence_id").count().agg(F.max("count")).first()[0] == 2
    assert out.select("sequence_id", "position").distinct().count() == 5000


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
