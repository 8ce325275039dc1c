import random

import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import neardup


def links(spark, rows, **more):
    df = spark.createDataFrame(rows, "id string, text string, cls_a string")
    members = df.select("id", *neardup.class_of(F.col("text")))
    texts = df.select(*neardup.class_of(F.col("text")), "text")
    return members, texts


def exact(rows, width, threshold):
    sets = {}
    for i, t, _ in rows:
        w = neardup.words(t or "")
        if i is not None and len(w) >= width:
            sets[i] = set(zip(*(w[k:] for k in range(width))))
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        rows.append((f"a{i}", " ".join(base), "x"))
        for j in range(rng.randint(0, 3)):
            edited = list(base)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((f"b{i}_{j}", " ".join(edited).upper() if rng.random() < 0.3 else ", ".join(edited), "x"))
    return rows


def test_all_pairs_against_brute_force(spark):
    rows = corpus() + [("null", None, "x"), (None, "some words here now", "x"), ("short", "one two", "x"), ("short2", "one two", "x"), ("empty", "", "x"), ("long", "lorem ipsum " * 20000, "x")]
    got = neardup.near_duplicate_links(*links(spark, rows), width=3, threshold=0.6)
    found = [tuple(r) for r in got.collect()]
    want = exact(rows, 3, 0.6)
    assert len(found) == len(set(found)) and set(found) <= want
    assert len(want - set(found)) <= 0.01 * len(want)


def test_hot_buckets_are_cut_into_blocks_without_loss(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # all alike, none the same
        edited = list(base)
        edited[rng.randrange(60)] = f"x{i}"
        rows.append((f"id{i:03}", " ".join(edited), "x"))
    pairs, _ = neardup.similar_classes(links(spark, rows)[1], width=3, threshold=0.6, bucket_size=16)
    assert pairs.count() == len(exact(rows, 3, 0.6)) == 150 * 149 // 2


def test_hot_buckets_are_joined_where_they_are_too_many_to_send_round(spark):
    rows = corpus(40, seed=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs, _ = neardup.similar_classes(links(spark, rows)[1], width=3, threshold=0.6, bucket_size=1)  # every sampled bucket is cut
        got = pairs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    distinct = {t: i for i, t, _ in rows}
    assert got == len(exact([(i, t, "x") for t, i in distinct.items()], 3, 0.6))


def test_copies_are_all_linked_on_both_sides_of_a_block(spark):
    copy, near = "the same words again and again and then some", "the same words again and again and then some more"
    rows = [(f"c{i:04}", copy, "x") for i in range(1000)] + [("d0", near, "x"), ("d1", near, "x"), ("d1", near, "x")]
    rows += [(f"s{i}", "too short", "x") for i in range(50)]
    for block in (16, 4096):
        got = [tuple(r) for r in neardup.near_duplicate_links(*links(spark, rows), width=3, threshold=0.6, block=block).collect()]
        assert len(got) == len(set(got)) == 1002 * 1001 // 2 and all(a < b for a, b in got)


def test_texts_that_share_half_a_class_are_two(spark):
    base = [f"w{i}" for i in range(30)]
    rows = [(1, 1, " ".join(base)), (1, 2, " ".join(f"y{i}" for i in range(30))), (2, 3, " ".join(base[1:])), (3, 4, " ".join(f"y{i}" for i in range(1, 30)))]
    pairs, _ = neardup.similar_classes(spark.createDataFrame(rows, "cls long, k2 long, text string"), width=3, threshold=0.6)
    assert {(r["a"], r["a2"], r["b"], r["b2"]) for r in pairs.collect()} == {(1, 1, 2, 3), (1, 2, 3, 4)}


def test_groups_and_chains(spark):
    w = [f"w{i}" for i in range(200)]
    rows = [(f"k{i}", " ".join(w[i * 3 : i * 3 + 60]), "x") for i in range(12)] + [("alone", "something else entirely is said here", "x")]
    out = {r["id"]: r for r in neardup.near_duplicate_groups(*links(spark, rows), width=5, threshold=0.8).collect()}
    assert {out[f"k{i}"]["group"] for i in range(12)} == {"k0"} and out["alone"]["group"] == "alone" and out["alone"]["n_links"] == 0


def test_links_are_counted_in_full_in_large_classes(spark):
    copy, near, short = "the same words again and again and then some", "the same words again and again and then some more", "too short"
    n = 300
    rows = [(f"c{i:03}", copy, "x") for i in range(n)] + [("d0", near, "x"), ("d1", near, "x"), ("alone", "something else entirely is said here", "x")]
    rows += [(f"s{i:03}", short, "x") for i in range(n)]
    got = {r["id"]: r["n_links"] for r in neardup.near_duplicate_groups(*links(spark, rows), width=3, threshold=0.6).collect()}
    want = dict.fromkeys((r[0] for r in rows), 0)
    for pair in exact(rows, 3, 0.6):
        for i in pair:
            want[i] += 1
    assert got == want and got["c001"] == n + 1 and got["d0"] == n + 1 and got["s000"] == 0


def test_long_chain_components(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(100) if i != 50], "id_a string, id_b string")
    got = {r["id"]: r["group"] for r in neardup.components(edges).collect()}
    assert len(got) == 101 and {got[f"n{i:03}"] for i in range(51)} == {"n000"} and {got[f"n{i:03}"] for i in range(51, 101)} == {"n051"}


def test_empty_tables(spark):
    assert neardup.near_duplicate_links(*links(spark, []), width=3, threshold=0.6).count() == 0
    assert neardup.near_duplicate_groups(*links(spark, [("a", None, "x")])).count() == 0


def test_pruning_keeps_the_chosen_miss_probability():
    least = neardup.least_matches(0.6, 1e-4)
    rng = np.random.default_rng(3)
    bits = rng.random((200_000, neardup.BITS)) < 0.8  # bits agree with probability (1 + 0.6) / 2
    kept = np.ones(len(bits), bool)
    for k, need in enumerate(least):
        kept &= bits[:, : (k + 1) * neardup.BATCH].sum(1) >= need
    assert kept.mean() > 0.998
    assert (rng.random((100_000, neardup.BITS)) < 0.51).sum(1).max() < 110 and least[-1] > 70
