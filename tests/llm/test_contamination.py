import pickle
import random

import pytest

from folioflow.llm import contamination as c

DOC, ITEM = "doc_id long, text string, item_id string", "item_id long, text string"


def brute(docs, items, run):
    out = set()
    for d, t, _ in docs:
        w = c.words(t or "")
        for i, x in items:
            v = c.words(x or "")
            n = min(run, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            if d is not None and n and any(tuple(w[k : k + n]) in windows for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(25)] + [(90, ""), (91, None), (92, "!!"), (93, "w1"), (94, "w1")]
    docs = []
    for d in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if d % 3 == 0:
            source = c.words(items[d % 25][1])
            start = rng.randrange(len(source))
            w[5:5] = source[start : start + 13]
        docs.append((d, "; ".join(w).upper() if d % 2 else " ".join(w), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (None, items[0][1], "x")]
    got = c.leaked_items(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), run=12).select("doc_id", "item_id").collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(docs, items, 12))


def test_positions_lie_in_the_original(spark):
    text = "İİ before. " + "One TWO, three" + " after"
    row = c.leaked_items(spark.createDataFrame([(1, text, "x")], DOC), spark.createDataFrame([(7, "one two three")], ITEM)).first()
    assert text[row["start"] : row["end"]] == "One TWO, three" and row["windows"] == 1


def test_items_beyond_the_bound_go_to_further_machines(spark):
    items = [(i, f"a{i} b{i} c{i} d{i}") for i in range(6)]
    built = c.machines(items, 2, most_bytes=32 * 12)
    assert len(built) > 1
    hits = {}
    for machine in built:
        hits |= machine.scan("x a4 b4 y b0 c0 d0")
    assert hits == {4: (1, 3, 1), 0: (4, 7, 2)} == c.machines(items, 2)[0].scan("x a4 b4 y b0 c0 d0")
    docs = spark.createDataFrame([(1, "x a4 b4 y b0 c0", "x"), (2, "nothing", "x")], DOC)
    rows = lambda most: sorted(tuple(r) for r in c.leaked_items(docs, spark.createDataFrame(items, ITEM), run=2, most_bytes=most).collect())
    assert rows(32 * 12) == rows(None) == [(1, 0, 10, 15, 1), (1, 4, 2, 7, 1)]
    with pytest.raises(ValueError):
        c.leaked_items(docs, spark.createDataFrame(items, ITEM), most=5)


def test_a_large_set_of_items_makes_a_small_machine():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(50_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=60))) for i in range(5000)]
    (machine,) = c.machines(items, 12)
    assert len(pickle.dumps(machine)) < 80_000_000
    text = " ".join(rng.choices(vocabulary, k=500)) + " " + " ".join(items[77][1].split()[20:33]) + " end"
    assert pickle.loads(pickle.dumps(machine)).scan(text) == {77: (500, 513, 2)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b")], ITEM)
    assert c.leaked_items(docs, items).count() == 0
    assert c.leaked_items(spark.createDataFrame([(1, "a b", "x")], DOC), items.limit(0)).count() == 0
