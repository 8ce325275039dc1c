import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import neighbours

SCHEMA = "id string, v array<float>, vec string"


def brute(rows, k, floor=-1.0):
    ids = np.array(sorted(r[0] for r in rows))
    by = {r[0]: r[1] for r in rows}
    x = np.array([by[i] for i in ids], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    out = set()
    for i, row in enumerate(s):
        for j in np.argsort(-row, kind="stable")[:k]:
            if row[j] >= floor:
                out.add((ids[i], ids[j]))
    return out


def clusters(n, dim, seed, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), dim))
    x = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, dim))
    return [(f"v{i:05}", (x[i] * rng.uniform(0.1, 9)).astype(float).tolist(), "other") for i in range(n)]


def found(df):
    return {(r["id"], r["neighbour"]) for r in df.collect()}


def test_small_collections_are_exact(spark):
    rows = clusters(60, 8, 1)
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), "id", "v", dim=8, k=5, probes=neighbours.ALL)
    assert found(got) == brute(rows, 5)
    ranks = [r["rank"] for r in got.where("id = 'v00000'").orderBy("rank").collect()]
    assert ranks == [1, 2, 3, 4, 5]


def test_recall_of_close_neighbours(spark):
    rows = clusters(4000, 16, 2)
    want = brute(rows, 5, 0.85)
    got = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA).repartition(4), "id", "v", dim=16, k=5, floor=0.85))
    assert len(want & got) >= 0.97 * len(want)


def test_recall_over_all_distances_with_every_list(spark):
    rows = clusters(3000, 16, 3, spread=1.0)
    want = brute(rows, 5)
    asked = lambda i: F.pmod(F.crc32(i), F.lit(10)) == 0
    got = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), "id", "v", dim=16, k=5, probes=neighbours.ALL, asked=asked))
    sought = {i for i, _ in got}
    want = {p for p in want if p[0] in sought}
    assert 200 < len(sought) < 400 and len(want & got) >= 0.9 * len(want)


def test_copies_and_scaled_copies_tie_by_id(spark):
    rows = [(f"c{i:03}", [1.0, 2.0, 3.0], "x") for i in range(40)] + [("s", [2.0, 4.0, 6.0], "x"), ("near", [1.0, 2.0, 3.1], "x"), ("far", [-1.0, 0.0, 0.5], "x")]
    got = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), "id", "v", dim=3, k=5, probes=neighbours.ALL))
    assert got == brute(rows, 5)


def test_scaled_copies_of_smaller_id_reach_every_copy(spark):
    rows = [(f"c{i:03}", [1.0, 2.0, 3.0], "x") for i in range(40)] + [("a", [2.0, 4.0, 6.0], "x"), ("c0015", [4.0, 8.0, 12.0], "x"), ("far", [-1.0, 0.0, 0.5], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(neighbours.nearest(df, "id", "v", dim=3, k=5, probes=neighbours.ALL)) == brute(rows, 5)
    late = neighbours.nearest(df, "id", "v", dim=3, k=5, probes=neighbours.ALL, asked=lambda i: i == "c030")
    assert found(late) == {p for p in brute(rows, 5) if p[0] == "c030"}


def test_dense_groups_lose_nothing_in_the_lists_visited(spark):
    rng = np.random.default_rng(6)
    dense = rng.normal(size=16) + 0.04 * rng.normal(size=(500, 16))
    rows = clusters(1000, 16, 7) + [(f"d{i:03}", v.tolist(), "x") for i, v in enumerate(dense)]
    df = spark.createDataFrame(rows, SCHEMA)
    for floor in (0.85, -1.0):
        assert found(neighbours.nearest(df, "id", "v", dim=16, k=5, floor=floor, probes=neighbours.ALL, shortlist=8)) == brute(rows, 5, floor)


def test_unusable_vectors_take_no_part(spark):
    bad = [("null", None, "x"), ("short", [1.0], "x"), ("zero", [0.0, 0.0], "x"), ("nan", [float("nan"), 1.0], "x"), ("inf", [float("inf"), 1.0], "x"), ("hole", [None, 1.0], "x"), (None, [1.0, 0.0], "x")]
    got = found(neighbours.nearest(spark.createDataFrame([*bad, ("a", [1.0, 0.0], "x"), ("b", [1.0, 1.0], "x")], SCHEMA), "id", "v", dim=2, k=3, probes=neighbours.ALL))
    assert got == {("a", "b"), ("b", "a")}
    assert neighbours.nearest(spark.createDataFrame(bad, SCHEMA), "id", "v", dim=2).count() == 0


def test_hot_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rows = clusters(400, 8, 4)
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), "id", "v", dim=8, k=5, probes=neighbours.ALL)
    want = brute(rows, 5)
    assert len(found(got) & want) >= 0.99 * len(want)


def test_queries_of_hot_lists_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "ASKS", 25)
    rows = clusters(600, 16, 8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, 5, 0.85)
    got = neighbours.nearest(df, "id", "v", dim=16, k=5, floor=0.85).collect()
    assert len(got) == len({(r["id"], r["neighbour"]) for r in got}) and len(want & {(r["id"], r["neighbour"]) for r in got}) >= 0.97 * len(want)


def test_recall_does_not_fall_with_the_number_of_lists():
    x = np.array([v for _, v, _ in clusters(12_000, 32, 9)], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x[:600] @ x.T
    s[np.arange(600), np.arange(600)] = -2
    top = np.argpartition(-s, 5, axis=1)[:, :5]
    close = np.take_along_axis(s, top, 1) >= 0.85
    for lists in (64, 512, 2048):
        model = neighbours.fit(x[:: 2 if lists < 2048 else 1], lists)
        codes, near = model.encode(x, neighbours.PROBES)
        own = codes[:, 0]
        seen = (near[:600, None, :] == own[top][:, :, None]).any(2)
        assert seen[close].mean() >= 0.97, (lists, seen[close].mean())


def test_more_neighbours_than_five(spark):
    rows = clusters(300, 8, 10) + [(f"z{i:02}", [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0], "x") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(neighbours.nearest(df, "id", "v", dim=8, k=12, probes=neighbours.ALL)) == brute(rows, 12)
