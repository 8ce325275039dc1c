import json
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioflow.functions.vectors import cosine, cosine_to
from folioflow import cli, config
from folioflow.operators import embedding, health, rerank, search
from folioflow.plans import pipeline

CHUNK = (
    "chunk_id string, doc_id string, embedding array<float>, text_for_embedding string, section_heading string, section_path string, page_range struct<lo:int,hi:int>, "
    "embedding_model string, access_classification string, access_groups array<string>"
)
DOC = "doc_key string, doc_type string, is_deleted boolean, effective_date date, expiry_date date"


@pytest.fixture(scope="module")
def corpus(spark):
    row = lambda c, d, v, t, g=("g",), a="internal": (c, d, v, t, "H", "P > H", (1, 2), "m", a, list(g) if g is not None else None)
    chunks = [
        row("c1", "d1", [1.0, 0.0], "alpha beta gamma"), row("c2", "d1", [0.8, 0.6], "alpha alpha beta"), row("c3", "d2", [-1.0, 0.0], "alpha"), row("c4", "d3", [1.0, 0.0], "beta alpha", a="secret"),
        row("c5", "d4", [1.0, 0.0], "gone alpha beta"), row("c6", "d1", None, "alpha beta"), row("c7", "d1", [0.0, 0.0], None), row("c8", "d1", [1.0, 0.0, 0.0], "x", g=None), row("c9", "d5", [0.8, 0.6], "beta"),
    ]
    docs = spark.createDataFrame([("d1", "manual", False, None, None), ("d2", "manual", None, None, None), ("d3", "manual", False, None, None), ("d4", "manual", True, None, None), ("d5", "report", False, None, None)], DOC)
    dates = F.when(F.col("doc_key") == "d5", F.to_date(F.lit("2030-01-01")))
    return spark.createDataFrame(chunks, CHUNK), docs.withColumns({"effective_date": dates, "expiry_date": dates})


def ask(**more):
    return search.Request(**({"query": "alpha beta", "vector": [1.0, 0.0], "top_k": 5, "mode": "vector", "classifications": ("internal",), "groups": ("g",), "as_of": "2030-01-01"} | more))


def ids(df, order="rank"):
    return [r["chunk_id"] for r in df.orderBy(order).collect()]


def test_vector_search(corpus):
    assert ids(search.retrieve(*corpus, ask())) == ["c1", "c2", "c9"]  # negative cosines fall below the threshold of 0
    assert ids(search.retrieve(*corpus, ask(min_similarity=-1.0))) == ["c1", "c2", "c9", "c3"]
    assert ids(search.retrieve(*corpus, ask(as_of="2030-01-02"))) == ["c1", "c2"]
    assert ids(search.retrieve(*corpus, ask(doc_types=("report",)))) == ["c9"]
    assert ids(search.retrieve(*corpus, ask(groups=("nobody",)))) == []


def test_results_do_not_depend_on_partitions(corpus):
    chunks, docs = corpus
    assert {tuple(ids(search.retrieve(chunks.repartition(n), docs, ask(mode="hybrid")))) for n in (1, 4, 9)} == {("c1", "c2", "c9", "c6")}


def test_keyword_search_needs_all_terms(corpus):
    rows = search.retrieve(*corpus, ask(mode="keyword", min_similarity=9.0))
    assert ids(rows) == ["c1", "c2", "c6"] and {r["keyword_score"] for r in rows.collect()} == {0.1}  # raw scores ignore the threshold
    assert ids(search.retrieve(*corpus, ask(mode="keyword", query="the and"))) == []


def test_hybrid_of_stop_words_is_vector_only(corpus):
    rows = search.retrieve(*corpus, ask(mode="hybrid", query="the of")).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["c1", "c2", "c9"] and {r["keyword_score"] for r in rows} == {0.0}
    assert rows[0]["combined_score"] == 0.7


def test_reranking_keeps_ties_in_order(corpus):
    rows = search.retrieve(*corpus, ask(rerank=True, query="beta zeta"), rerank.TermOverlap())
    assert ids(rows) == ["c1", "c2", "c9"] and {r["rerank_score"] for r in rows.collect()} == {0.5}

    class Broken:
        def score(self, rows, query):
            raise OSError("no model")

    fallback = rerank.Fallback(Broken(), rerank.TermOverlap())
    assert ids(search.retrieve(*corpus, ask(rerank=True), fallback)) == ["c1", "c2", "c9"] and fallback.failed
    model = rerank.ModelReranker(lambda: lambda pairs: [float(len(t)) for _, t in pairs])
    assert ids(search.retrieve(*corpus, ask(rerank=True), model)) == ["c1", "c2", "c9"]


@pytest.mark.parametrize("bad", [{"top_k": 51}, {"top_k": 0}, {"query": "  "}, {"mode": "magic"}])
def test_requests_are_checked(corpus, bad):
    with pytest.raises(ValueError):
        search.retrieve(*corpus, ask(**bad))
    assert search.fetch_limit(ask(rerank=True)) == 50 and search.fetch_limit(ask()) == 5


def test_cosine_inside_and_outside_the_jvm(spark, corpus):
    out = corpus[0].select("chunk_id", cosine_to([1.0, 0.0])(F.col("embedding")).alias("a"), cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("b")).collect()
    assert {r["chunk_id"]: r["a"] for r in out} == {r["chunk_id"]: r["b"] for r in out}
    with pytest.raises(ValueError):
        cosine_to([0.0, 0.0])


def test_batch_nearest(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 9)] + [(99, None)], "id int, v array<float>").repartition(3)
    out = search.batch_nearest(v.where("id = 1"), v, 3, "id", "id", "v", 2).orderBy("rank").collect()
    assert [r["id"] for r in out] == [1, 2, 3]
    with pytest.raises(ValueError):
        search.batch_nearest(v, v, 3, "id", "id", "v", 2, block=2)


def test_top_k_is_a_bounded_sort(corpus):
    plan = search.candidates(*corpus, ask())._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def covers(words, wanted):
    """Scores of all shortest stretches, by trying every pair of ends."""
    full = lambda a, b: set(wanted) <= set(words[a : b + 1])
    n, out = len(words), 0.0
    for a in range(n):
        for b in range(a, n):
            if full(a, b) and not full(a + 1, b) and not full(a, b - 1):
                out += 0.1 / (1 + sum(w not in wanted for w in words[a : b + 1]))
    return round(out, 6) or None


def test_cover_density_against_every_stretch(spark):
    rng = random.Random(1)
    texts = [[rng.choice("abcxyz") for _ in range(rng.randint(0, 14))] for _ in range(60)] + [["a", "b"], ["a", "x", "x", "b"], ["b"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, w array<string>")
    for wanted in (["a", "b"], ["a", "b", "c"], ["a"]):
        got = {r["i"]: r["s"] for r in df.select("i", F.round(search.cover_density(F.col("w"), wanted), 6).alias("s")).collect()}
        assert got == {i: covers(t, wanted) for i, t in enumerate(texts)}


def test_only_the_latest_version_of_a_chunk_is_found(spark, corpus, tmp_path, monkeypatch, capsys):
    chunks, docs = corpus
    chunks = chunks.where("chunk_id <> 'c8'")
    versions = chunks.withColumn("updated_at", F.lit(1)).unionByName(chunks.where("chunk_id in ('c1', 'c2')").withColumns({"updated_at": F.lit(2), "text_for_embedding": F.lit("other words")}))
    versions = versions.unionByName(versions)
    rows = search.retrieve(versions, docs, ask(mode="vector")).orderBy("rank").collect()
    assert [(r["chunk_id"], r["text"]) for r in rows] == [("c1", "other words"), ("c2", "other words"), ("c9", "beta")]
    assert ids(search.retrieve(versions, docs, ask(mode="keyword"))) == ["c6"]
    settings = config.load_settings({"EMBEDDING_DIMENSION": "2", "EMBEDDING_MODEL": "m"})
    versions.write.parquet(f"{tmp_path}/chunks.parquet")
    stored = spark.read.parquet(f"{tmp_path}/chunks.parquet").withColumn("embedding_model", F.lit(settings.embedding.model_name))
    engine = pipeline.Engine(spark, settings, embedding.HashEmbedder(2), stored, docs, doc_key="doc_key")
    assert ids(engine.search("alpha beta", mode="keyword")) == ["c4", "c5", "c6"]
    stored.write.parquet(f"{tmp_path}/cli/chunks.parquet")
    docs.write.parquet(f"{tmp_path}/cli/documents.parquet")
    monkeypatch.setenv("EMBEDDING_DIMENSION", "2")
    monkeypatch.setenv("EMBEDDING_MODEL", "m")
    cli.main(["other words", "--data", f"{tmp_path}/cli", "--mode", "keyword", "--json"])
    assert [r["chunk_id"] for r in json.loads(capsys.readouterr().out)] == ["c1", "c2"]


def test_the_texts_of_hits_alone_are_shuffled(spark, data):
    hits = spark.createDataFrame([("x",)], "chunk_id string")
    plan = search.with_results(hits, spark.read.parquet(f"{data}/chunks.parquet"), ask())._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")  # the join lies below the shuffle


def test_health(spark, corpus, tmp_path):
    chunks = corpus[0]
    assert health.inspect(None, "m", 2).problems == ["there is no table of chunks"]
    assert health.inspect(chunks.limit(0), "m", 2).problems == ["the table of chunks has no rows"]
    assert "only by m" in health.inspect(chunks, "other", 2).problems[0]
    one_wrong = health.inspect(chunks, "m", 2)
    assert not one_wrong.ok and one_wrong.wrong_length == {3: 1} and one_wrong.without_vector == 1 and one_wrong.chunks == {"m": 9}
    fine = health.inspect(chunks.where("chunk_id <> 'c8'"), "m", 2, index=f"file://{tmp_path}")
    assert fine.ok and fine.has_index and not health.inspect(chunks, "m", 2, index=f"file://{tmp_path}/none").has_index


def test_overlap_takes_items_of_every_suite(spark, data):
    items = spark.read.parquet(f"{data}/eval_items.parquet").select("item_id", "suite", "text").collect()
    asked = {(r["query_id"], r["query"]) for r in spark.read.parquet(f"{data}/rag_queries.parquet").select("query_id", "query").collect()}
    terms = lambda t: {w for w in re.split(r"[ \t\n\r\f\v]+", (t or "").lower()) if w}
    want = {(i["item_id"], q): round(len(a & b) / len(a), 6) for i in items for q, t in asked if (a := terms(i["text"])) & (b := terms(t))}
    got = {(r["query_id"], r["text_id"]): r["score"] for r in entry.queries()["rerank_overlap"](spark, data).collect()}
    assert got == want and {i["suite"] for i in items if any((i["item_id"], q) in got for q, _ in asked)} == {i["suite"] for i in items}
