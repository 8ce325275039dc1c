import json

import pytest
from pyspark.sql import functions as F

from folioflow import cli, config
from folioflow.cache import CachedEmbedder, VectorMemo
from folioflow.operators import observe
from folioflow.commits import CommitLog
from folioflow.operators.embedding import HashEmbedder, embed
from folioflow.plans import pipeline
from folioflow.sources import files
from folioflow.storage import materialize, shared_dir
from folioflow.streaming import ingest


def test_pages_of_files(spark, tmp_path):
    folder = files.ensure_folder(tmp_path / "docs")
    (folder / "b-one.txt").write_text("first\fsecond")
    (folder / "skip.md").write_text("x")
    rows = files.read_pages(spark, str(folder), "*.txt").orderBy("page").collect()
    assert [(r["source_file"], r["page"], r["text"], r["total_pages"]) for r in rows] == [("b-one.txt", 1, "first", 2), ("b-one.txt", 2, "second", 2)]

    def fails(data):
        raise ValueError("unreadable")

    assert files.read_pages(spark, str(folder), "*.txt", fails).first()["error"] == "ValueError: unreadable"


def test_json_lines(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"chunk_id": "a", "token_count": 3}\n\n{"chunk_id": "b"}\n')
    assert [r["chunk_id"] for r in files.read_chunks(spark, str(p)).orderBy("chunk_id").collect()] == ["a", "b"]
    p.write_text('{"chunk_id": \n')
    with pytest.raises(Exception):
        files.read_chunks(spark, str(p)).collect()


def test_file_selection(spark):
    names = spark.createDataFrame([("Deep.pdf",), ("other.pdf",), ("deeper.pdf",)], "f string")
    loaded = spark.createDataFrame([("deeper",)], "doc_id string")
    assert [r["f"] for r in files.select_files(names, "f", "DEEP", loaded).collect()] == ["Deep.pdf"]


def test_swapping_a_table_that_is_read(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert files.read_or_empty(spark, path, "n long").count() == 0
    files.swap_table(spark.range(3).select(F.col("id").alias("n")), path)
    old = files.open_table(spark, path)
    for _ in range(2):
        files.swap_table(files.open_table(spark, path).select((F.col("n") + 1).alias("n")), path)
        assert old is None or files.open_table(spark, path).count() == 3
    assert sorted(r["n"] for r in files.open_table(spark, path).collect()) == [2, 3, 4]
    assert len([*(tmp_path / "t/data").iterdir()]) == 2  # the version before is kept for its readers


def test_vector_collection(spark, tmp_path):
    made = files.VectorCollection(spark, f"file://{tmp_path}/v")
    with pytest.raises(FileNotFoundError):
        made.load()
    rows = spark.createDataFrame([("1", "s", "t", [1.0, 0.0]), ("1b", "s", "t", [1.0, 0.0]), ("2", "s", "u", [0.0, 1.0])], "chunk_id string, source string, text string, embedding array<float>")
    with pytest.raises(ValueError):
        made.create(rows.limit(0))
    assert made.create(rows) == 3 and made.stats()["count"] == 3  # chunks with one text are two chunks
    assert [r["distance"] for r in made.search([1.0, 0.0]).collect()] == [0.0, 0.0, 1.0]
    with made.temporary(rows, "few") as view:
        assert spark.table("few").count() == view.count() == 3
    with pytest.raises(ValueError), made.temporary(rows.limit(0), "few"):
        pass
    made.delete()
    assert made.stats()["count"] == 0


def test_settings(tmp_path):
    f = tmp_path / ".env"
    f.write_text("# c\nRETRIEVAL_DEFAULT_K='7'\nCACHE_ENABLED=off\nbroken\nEMBEDDING_DIMENSION=8\n")
    s = config.load_settings({"EMBEDDING_DIMENSION": "16"}, f)
    assert s.retrieval.default_top_k == 7 and s.embedding.dimension == 16 and s.cache.limits() == (1, 1)
    for bad in ({"EMBEDDING_DIMENSION": "0"}, {"RETRIEVAL_DEFAULT_K": "60"}, {"HYBRID_KEYWORD_WEIGHT": "0.31"}, {"RETRIEVAL_MAX_K": "x"}, {"ENVIRONMENT": "production", "EMBEDDING_PROVIDER": "remote"}):
        with pytest.raises(ValueError):
            config.load_settings(bad)


def test_cache():
    now = [0.0]
    cache = VectorMemo(2, 10, lambda: now[0])
    model = CachedEmbedder(HashEmbedder(4), cache)
    hits = [model.embed(q)[1] for q in ("a", "b", "a", "b", "c")]
    assert hits == [False, False, True, True, False] and cache.report()["hits"] == 2 and cache.report()["evictions"] == 1
    now[0] = 11
    assert model.embed("c")[1] is False
    cache.clear()
    assert cache.report()["hit_rate"] == 0

    class Flaky(HashEmbedder):
        tries = 0

        def embed_batch(self, texts):
            self.tries += 1
            if self.tries < 3:
                raise OSError
            return super().embed_batch(texts)

    waits = []
    assert len(CachedEmbedder(Flaky(4), cache, 3, 0.5, waits.append).embed("z")[0]) == 4 and waits == [0.5, 1.0]


def test_from_pages_to_answers(spark, tmp_path):
    pages = spark.createDataFrame([("My-Book.pdf", 1, "alpha beta " * 400, 2), ("My-Book.pdf", 2, "gamma delta", 2)], "source_file string, page int, text string, total_pages int")
    chunks = pipeline.build_chunks(pages)
    none = spark.createDataFrame([], "chunk_id string, content_hash string, model_version string")
    embedded = pipeline.embed_new(chunks, none, lambda: HashEmbedder(16))
    done = embedded.select("chunk_id", "content_hash", F.lit("v1").alias("model_version"))
    assert embedded.count() == 2 and pipeline.embed_new(chunks, done, lambda: HashEmbedder(16)).count() == 0
    documents = embedded.select("doc_id", F.lit("ebook").alias("doc_type")).distinct()
    corpus = embedded.withColumns({"access_classification": F.lit("internal"), "access_groups": F.array(F.lit("all_advisors"))})
    settings = config.load_settings({"EMBEDDING_DIMENSION": "16"})
    engine = pipeline.Engine(spark, settings, HashEmbedder(16), corpus, documents)
    rows = engine.search("gamma delta", mode="keyword").collect()
    assert len(rows) == 1 and rows[0]["doc_id"] == "my_book" and "kw=" in cli.format_result(rows[0], 1)
    got = engine.search("gamma delta", mode="hybrid", min_similarity=-1.0)
    keys = json.loads(got.select(files.results_json(got)).first()[0])
    assert len(keys) == 12
    with pytest.raises(RuntimeError):
        pipeline.Engine(spark, config.Settings(), HashEmbedder(16), corpus, documents)


def test_run_log(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    metrics = {"chunks_processed": 1, "chunks_skipped": 2, "chunks_failed": 0, "total_cost_usd": 0.12345678, "total_duration_seconds": 1.239}
    assert observe.append_run(spark, path, metrics, "t")["run_number"] == 1
    assert observe.append_run(spark, path, metrics, "t") == {"run_number": 2, "timestamp": "t", "chunks_processed": 1, "chunks_skipped": 2, "chunks_failed": 0, "total_cost_usd": 0.123457, "total_duration_seconds": 1.24}


def test_logs_of_many_queries_make_few_files(spark, tmp_path):
    with observe.QueryLog(spark, f"file://{tmp_path}/q", every=10) as log:
        for i in range(15):
            with log.query(f"q{i}"):
                pass
        assert log.read().count() == 10
    assert log.read().count() == 15 and len([*(tmp_path / "q").glob("part-*")]) == 2


def test_failed_batches_are_counted_and_leave_the_others(spark):
    class Sometimes(HashEmbedder):
        def embed_batch(self, texts):
            if "bad" in texts:
                raise OSError("refused")
            return super().embed_batch(texts)

    rows = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", None)], "chunk_id string, text_for_embedding string").coalesce(1)
    out = {r["chunk_id"]: r for r in embed(rows, "text_for_embedding", lambda: Sometimes(4), batch_size=1, tries=2, wait=0.0, errors=True).collect()}
    assert len(out["a"]["embedding"]) == 4 and out["b"]["embedding_error"] == "OSError: refused" and out["b"]["embedding"] is None and out["c"]["embedding_error"] is None
    with pytest.raises(Exception):
        embed(rows, "text_for_embedding", lambda: Sometimes(4), batch_size=1, tries=1).collect()


def test_files_that_are_not_text_are_refused(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"%PDF-1.7 \x00\x01")
    assert "not a text file" in files.read_pages(spark, str(tmp_path)).first()["error"]


def test_streamed_upserts_are_exactly_once(spark, tmp_path):
    schema = "chunk_id string, content_hash string, embedding_model_version string, text_for_embedding string, embedded_at double"
    stored = schema + ", run_id string, updated_at timestamp, created_at timestamp"
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"chunk_id":"a","content_hash":"1","embedded_at":1}\n{"chunk_id":"a","content_hash":"2","embedded_at":2}\n')
    run = lambda: ingest.upsert_stream(spark, str(source), schema, f"file://{tmp_path}/t", stored, str(tmp_path / "cp")).awaitTermination()
    run()
    (source / "2.json").write_text('{"chunk_id":"b","content_hash":"1","embedded_at":3}\n')
    run()
    run()
    assert sorted((r["chunk_id"], r["content_hash"]) for r in files.open_table(spark, f"file://{tmp_path}/t").collect()) == [("a", "2"), ("b", "1")]


def test_materialized_tables_lie_in_the_shared_folder(spark):
    df = materialize(spark.range(5), "test")
    assert df.count() == 5 and shared_dir(spark) in df.inputFiles()[0]


def test_extracted_rows_and_regions(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one two")
    (tmp_path / "b.bin").write_bytes(b"bad")

    def words(data):
        if data == b"bad":
            raise ValueError("damaged")
        return [{"ord": i, "text": w} for i, w in enumerate(data.decode().split())]

    rows = files.extract_rows(spark, str(tmp_path), "*.bin", words, "ord int, text string").collect()
    assert sorted((r["source_file"], r["text"], r["error"]) for r in rows if r["text"]) == [("a.bin", "one", None), ("a.bin", "two", None)]
    assert [r["error"] for r in rows if r["source_file"] == "b.bin"] == ["ValueError: damaged"]
    meta = files.document_metadata(spark, str(tmp_path), "*.bin", lambda d: {"page_count": len(words(d)), "author": ""}).collect()
    assert sorted((r["source_file"], r["page_count"], r["author"]) for r in meta) == [("a.bin", 2, "Unknown"), ("b.bin", None, "Unknown")]
    figures = spark.createDataFrame([("a.bin", "f1", 1, (0.0, 0.0, 1.0, 1.0)), ("a.bin", "f2", 2, (0.0, 0.0, 2.0, 1.0))], "source_file string, element_id string, page int, bbox struct<x0:double,top:double,x1:double,bottom:double>")
    content = spark.createDataFrame([("a.bin", bytearray(b"x"))], "source_file string, content binary")
    drawn = files.render_regions(figures, content, lambda data, regions: [data * page for page, _ in regions]).collect()
    assert {r["element_id"]: bytes(r["image"]) for r in drawn} == {"f1": b"x", "f2": b"xx"}


def test_query_log_has_failures_too(spark, tmp_path):
    log = observe.QueryLog(spark, f"file://{tmp_path}/q")
    with log.query("fine") as context:
        context.results_returned = 3
    with pytest.raises(OSError), log.query("breaks"):
        raise OSError("no table")
    log.metric("size", 3)
    rows = {r["query_text"]: r for r in log.read().collect()}
    assert rows["fine"]["results_returned"] == 3 and rows["fine"]["error"] is None and rows["breaks"]["error"] == "OSError: no table"
    summary = observe.log_summary(log.read()).first()
    assert summary["queries"] == 2 and summary["failures"] == 1


def test_building_twice_embeds_once(spark, tmp_path):
    from folioflow.build import build

    source = tmp_path / "in"
    source.mkdir()
    (source / "one.txt").write_text("alpha beta\fgamma")
    (source / "two.txt").write_text("delta")
    out = f"file://{tmp_path}/out"
    first = build(spark, str(source), out)
    assert first["chunks"] == first["embedded"] == first["inserted"] == 2
    assert build(spark, str(source), out)["embedded"] == 0
    (source / "two.txt").write_text("delta changed")
    third = build(spark, str(source), out)
    assert third["embedded"] == 1 and third["updated"] == 1
    built = CommitLog(spark, out)
    assert built.number() == 3 and built.table("chunks").count() == 2 and built.table("documents").count() == 2
    assert json.loads((tmp_path / "out/metrics.json").read_text()) == {"chunks": 2, "failed": 0, "errors": []}
    assert cli.main(["delta", "--data", out, "--mode", "keyword"]) == 0
    assert build(spark, str(source), out, only="ONE", rebuild=True)["chunks"] == 1
