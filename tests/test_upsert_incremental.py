import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from folioflow.commits import CommitLog
from folioflow.operators import embedding, incremental, upsert
from folioflow.operators.current import current_rows

def now():
    return F.to_timestamp(F.lit("2030-01-02 00:00:00"))


CHUNK = "chunk_id string, content_hash string, embedding_model_version string, text_for_embedding string, run_id string, token_count int, updated_at timestamp"
OLD = dt.datetime(2029, 1, 1)


def test_chunk_upsert_updates_only_on_a_known_difference(spark):
    stored = spark.createDataFrame([(k, h, "v1", "old", "r1", 1, OLD) for k, h in (("same", "h"), ("changed", "h"), ("null", None), ("version", "h"), ("kept", "h"))], CHUNK)
    new = spark.createDataFrame(
        [("same", "h", "v1", "new", "r2", 9, None), ("changed", "g", "v1", "new", "r2", 9, None), ("null", "g", "v1", "new", "r2", 9, None), ("version", "h", "v2", "new", "r2", 9, None), ("fresh", "h", "v1", "new", "r2", 9, None)], CHUNK
    ).drop("updated_at")
    out = {r["chunk_id"]: r for r in upsert.upsert_chunks(stored, new, now()).collect()}
    assert {k: r["action"] for k, r in out.items()} == {"same": "unchanged", "changed": "updated", "null": "unchanged", "version": "updated", "kept": "unchanged", "fresh": "inserted"}
    assert out["changed"]["text_for_embedding"] == "new" and out["changed"]["token_count"] == 1 and out["same"]["run_id"] == "r1"
    again = upsert.upsert_chunks(upsert.upsert_chunks(stored, new, now()).drop("action"), new, now())
    assert again.where("action = 'inserted'").count() == 0 and again.where("chunk_id = 'changed' and action = 'updated'").count() == 0


def test_document_upsert_keeps_the_author(spark):
    schema = "doc_id string, title string, author string, is_deleted boolean, last_ingested_at timestamp, created_at timestamp"
    stored = spark.createDataFrame([("a", "t", "first", True, OLD, OLD), ("b", "t", "x", True, OLD, OLD)], schema)
    new = spark.createDataFrame([("a", "T", "second"), ("c", "T", "third")], "doc_id string, title string, author string")
    out = {r["doc_id"]: r for r in upsert.upsert_documents(stored, new, now()).collect()}
    assert (out["a"]["title"], out["a"]["author"], out["a"]["is_deleted"]) == ("T", "first", False)
    assert out["b"]["is_deleted"] and out["c"]["author"] == "third" and out["a"]["created_at"] == OLD


def test_upserts_of_empty_tables(spark):
    empty = spark.createDataFrame([], CHUNK)
    assert upsert.upsert_chunks(empty, empty, now()).count() == 0


def test_malformed_records_are_told_apart(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("c", None)], "x string, y int")
    good, bad = upsert.split_malformed(rows, ("x", "y"))
    assert good.count() == 1 and {tuple(r["missing"]) for r in bad.collect()} == {("x",), ("y",)}
    assert upsert.dead_letters(bad, "r", now()).columns[-2:] == ["_failed_at", "_run_id"]


def test_run_outcome(spark):
    actions = spark.createDataFrame([("inserted",), ("unchanged",)], "action string")
    none = upsert.run_outcome(actions, F.lit(0), F.array().cast("array<string>")).first()
    assert none["status"] == "completed" and none["error_summary"] is None
    some = upsert.run_outcome(actions, F.lit(1), F.array(*[F.lit(str(i)) for i in range(7)])).first()
    assert some["status"] == "partial" and some["error_summary"] == '["0","1","2","3","4"]'


def test_first_document_record(spark):
    rows = spark.createDataFrame([("d", 2, {"doc_type": "b"}), ("d", 1, {"doc_type": "a", "extra": "1"}), ("e", 1, None)], "doc_id string, line int, metadata map<string,string>")
    out = {r["doc_id"]: r for r in upsert.document_from_chunk(upsert.first_records(rows, "doc_id", "line")).collect()}
    assert out["d"]["doc_type"] == "a" and out["d"]["metadata"] == {"extra": "1"} and out["e"]["title"] == "e"


def test_current_rows(spark):
    rows = [("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, "only"), (None, 9, "nobody")]
    df = spark.createDataFrame(rows, "k string, v int, _key string")
    assert sorted(tuple(r) for r in current_rows(df, "k", "v", {"t": F.col("_key")}).collect()) == [("a", "new"), ("b", "only")]
    assert current_rows(df.limit(0), "k", "v", {"t": F.col("_key")}).count() == 0


def _tables(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    chunks = [("new", "d1", "x", "v1", 1), ("done", "d1", "x", "v1", 1), ("changed", "d1", "y", "v1", 1), ("version", "d1", "x", "v2", 1), ("late", "d2", "x", "v1", 1), ("null", "d1", None, "v1", 1), ("failed", "d1", "x", "v1", 1), ("orphan", "gone", "x", "v1", 1), ("older", "d1", "x", "v1", 1), ("older", "d1", "z", "v1", 2)]
    chunks = spark.createDataFrame(chunks, "chunk_id string, doc_id string, text_for_embedding string, embedding_model_version string, updated_at int")
    import hashlib

    h = {c: hashlib.sha256(c.encode()).hexdigest()[:16] for c in "xyz"}
    entries = [("done", h["x"].upper(), "v1", 5.0, "ok"), ("done", h["x"], "v1", 5.0, "ok"), ("changed", h["x"], "v1", 1.0, "part"), ("version", h["x"], "v1", 1.0, "ok"), ("failed", h["x"], "v1", 1.0, "bad"), ("older", h["x"], "v1", 1.0, "ok"), ("older", h["z"], "v1", float("nan"), "ok")]
    checkpoint = spark.createDataFrame(entries, "chunk_id string, content_hash string, model_version string, embedded_at double, run_id string")
    runs = spark.createDataFrame([("ok", "completed"), ("part", "partial"), ("bad", "failed")], "run_id string, status string")
    documents = spark.createDataFrame([("d1", None), ("d2", t("2031-05-02"))], "doc_key string, last_ingested_at timestamp")
    return chunks, checkpoint, runs, documents


def test_pending_chunks(spark):
    got = {r["chunk_id"]: r["reason"] for r in incremental.pending(*_tables(spark), "2031-05-01 00:00:00").collect()}
    assert got == {"new": "new", "changed": "changed", "version": "version", "failed": "new", "orphan": "new", "older": "changed"}


def test_pending_without_a_checkpoint(spark):
    chunks, checkpoint, runs, documents = _tables(spark)
    assert incremental.pending(chunks, checkpoint.limit(0), runs.limit(0), documents, "2031-05-01 00:00:00").count() == 7
    assert incremental.pending(chunks.limit(0), checkpoint, runs, documents, "2031-05-01 00:00:00").count() == 0


def test_commit_log_neither_skips_nor_repeats(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    source = spark.range(10).select("id", F.col("id").alias("seq"))
    assert log.watermark() is None and log.read() is None
    log.run(source, "seq", lambda d: d, upper=4)

    def dies(d):
        raise OSError("lost")

    with pytest.raises(OSError):
        log.run(source, "seq", dies)
    assert log.watermark() == 4

    def writes_then_dies(d):
        d.write.parquet(f"{tmp_path}/log/data/dead")
        raise OSError("lost")

    with pytest.raises(OSError):
        log.run(source, "seq", writes_then_dies)
    log.run(source.union(source), "seq", lambda d: d.distinct())
    assert sorted(r["id"] for r in log.read().collect()) == list(range(10))
    assert log.run(source, "seq", lambda d: d)["number"] == 2  # nothing new: no commit
    assert log.vacuum() == 1 and log.read().count() == 10
    with pytest.raises(RuntimeError):
        log._commit({"number": 2, "upper": 99, "tables": {}})  # the number is taken
    (tmp_path / "log/commits/hint").unlink()
    assert log.number() == 2 and log.read(after=1).count() == 5
    with pytest.raises(ValueError):
        log.run(spark.createDataFrame([(1, None)], "id int, seq int"), "seq", lambda d: d)


def _timed(spark):
    """The tables of ``_tables`` with real commit sequences: times of versions and ends of runs."""
    chunks, checkpoint, runs, documents = _tables(spark)
    second = lambda c: F.timestamp_seconds(F.lit(1_900_000_000) + c)
    end = F.when(F.col("run_id") == "ok", second(F.lit(10)))  # the partial run has no end
    return chunks.withColumn("updated_at", second(F.col("updated_at"))), checkpoint, runs.withColumn("completed_at", end), documents


def _reasons(spark, commit):
    return {r["chunk_id"]: r["reason"] for r in spark.read.parquet(commit["tables"]["output"]).collect()}


def test_a_run_takes_what_is_pending_and_the_next_what_came_since(spark, tmp_path):
    log, (chunks, checkpoint, runs, documents) = CommitLog(spark, f"file://{tmp_path}/log"), _timed(spark)
    start, later = "2031-05-01 00:00:00", "2031-05-03 00:00:00"
    first = incremental.embedding_run(log, chunks, checkpoint, runs, documents, start)
    assert _reasons(spark, first) == {r["chunk_id"]: r["reason"] for r in incremental.pending(*_tables(spark), start).collect()}
    assert incremental.embedding_run(log, chunks, checkpoint, runs, documents, start) == first  # nothing new: no commit
    new = spark.createDataFrame([("done", "d1", "zz", "v1", 99), ("version", "d1", "x", "v2", 99)], "chunk_id string, doc_id string, text_for_embedding string, embedding_model_version string, updated_at int")
    new = new.withColumn("updated_at", F.timestamp_seconds(F.lit(1_900_000_000) + F.col("updated_at")))
    more = chunks.unionByName(new)
    second = incremental.embedding_run(log, more, checkpoint, runs, documents, start)
    assert _reasons(spark, second) == {"done": "changed"} and second["lower"] == first["upper"]
    third = incremental.embedding_run(log, more, checkpoint, runs, documents, later)
    assert _reasons(spark, third) == {"late": "new"} and third["number"] == 3
    replay = more.unionByName(more)
    assert incremental.embedding_run(log, replay, checkpoint.unionByName(checkpoint), runs, documents, later) == third


def test_a_run_that_dies_between_write_and_commit_is_repeated_whole(spark, tmp_path, monkeypatch):
    log, tables, start = CommitLog(spark, f"file://{tmp_path}/log"), _timed(spark), "2031-05-01 00:00:00"

    def dies(entry):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(log, "_commit", dies)
        incremental.embedding_run(log, *tables, start)
    assert log.last() is None

    def process_dies(due):
        raise OSError("model gone")

    with pytest.raises(OSError):
        incremental.embedding_run(log, *tables, start, process_dies)
    done = incremental.embedding_run(log, *tables, start, lambda due: due.withColumn("vector", F.lit(1)))
    assert set(_reasons(spark, done)) == {"new", "changed", "version", "failed", "orphan", "older"} and log.vacuum() == 2
    assert spark.read.parquet(done["tables"]["output"]).columns[-1] == "vector"


def test_runs_read_only_above_the_watermark(spark, tmp_path, monkeypatch):
    chunks, checkpoint, runs, documents = _timed(spark)
    chunks.write.parquet(f"{tmp_path}/c")
    runs.write.parquet(f"{tmp_path}/r")
    chunks, runs = spark.read.parquet(f"{tmp_path}/c"), spark.read.parquet(f"{tmp_path}/r")
    log, seen = CommitLog(spark, f"file://{tmp_path}/log"), []
    incremental.embedding_run(log, chunks, checkpoint, runs, documents, "2031-05-01 00:00:00")
    chunks.withColumn("updated_at", F.timestamp_seconds(F.lit(1_900_000_099))).limit(1).write.mode("append").parquet(f"{tmp_path}/c")
    runs.withColumn("completed_at", F.timestamp_seconds(F.lit(1_900_000_099))).write.mode("append").parquet(f"{tmp_path}/r")
    chunks, runs = spark.read.parquet(f"{tmp_path}/c"), spark.read.parquet(f"{tmp_path}/r")
    of = incremental.current_rows
    monkeypatch.setattr(incremental, "current_rows", lambda df, *a: seen.append(df._jdf.queryExecution().toString()) or of(df, *a))
    incremental.embedding_run(log, chunks, checkpoint, runs, documents, "2031-05-02 00:00:00")
    pushed = [re.search(r"PushedFilters: (.*?)ReadSchema", plan).group(1) for plan in seen]
    assert "Or(IsNull(updated_at),And(" in pushed[0] and "Or(IsNull(completed_at)" in pushed[1]
    assert re.search(r"DataFilters: .*updated_at#\d+ > ", seen[0]) and re.search(r"completed_at#\d+ > ", seen[1])


def test_runs_over_empty_tables(spark, tmp_path):
    log, tables = CommitLog(spark, f"file://{tmp_path}/log"), [t.limit(0) for t in _timed(spark)]
    assert _reasons(spark, incremental.embedding_run(log, *tables, "2031-05-01 00:00:00")) == {}


def test_embedding_is_idempotent(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "chunk_id string, text_for_embedding string")
    out = embedding.embed(chunks, "text_for_embedding", lambda: embedding.HashEmbedder(8), batch_size=1)
    got = {r["chunk_id"]: r["embedding"] for r in out.collect()}
    assert got["c"] is None and abs(sum(v * v for v in got["a"]) - 1) < 1e-6 and got["a"] != got["b"]
    plan = embedding.embedding_plan(chunks.where("chunk_id <> 'c'"), spark.createDataFrame([], "chunk_id string, content_hash string, model_version string"), "v1")
    assert plan.where("status = 'pending'").count() == 2
    again = embedding.embedding_plan(chunks.where("chunk_id <> 'c'"), plan.select("chunk_id", "content_hash", "model_version"), "v1")
    assert again.where("status = 'pending'").count() == 0
    assert embedding.run_metrics(plan, batch_size=50).first()["total_api_calls"] == 1


def test_merging_vectors(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, n int")
    fresh = embedding.last_of_key(spark.createDataFrame([("b", 2, 1), ("b", 3, 2)], "chunk_id string, n int, s int"), "chunk_id", "s").drop("s")
    assert sorted(tuple(r) for r in embedding.merge_vectors(stored, fresh).collect()) == [("a", 1), ("b", 3)]


def test_run_table(spark):
    runs = spark.createDataFrame([], "run_id string, started_at timestamp, completed_at timestamp, status string, operator string, chunks_loaded int, chunks_failed int, error_summary string")
    started = upsert.start_run(upsert.start_run(runs, "r1", now(), operator="me"), "r2", now())
    assert {r["status"] for r in started.collect()} == {"running"}
    actions = spark.createDataFrame([("inserted",), ("updated",)], "action string")
    done = upsert.finish_run(started, "r1", now(), upsert.run_outcome(actions, F.lit(1), F.array(F.lit("e"))))
    failed = upsert.finish_run(done, "r2", now(), None, "boom")
    out = {r["run_id"]: r for r in failed.collect()}
    assert (out["r1"]["status"], out["r1"]["chunks_loaded"], out["r1"]["error_summary"]) == ("partial", 2, '["e"]')
    assert (out["r2"]["status"], out["r2"]["error_summary"]) == ("failed", '["boom"]') and out["r1"]["operator"] == "me"
