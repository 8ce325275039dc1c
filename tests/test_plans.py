"""Plans read the columns they need, push their filters down and don't multiply tables."""

import re

import pytest

import __spark_entry__ as entry
from folioflow.operators import incremental

Q = entry.queries()


def plan(df):
    return df._jdf.queryExecution().toString()


def read_schemas(text):
    return re.findall(r"ReadSchema: struct<([^\n]*)", text)


def test_pending_reads_no_vectors_and_pushes_its_filters(spark, data):
    tables = [spark.read.parquet(f"{data}/{n}.parquet") for n in ("chunks", "checkpoint", "ingestion_runs", "documents")]
    text = plan(incremental.pending(*tables, "2031-05-01 00:00:00"))
    assert read_schemas(text) and not any("embedding:array" in r or "section_path" in r for r in read_schemas(text))
    assert "GreaterThan(last_ingested_at" in text and "In(status" in text and "WindowGroupLimit" in text


def test_keyword_search_reads_no_vectors_for_its_hits(spark, data):
    found = read_schemas(plan(Q["keyword_match"](spark, data)))
    assert found and not any("embedding:array" in r for r in found)


@pytest.mark.parametrize("name", ["vector_topk", "hybrid", "keyword_search"])
def test_searches_cut_before_they_join_texts(spark, data, name):
    text = plan(Q[name](spark, data))
    assert "CartesianProduct" not in text and ("TakeOrderedAndProject" in text or "GlobalLimit" in text)


@pytest.mark.parametrize("name", ["token_stats", "upsert_chunks", "incremental_plan"])
def test_current_rows_are_ranked_before_the_shuffle(spark, data, name):
    assert "WindowGroupLimit" in plan(Q[name](spark, data))


def test_sections_and_parts_are_not_broadcast_to_find_figures(spark, data):
    """Only the last page of each source may be: Spark takes what generators multiply, and narrow columns of packed files, for small."""
    text = plan(Q["figure_range_join"](spark, data)).split("== Physical Plan ==")[1]
    assert text.count("BroadcastHashJoin") <= 1 and text.count("SortMergeJoin") >= 2 and "sequence(" not in text


def executed(spark):
    """Physical plans of all SQL executions of the session so far, by number."""
    store = spark._jsparkSession.sharedState().statusStore()
    found = store.executionsList()
    return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}


@pytest.mark.parametrize("name", sorted(Q))
def test_no_cartesian_product(spark, data, name):
    """Neither in a query's plan nor in those of the jobs it runs while it is built."""
    before = executed(spark)
    last = plan(Q[name](spark, data))
    built = {k: v for k, v in executed(spark).items() if k not in before}
    for text in [last, *built.values()]:
        assert "CartesianProduct" not in text
