import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.operators import chunking, sections
from folioflow.plans import pipeline


def by_hand(paragraphs, prefix, room, overlap):
    """Row-at-a-time greedy packing, kept apart from the operator."""
    out, held, load = [], [], prefix
    for i, size in enumerate(paragraphs):
        if held and load + size > room:
            out.append(list(held))
            tail, total = [], 0
            for j in reversed(held):
                if total + paragraphs[j] > overlap:
                    break
                tail.insert(0, j)
                total += paragraphs[j]
            held, load = tail, prefix + total
        held.append(i)
        load += size
    return [*out, held] if held else out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=30), st.integers(0, 40), st.integers(1, 900), st.integers(0, 200))
def test_windows_pack_greedily(sizes, base, room, overlap):
    assert [list(range(a, b)) for a, b in chunking.windows(sizes, base, room, overlap)] == by_hand(sizes, base, room, overlap)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab .\n"), max_size=300))
def test_recursive_pieces_keep_every_word_within_the_size(text):
    pieces = chunking.recursive_pieces(text, 40, 10)
    assert all(0 < len(p) <= 40 and p == p.strip() for p in pieces)
    joined = "".join(pieces)
    assert set(re.sub(r"\s", "", text)) <= set(joined) | set("")
    if not pieces:
        assert not text.strip()


def test_recursive_pieces_prefer_paragraphs():
    assert chunking.recursive_pieces("a" * 30 + "\n\n" + "b" * 30, 40, 5) == ["a" * 30, "b" * 30]


def test_chunk_filter(spark):
    cases = {
        "x" * 50: False, "x" * 51: True, "1" * 60: False, "\n".join(["word word"] * 10): True, "\n".join(["word word"] * 11): False, " " * 60: False,
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, False)], "t string, want boolean")
    assert rows.where(chunking.keeps_chunk(F.col("t")) != F.col("want")).count() == 0


def test_paragraphs_merge_below_fifty_tokens(spark):
    def merged(text):
        return spark.createDataFrame([(text,)], "t string").select(chunking.paragraphs(F.col("t"))).first()[0]

    assert merged("a\n\nb") == ["a\n\nb"]
    assert merged("x" * 100 + "\n\n" + "y" * 96) == ["x" * 100 + "\n\n" + "y" * 96]
    assert merged("x" * 100 + "\n \n" + "y" * 100) == ["x" * 100, "y" * 100]
    assert merged("") == [] and merged(None) == []


SECTION = "doc_id string, ord long, heading string, level int, parent_path array<string>, page_range struct<lo:int,hi:int>, text string, figures array<struct<element_id:string,description:string,decision:string>>"


def test_chunk_sections(spark):
    figure = [("f1", "d", "process_as_chart")]
    long = "\n\n".join(["p" * 1200] * 8)
    rows = [
        ("d", 1, "Intro", 1, [], (1, 2), "short", figure),
        ("d", 2, "Deep", 2, ["Intro"], (3, 4), long, figure),
        ("d", 3, "Empty", 1, [], (5, 5), "  \n", []),
        ("d", 4, "Intro", 1, [], (6, 6), "again", None),
        ("d", 5, "Null", 1, None, None, None, []),
    ]
    out = {r["chunk_id"]: r for r in chunking.chunk_sections(spark.createDataFrame(rows, SECTION)).collect()}
    assert len(out) == 1 + 3 + 1  # ids are unique although a path repeats
    whole = [r for r in out.values() if r["chunk_strategy"] == "whole_section"]
    assert {r["text_for_embedding"] for r in whole} == {"# Intro\n\nshort", "# Intro\n\nagain"}
    split = sorted((r for r in out.values() if r["chunk_strategy"] == "section_split"), key=lambda r: r["chunk_index"])
    assert [r["chunk_type"] for r in split] == ["prose_with_figure", "prose", "prose"]
    assert all(r["text_for_embedding"].startswith("# Deep\n\n") for r in split)  # heading, no breadcrumb
    assert split[0]["referenced_figures"] and not split[1]["referenced_figures"]


def test_section_limit_switches_above_a_thousand_tokens(spark):
    head = len("# H\n\n")
    rows = [("d", 1, "H", 1, [], None, "x" * (4003 - head), []), ("e", 1, "H", 1, [], None, "x" * (4004 - head), [])]
    out = {r["doc_id"]: r["chunk_strategy"] for r in chunking.chunk_sections(spark.createDataFrame(rows, SECTION)).collect()}
    assert out == {"d": "whole_section", "e": "section_split"}


def test_page_packing_closes_at_the_target(spark):
    pages = [("d", 1, "x" * 3396), ("d", 2, "  "), ("d", 3, "yyyy"), ("d", 4, "zzzz"), ("d", 5, None), ("e", 1, ""), ("f", 1, "q" * 3400)]
    out = sections.pack_pages(spark.createDataFrame(pages, "doc string, page int, text string"), "doc", "page", "text")
    got = sorted((r["doc_id"], r["page_start"], r["page_end"], r["tokens"]) for r in out.collect())
    assert got == [("d", 1, 3, 850), ("d", 4, 5, 1), ("f", 1, 1, 850)]


def test_page_ends_ignore_levels(spark):
    toc = spark.createDataFrame([("d", 1, 3, 20), ("d", 2, 3, 20), ("d", 3, 9, 20)], "doc_id string, ord int, page_start int, page_count int")
    assert [r["page_end"] for r in sections.page_ends(toc).orderBy("ord").collect()] == [2, 8, 20]


SPANS, FIGURES = "doc_id string, ord int, page_start int, page_end int", "doc_id string, page int, element_id string, decision string"


def test_figures_of_a_section_as_long_as_an_int_allows(spark):
    spans = spark.createDataFrame([("d", 1, 1, 2**31 - 1), ("d", 2, -(2**31), 2**31 - 1), ("d", 3, 7, 7), ("d", 4, 8, 7), ("d", 5, None, 9), ("d", 6, 1, None)], SPANS)
    figures = spark.createDataFrame([("d", 7, "a", "process_as_chart"), ("d", 2**31 - 1, "b", "process_as_chart"), ("d", -5, "c", "process_as_chart"), ("d", 7, "e", "skip_decorative"), ("d", None, "f", "process_as_chart"), ("x", 7, "g", "process_as_chart")], FIGURES)
    got = sorted((r["ord"], r["element_id"], r["description"]) for r in sections.figures_in_sections(spans, figures).collect())
    text = "[Figure on page {}: would be described by VLM in production]".format
    assert got == [(1, "a", text(7)), (1, "b", text(2**31 - 1)), (2, "a", text(7)), (2, "b", text(2**31 - 1)), (2, "c", text(-5)), (3, "a", text(7))]


def test_figures_in_overlapping_sections_each_once(spark):
    rng = random.Random(5)
    spans = [(rng.choice("de"), i, a, a + rng.choice([0, 1, 3, 15, 16, 17, rng.randint(0, 300)])) for i in range(300) for a in [rng.randint(-40, 300)]]
    figures = [(rng.choice("de"), rng.randint(-50, 620), str(i), "process_as_chart") for i in range(200)]
    found = sections.figures_in_sections(spark.createDataFrame(spans, SPANS), spark.createDataFrame(figures, FIGURES))
    by_hand = sorted((d, i, page, name) for d, i, lo, hi in spans for at, page, name, _ in figures if at == d and lo <= page <= hi)
    assert sorted((r["doc_id"], r["ord"], r["page"], r["element_id"]) for r in found.collect()) == by_hand
    placed = sections.page_blocks(spark.createDataFrame(spans, SPANS)).groupBy("ord").agg(F.sum(F.pow(4, "_level")).alias("pages")).collect()
    assert {r["ord"]: r["pages"] for r in placed} == {i: hi - lo + 1 for _, i, lo, hi in spans}


def test_outline_paths(spark):
    rows = [("d", 1, "A", 1, 1), ("d", 2, "B", 2, 2), ("d", 3, "C", 3, 2), ("d", 4, "D", 1, 5), ("d", 5, "E", 2, 6), ("d", 6, "gone", 2, None)]
    out = sections.walk_outline(spark.createDataFrame(rows, "doc_id string, ord int, title string, level int, page_start int")).orderBy("ord").collect()
    assert [r["parent_path"] for r in out] == [[], ["A"], ["A", "B"], [], ["D"]]
    deep = [("d", i, f"t{i}", i, 1) for i in range(1, 15)] + [("e", 1, "x", None, 1), ("e", 2, "y", 3, 1), ("e", 3, "z", 2, 1)]
    out = sections.walk_outline(spark.createDataFrame(deep, "doc_id string, ord int, title string, level int, page_start int")).orderBy("doc_id", "ord").collect()
    assert out[13]["parent_path"] == [f"t{i}" for i in range(1, 14)] and [r["parent_path"] for r in out[14:]] == [[], [], []]


def test_sections_of_an_outline(spark):
    outline = spark.createDataFrame([("d", 1, "A", 1, 1), ("d", 2, "B", 2, 3), ("d", 3, "C", 2, 3)], "doc_id string, ord int, title string, level int, page_start int")
    pages = spark.createDataFrame([("d", 1, "one"), ("d", 2, "two"), ("d", 3, "three"), ("d", 4, None)], "doc_id string, page int, text string")
    figures = spark.createDataFrame([("d", 2, "f1", "process_as_chart"), ("d", 4, "f2", "skip_decorative")], "doc_id string, page int, element_id string, decision string")
    out = {r["heading"]: r for r in pipeline.sections_from_outline(outline, pages, figures).collect()}
    assert set(out) == {"A", "C"} and out["A"]["text"] == "one\n\ntwo" and out["C"]["text"] == "three\n\n" and out["C"]["parent_path"] == ["A"]
    assert [f["element_id"] for f in out["A"]["figures"]] == ["f1"] and out["C"]["figures"] == [] and tuple(out["A"]["page_range"]) == (1, 2)
    files = pages.select(F.lit("d.pdf").alias("source_file"), "page", "text").unionByName(spark.createDataFrame([("plain.pdf", 1, "no outline")], "source_file string, page int, text string"))
    chunks = {r["section_heading"]: r for r in pipeline.build_chunks(files, outline, figures).collect()}
    assert set(chunks) == {"A", "C", "Pages 1-1"} and chunks["A"]["chunk_type"] == "prose_with_figure"
