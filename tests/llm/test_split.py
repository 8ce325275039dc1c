import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import split

LIMIT, OVERLAP, CHARS = 20, 3, 4
MOST, LAP = LIMIT * CHARS + CHARS - 1, OVERLAP * CHARS


def pieces(spark, rows, **more):
    df = spark.createDataFrame(rows, "k string, t string, id string, text string")
    return split.split_oversized(df, "k", "t", **more)


def greedy(text):
    """One cut after another, without successor tables."""
    at, kind = split.boundaries(text, MOST - LAP)
    cuts, here = [], 0
    while at[here] < len(text):
        reach = MOST if here == 0 else at[here] - LAP + MOST
        fit = [j for j in range(here + 1, len(at)) if at[j] <= reach]
        natural = [j for j in fit if kind[j] not in (split.WORD, split.HARD)]
        here = (natural or fit)[-1]
        cuts.append(int(at[here]))
    return cuts


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab. \n?é"), min_size=MOST + 1, max_size=900))
def test_doubling_equals_the_greedy_loop(text):
    at, kind = split.boundaries(text, MOST - LAP)
    assert at[0] == 0 and at[-1] == len(text) and (np.diff(at) > 0).all() and (np.diff(at) <= MOST - LAP).all()
    successor = split.successors(at, kind, MOST, LAP)
    on = split.mark_cuts(successor, np.array([0]), np.array([len(at) - 1]))
    assert at[on].tolist()[1:] == greedy(text)


def test_pieces_rebuild_the_text(spark):
    text = "\n\n".join(" ".join(f"Sentence {i} of paragraph {j} says something." for i in range(9)) for j in range(40))
    rows = [("a", text, "x", "y"), ("b", "x" * 9000, None, None), ("c", "word " * 3000, None, None), ("d", "y" * 4003, None, None), ("e", "z" * 4004, None, None), ("f", None, None, None), ("g", "", None, None)]
    out = pieces(spark, rows).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["id"], r["chunk_index"])):
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {"a", "b", "c", "e"}
    texts = {r[0]: r[1] for r in rows}
    for k, ps in by.items():
        assert [p["chunk_index"] for p in ps] == list(range(len(ps)))
        assert all(p["token_count"] <= 1000 and p["text"] == texts[k][p["start"] : p["end"]] for p in ps)
        assert ps[0]["start"] == 0 and ps[-1]["end"] == len(texts[k])
        assert all(q["start"] == p["end"] - 320 for p, q in zip(ps, ps[1:]))
    assert all(p["cut"] in ("sentence", "paragraph") for p in by["a"][:-1])
    assert all(p["text"].endswith(" ") for p in by["c"][:-1]) and {p["cut"] for p in by["b"][:-1]} == {"hard"}


def test_empty_and_repeated_rows(spark):
    assert pieces(spark, []).count() == 0
    assert pieces(spark, [("a", "z" * 4004, None, None)] * 2).count() == 4


def test_a_cut_at_a_line_end_is_preferred_to_a_word(spark):
    text = ("word " * 700).strip() + "\n" + "more " * 700
    first = pieces(spark, [("a", text, None, None)]).orderBy("chunk_index").first()
    assert first["cut"] == "line" and re.search(r"word\n$", first["text"])
