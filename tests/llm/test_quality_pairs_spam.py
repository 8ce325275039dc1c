import re

import pytest

from folioflow.llm import pairs, quality, spam

COMMON = "what about the a of and to in is it that for on was with as by at from which are not but be this have or an der die das und ist nicht le la les et est pas el que los no".split()
HASHES = quality.hashes(COMMON)
PROSE = "The cache is a part of the system that holds what was read. It is not large, but it is fast, and that is why it was built.\n\nBy the end of the day it has to be emptied."
WRAPPED = "The cache is a part\nof the system that\nholds what was read.\nIt is not large, but\nit is fast, and that\nis why it was built."


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE, None),
        (WRAPPED, None),
        ("_Section: A > B_\n\n# B\n\n" + PROSE, None),
        (PROSE + "\n\n- first item\n- second item\n- third item\n\n" + PROSE, None),
        ("Items:\n" + "\n".join(f"- entry number {i}" for i in range(9)), "list"),
        ("\n".join(f"{i}. sturdy handle {i}" for i in range(9)), "list"),
        ("\n".join(["sturdy handle", "small wheel", "green box", "copper wire", "glass lid", "steel bolt"]), "list"),
        ("| a | b | c |\n|---|---|---|\n" + "\n".join(f"| x{i} | {i}.5 | {i}7 |" for i in range(6)), "table"),
        ("\n".join(f"name{i}\tkind\t{i}.25\t{i}" for i in range(6)), "table"),
        ("\n".join(f"name{i}     kind     {i}.25" for i in range(6)), "table"),
        ("\n".join(f"x{i};y;{i}.5" for i in range(6)), "table"),
        ("\n".join(f"Name{i}: kind / {i}.5 / {i}9" for i in range(6)), "table"),
        ("\n".join("bA07SDZZ+rKPBGinM5vD2enGuWn9hgmB2fF4Qi4C4kLevcmLeNkSD2cNpYTyVn" for _ in range(5)), "junk"),
        ("\n".join("The cache is a part".replace(" ", "") * 3), "junk"),
        ("00000000  4b 54 14 7e d5 a3 01 75 02 6b 07 84 ed 92 f9 a0\n" * 4, "junk"),
        ("vc^6gd6o pf\\i>#^h g1ll@m4~ wrho8p> ^_# br^j9~> 1o2zb_u= #+*he4|r df*\n" * 4, "junk"),
        ("DÃ©r PuffÃ©r vÃ©rschiÃ©b� dÃ©Â± Tak�, wÃ©il dÃ©r AbglÃ©ich Â±ach�rÃ¤glich " * 4, "junk"),
        ("lova nelmar lajas vavel ulba zanmi ulba cenyor vava telquin calro cenyor " * 6, "junk"),
        ("########## 25526 ^ 23711\n.............. 96820 | 14254\n" * 4, "junk"),
    ],
)
def test_kinds(text, kind):
    assert quality.assess([text], HASHES)["kind"] == [kind]


def test_statistics_and_reasons(spark):
    common = spark.createDataFrame([(w,) for w in COMMON] + [(None,)], "word string")
    rows = [("a", PROSE, "x"), ("b", None, "x"), ("c", " \n\t", "x"), ("d", "?!", "x"), ("e", PROSE * 3000, "x"), (None, PROSE, "x"), ("f", "x\ud83d"[:1] + " 😀 é", "x")]
    out = {r["id"]: r for r in quality.text_quality(spark.createDataFrame(rows, "k string, t string, id string"), "k", "t", common).collect()}
    assert set(out) == {"a", "d", "e", None, "f"}
    a = out["a"]
    w = re.findall(r"[^\W_]+", PROSE)
    assert a["n_words"] == len(w) and a["n_lines"] == 2 and a["mean_word_length"] == pytest.approx(sum(map(len, w)) / len(w))
    assert a["common_word_share"] == pytest.approx(sum(x.lower() in COMMON for x in w) / len(w)) and a["line_end_share"] == 1.0
    assert a["failed_rules"] == ["words"] and out["e"]["kind"] is None and "words" in out["e"]["failed_rules"]
    assert quality.text_quality(spark.createDataFrame([], "k string, t string"), "k", "t", common).count() == 0


def test_the_latest_version_counts_even_without_a_text(spark):
    common = spark.createDataFrame([(w,) for w in COMMON], "word string")
    rows = [("a", PROSE, 1), ("a", "- x\n- y\n- z", 2), ("b", PROSE, 1), ("b", None, 2), ("c", "  ", 1), ("c", PROSE, None), ("d", PROSE, 5), ("d", PROSE, 5)]
    df = spark.createDataFrame(rows, "k string, t string, v int")
    out = {r["id"]: r["n_words"] for r in quality.text_quality(df, "k", "t", common, version_col="v").collect()}
    assert set(out) == {"a", "d"} and out["a"] == 3
    assert quality.text_quality(df.limit(0), "k", "t", common, version_col="v").count() == 0


def test_kinds_follow_from_recorded_reasons():
    found = quality.assess([PROSE, "\n".join(f"- entry number {i}" for i in range(9)), "\n".join(f"x{i};y;{i}.5" for i in range(6)), "lova nelmar lajas vavel ulba zanmi " * 12], HASHES)
    assert found["kind"] == [quality.kind_of(r) for r in found["failed_rules"]] == [None, "list", "table", "junk"]
    for reasons in found["failed_rules"][1:]:
        assert any(r in quality.RULES[1:10] for r in reasons)


def test_vectorized_counts_equal_a_loop():
    lines = ["The  cat\t(42) sat|on; the mat, ok.", "", "é😀 x=1 / 2 / 3", "  a  b"]
    counts, seps = quality.line_counts(lines, HASHES)
    for i, line in enumerate(lines):
        w = re.findall(r"[^\W_]+", line)
        assert counts["words"][i] == len(w) and counts["tokens"][i] == len(line.split())
        assert counts["common"][i] == sum(x.lower() in COMMON for x in w)
        assert counts["chars"][i] == sum(not c.isspace() for c in line) and counts["digits"][i] == sum(c.isdigit() for c in line)
    assert seps[:, 0].tolist() == [1, 0, 0, 0] and seps[:, 4].tolist() == [0, 0, 2, 0] and seps[:, 5].tolist() == [1, 0, 0, 1]


VOTES = pairs.shared_votes([("en", w) for w in "the of and to in is it for on with by at from".split()] + [("de", w) for w in "der die das und ist nicht von mit wird den".split()] + [("fr", w) for w in "le la les et est du pas avec dans".split()])
MACHINE = pairs.refusal_automaton()


@pytest.mark.parametrize(
    ("query", "answer", "defects"),
    [
        ("What is the limit of the cache?", None, ["empty"]),
        ("q", " \n​", ["empty"]),
        ("q", "<p></p>", ["empty"]),
        ("q", "```\n```", ["empty"]),
        ("q", "N/A", ["empty"]),
        ("q", "[no answer]", ["empty"]),
        ("Is it good?", "Yes", []),
        ("What is the limit?", "250 pages (see the table on page 3)", []),
        ("How do I start it?", "1. Open the lid.\n2. Choose it.\n3. start it", []),
        ("Compare A and B.", "- A: red\n- B: blue", []),
        ("Give me a command", "```\nrun --x 3\n```", []),
        ("Give me a command", "Run this:\n```\nrun --x", ["truncated"]),
        ("How do I start it?", "1. Open the lid.\n2. Choose the", ["truncated"]),
        ("What is it?", "It is a box with a lid. The lid is made of", ["truncated"]),
        ("What is it?", "It is a box (made of", ["truncated"]),
        ("What is it?", "It is a box with a lid and [cut]", ["truncated"]),
        ("What is it?", "It is a box that...", ["truncated"]),
        ("What is it?", "I'm sorry, but I can't help with that request.", ["refusal"]),
        ("Was ist das?", "Diese Frage darf ich leider nicht beantworten.", ["refusal"]),
        ("Who owns it?", "I cannot name one owner, but chapter 3 says the red group keeps it.", []),
        ("Does it fit?", "In this case the box cannot accept a lid without a hinge.", []),
        ("How do I start the engine in winter?", "You asked: How do I start the engine in winter?", ["copy"]),
        ("How do I start the engine in winter?", "HOW DO I START THE indeed ENGINE IN WINTER?", ["copy"]),
        ("How do I start the engine in winter?", "You ask: How do I start the engine in winter?\nTurn it twice.", []),
        ("How do I start the engine in winter?", "You ask: How do I start the engine in winter?\nYes", []),
        ("What is the limit of the cache?", "Der Wert wird von den Proben nicht bestimmt und ist klein.", ["other_language"]),
        ("What is the limit? Please answer in German.", "Der Wert wird von den Proben nicht bestimmt und ist klein.", []),
        ("What is the limit of the cache?", "The German notes call it “die Schicht von der Probe”, and it is for the cache.", []),
    ],
)
def test_defects(query, answer, defects):
    assert pairs.defects(query, answer, MACHINE, VOTES) == defects


@pytest.mark.parametrize(
    "answer",
    [
        "We are not able to disclose that figure here.", "This assistant is unable to share such details.", "I could not comment on that.", "Ich möchte dazu keine Auskunft geben.",
        "Wir können dir nicht helfen.", "Je ne souhaite pas en parler.", "No podemos revelar esos datos.", "No quiero hablar de eso.",
    ],
)
def test_refusals_in_other_words(answer):
    assert not any(f" {p} " in f" {' '.join(pairs.words(answer))} " for p in pairs.REFUSALS)
    assert pairs.is_refusal(answer, MACHINE)


@pytest.mark.parametrize("answer", ["The box cannot provide more than two volts.", "We can help by turning the wheel.", "You cannot answer it with a key.", "El filtro no puede dar más agua.", "Le robinet ne peut donner plus."])
def test_limits_of_things_are_no_refusals(answer):
    assert not pairs.is_refusal(answer, MACHINE)


def test_covering_long_copies_is_linear():
    import time

    words = [f"w{i}" for i in range(40_000)]
    machine = pairs.SuffixAutomaton(words)
    began = time.perf_counter()
    assert all(machine.covered(words, 2))
    assert time.perf_counter() - began < 1


def test_suffix_automaton_covers_what_brute_force_covers():
    prompt, response = "a b c d b c e".split(), "x b c d y b c e a b".split()
    stretches = {tuple(prompt[i:j]) for i in range(7) for j in range(i + 2, 8)}
    want = [any(tuple(response[a:b]) in stretches for a in range(i + 1) for b in range(max(i + 1, a + 2), 11)) for i in range(10)]
    assert pairs.SuffixAutomaton(prompt).covered(response, 2) == want


def test_pairs_in_spark(spark):
    rows = [(1, "q", None, "x"), (1, "q", None, "x"), (2, None, "It is a box that...", "x"), (None, "q", "", "x"), (3, "What is the limit?", "word " * 20000 + ".", "x")]
    common = spark.createDataFrame([("en", "the"), (None, "x")], "lang string, word string")
    out = pairs.defective_pairs(spark.createDataFrame(rows, "query_id long, query string, answer string, defect string"), common)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "empty"), (2, "truncated")]
    assert out.limit(0).count() == 0


WORDS = frozenset(COMMON)


@pytest.mark.parametrize(
    ("text", "is_spam"),
    [
        (PROSE, False),
        (WRAPPED, False),
        ("cheap phone, cheap case, best phone, phone, case, phone, cheap phone, case, best case, phone, phone, case, cheap case, phone, best phone", True),
        ("\n".join(f"https://example.test/page/{i}" for i in range(12)), True),
        ("\n".join(f'<a href="https://example.test/{i}">Title number {i}</a>' for i in range(12)), True),
        (" ".join(f"#tag{i}" for i in range(30)), True),
        ("; ".join(f"colour=red{i}" for i in range(30)), True),
        ("\n".join(f"AB-12{i} Sturdy handle {i}5.99 sale" for i in range(12)), True),
        (" | ".join(f"Title words number{i}" for i in range(20)), True),
        ("Contents\n" + "\n".join(f"1.{i} Some heading ......... {i}" for i in range(20)), False),
        ("\n".join(f"[{i}] Author, Other (19{i}0). The title of the work that is cited. Press, pp. 1-3." for i in range(10)), False),
        ("\n".join(f"name{i}\tkind\t{i}.25\t{i}7" for i in range(12)), False),
        ("\n".join(f"Q{i}. What about the part?\nThe part is in the box by the door." for i in range(10)), False),
        ((PROSE + "\n\n") * 3 + "\n".join(f"https://example.test/{i}" for i in range(4)), False),
        ("#one #two", False),
    ],
)
def test_spam(spark, text, is_spam):
    common = spark.createDataFrame([(w,) for w in COMMON], "word string")
    row = spam.page_kinds(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_words int"), common).first()
    assert row["spam"] is is_spam


def test_viterbi_in_step_equals_viterbi_alone():
    import numpy as np

    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 8, n).tolist() for n in (1, 7, 3, 7, 20)]
    together = spam.viterbi(sequences)
    assert all((a == spam.viterbi([s])[0]).all() for a, s in zip(together, sequences)) and [len(a) for a in together] == [1, 7, 3, 7, 20]


def test_training_recovers_how_sticky_states_are():
    import numpy as np

    rng = np.random.default_rng(2)
    truth = spam.untrained()
    move = np.where(np.eye(5, dtype=bool), 0.98, 0.005)
    sequences, states = [], []
    for _ in range(300):
        at, symbols, path = rng.integers(5), [], []
        for _ in range(40):
            symbols.append(int(rng.choice(8, p=truth.emit[at])))
            path.append(at)
            at = rng.choice(5, p=move[at])
        sequences.append(symbols)
        states.append(path)
    model = spam.train(sequences, held=50)
    assert np.diag(model.move).min() > 0.95 and np.allclose(model.emit.sum(1), 1) and np.allclose(model.move.sum(1), 1)
    right = lambda m: np.mean([(a == b).mean() for a, b in zip(spam.viterbi(sequences, m), map(np.array, states))])
    assert right(model) > max(0.97, right(None))
    assert (spam.train([]).emit == truth.emit).all()


def test_pages_without_text(spark):
    common = spark.createDataFrame([("the",)], "word string")
    df = spark.createDataFrame([(1, None), (2, " "), (None, "x"), (3, "…")], "doc_id long, text string")
    assert [r["doc_id"] for r in spam.page_kinds(df, common).collect()] == [3]
    assert spam.page_kinds(df.limit(0), common).count() == 0


def test_every_page_trains_the_model(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    lines = ["It is not the part that was read.", "Sturdy handle", "https://example.test/page", "#one #two #three", "Copper wire / glass lid", "1.2 Steel bolt 7.25", "Green box was sold."]
    mixes = rng.dirichlet(np.ones(len(lines)) / 2, 3200)
    texts = ["\n".join(rng.choice(lines, rng.integers(1, 15), p=p)) for p in mixes]
    seen = [spam.symbols(spam.units(t, WORDS), WORDS) for t in texts]
    model = spam.train([s for s, _ in seen])
    right = {i: np.bincount(path, n, 5) / sum(n) for i, ((_, n), path) in enumerate(zip(seen, spam.viterbi([s for s, _ in seen], model)))}
    common = spark.createDataFrame([(w,) for w in COMMON], "word string")
    out = spam.page_kinds(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), common).collect()
    assert len(out) == 3200
    assert [r["doc_id"] for r in out if not np.allclose([r[f"{s}_share"] for s in spam.STATES], right[r["doc_id"]])] == []


def test_counts_of_long_pages_are_those_of_whole_pages():
    import numpy as np

    rng = np.random.default_rng(4)
    sizes = np.array([5, 0, 700, 3, 256, 257, 512, 1])
    flat = rng.integers(0, 8, sizes.sum())
    model = spam.train([rng.integers(0, 8, 30).tolist() for _ in range(20)], held=50)
    whole = spam.expected(flat, sizes, model, block=1000)
    assert np.isclose(whole.first.sum(), 7) and np.isclose(whole.move.sum(), sizes.sum() - 7) and np.isclose(whole.emit.sum(), sizes.sum())
    for block in (1, 3, 256):
        parts = spam.expected(flat, sizes, model, block=block)
        assert all(np.allclose(getattr(parts, f), getattr(whole, f)) for f in ("first", "move", "emit"))
