"""Defects of prompt-response pairs: empty, truncated, refusal, copy and other_language.

Copies are measured with a suffix automaton of the prompt's words: the response is traversed through it, and the words
that belong to a stretch shared with the prompt are covered. Refusals are found by an Aho-Corasick automaton over refusal
phrases. Truncation is judged by a stack of delimiters, by markers, and by how the last sentence or list item ends.
Languages are voted for by common words, in the response only by words that are not copied from the prompt.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)*")
MARKUP = re.compile(r"<[^<>]*>|&[a-z]+;|```\w*")
MARKER = re.compile(r"[\[(<{]\s*(?:cut|truncated|cut off|continued|tronqué|gekürzt|cortado)\s*[\])>}]\s*$|(?:\.\.\.|…)[\"'”’»)\]]*\s*$", re.I)
FINISHED = re.compile(r"[.!?。！？][\"'”’»)\]`*]*\s*$")
CLOSED = re.compile(r"[)\]}`\"”»'’]\s*$")
INNER = re.compile(r"[.!?。！？][\"'”’»)\]]*\s+\S")
ITEM = re.compile(r"\s*(?:[-*•–]|\d+[.)]|[a-z][.)])\s+", re.I)
LEAD = re.compile(r"^\s*(?:you (?:ask|asked|want to know)|your question|question|query|q|a|answer|vous demandez|sie fragen|usted pregunta|frage|pregunta|antwort|réponse|respuesta)\s*:\s*", re.I | re.M)
OPEN, CLOSE = "([{“«", ")]}”»"

# What stands for an answer that isn't there.
PLACEHOLDERS = frozenset(
    "none|n a|na|null|nil|nan|tbd|tba|tbc|todo|answer|no answer|response|output|result|undefined|unknown|empty|blank|placeholder|"
    "antwort|keine antwort|réponse|pas de réponse|aucune réponse|respuesta|sin respuesta|answer here|insert answer here|your answer here|lorem ipsum".split("|")
)
# How answers are declined, in normalised words.
REFUSALS = (
    "i can't help|i cannot help|i can't assist|i cannot assist|i can assist with|can't help with that|i am unable to|i'm unable to|i am not able to|i'm not able to|"
    "i can't answer|i cannot answer|i can't provide|i cannot provide|i can't comment|i cannot comment|i can't discuss|i cannot discuss|i can't respond|i cannot respond|"
    "i won't be able to|i will not answer|i won't answer|i refuse to|i must decline|i have to decline|i decline to|i'd rather not|i would rather not|i prefer not to|i'd prefer not to|"
    "told not to respond|told not to answer|not allowed to|not permitted here|are not permitted|is not permitted|i am not permitted|i'm not permitted|outside what i|outside my scope|"
    "do not have enough information|don't have enough information|not enough information to answer|no answer is possible|no answer can be given|cannot be answered|"
    "that is not something i can|this is not something i can|ask someone else about|against my guidelines|as an ai|"
    "darf ich leider nicht|darf ich nicht beantworten|dazu kann ich nichts sagen|kann ich leider nicht|kann ich nicht beantworten|ich kann diese frage nicht|ich kann ihnen dabei nicht|dabei kann ich nicht helfen|das kann ich nicht sagen|darüber darf ich|liegen mir keine angaben vor|liegen mir keine informationen vor|"
    "ne suis pas autorisé|ne suis pas en mesure|ne peux pas répondre|ne peux pas vous aider|ne peux pas aider|ne puis répondre|il m'est impossible de répondre|je refuse de|je n'ai aucune information|"
    "no puedo ayudar|no puedo responder|no puedo contestar|no tengo permiso|no estoy autorizado|no me es posible responder|no puedo hablar de|me niego a|no dispongo de información"
).split("|")
# Words after which a sentence can't end.
DANGLING = frozenset(
    "the a an of to and or but with for from in on at by as that which whose because if when while than is are was were be its their our this these "
    "der die das den dem des ein eine einen einem einer und oder aber mit von zu zum zur im am für auf dass weil wenn als "
    "le la les un une des du de et ou mais avec pour dans sur par que qui si "
    "el los las una unos del y o pero con para en por al su sus".split()
)
CONTRAST = frozenset("but however although aber jedoch mais cependant pero".split())
# Words of questions and requests, besides the common words given.
ASKING = {
    "en": "what which who how why when where does do explain compare give tell is are please i you yes it for of the and to with respect better than sorry",
    "de": "was welche welcher wer wie warum wann wo macht ist erkläre vergleiche gib bitte ich du sie ja mir kann darf leid diese dieser nichts leider frage",
    "fr": "que quoi quel quelle qui comment pourquoi quand où fait est explique compare donne je vous oui avec suis pas cette peux désolé chaque avant",
    "es": "qué cuál quién cómo cuándo dónde hace es explica compara dame yo usted sí con antes cada puedo tengo esa siento está",
}
NAMED = {
    "en": ("english", "englisch", "anglais", "inglés", "ingles"),
    "de": ("german", "deutsch", "allemand", "alemán", "aleman"),
    "fr": ("french", "französisch", "français", "francés", "frances"),
    "es": ("spanish", "spanisch", "espagnol", "español", "espanol"),
}
REQUEST = re.compile(r"(?:\bin|\bauf|\ben|\bins|\binto|\bau|\bal)\s+([^\W\d_]+)", re.I)


def words(text: str) -> list[str]:
    return [w.replace("’", "'") for w in WORD.findall(text.casefold())]


class SuffixAutomaton:
    """All stretches of a sequence of words; traversed word by word it tells the longest one that ends here."""

    def __init__(self, sequence: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in sequence:
            state, at = len(self.next), last
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            while at >= 0 and w not in self.next[at]:
                self.next[at][w] = state
                at = self.link[at]
            if at >= 0:
                to = self.next[at][w]
                if self.length[at] + 1 == self.length[to]:
                    self.link[state] = to
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[to]))
                    self.length.append(self.length[at] + 1)
                    self.link.append(self.link[to])
                    while at >= 0 and self.next[at].get(w) == to:
                        self.next[at][w] = copy
                        at = self.link[at]
                    self.link[to] = self.link[state] = copy
            last = state

    def covered(self, sequence: list[str], least: int) -> list[bool]:
        """Which words lie in a stretch of at least ``least`` words of the automaton's sequence."""
        out, state, size, marked = [False] * len(sequence), 0, 0, 0
        for i, w in enumerate(sequence):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            else:
                size = 0
            if size >= least:  # stretches begin ever later: what is marked stays marked, and each word is marked once
                marked = max(marked, i - size + 1)
                out[marked : i + 1] = [True] * (i + 1 - marked)
                marked = i + 1
        return out


# Parts that refusals are made of, by language: who declines, how, and what. Any sequence of the three is a refusal.
PARTS = {
    "en": (
        "i|we|this assistant|the assistant",
        "cannot|can't|can not|could not|couldn't|will not|won't|am unable to|are unable to|is unable to|am not able to|are not able to|am not in a position to|do not wish to|must refuse to|must decline to|have to refuse to",
        "help|assist|answer|respond|reply|comment|discuss|disclose|share|reveal|give you|tell you|provide|offer|say anything|advise|speak about|talk about|go into",
    ),
    "de": (
        "ich|wir",
        "kann|können|darf|dürfen|möchte|werde",
        "dazu nichts sagen|dazu keine auskunft geben|keine auskunft geben|darauf nicht antworten|das nicht beantworten|die frage nicht beantworten|nicht weiterhelfen|ihnen nicht helfen|dir nicht helfen|hier nicht helfen",
    ),
    "fr": ("je|nous", "ne peux pas|ne peux|ne pouvons pas|ne puis|ne suis pas en mesure de|ne souhaite pas|dois refuser de", "répondre|vous aider|t'aider|aider|vous renseigner|fournir|donner|discuter|commenter|en parler|dire"),
    "es": ("", "no puedo|no podemos|no debo|no quiero|no estoy en condiciones de", "ayudar|ayudarle|ayudarte|responder|contestar|comentar|hablar|proporcionar|ofrecer|dar|decir|revelar|compartir"),
}


def refusals() -> list[str]:
    """Every refusal that the fixed phrases and parts make."""
    made = [" ".join(x for x in parts if x) for several in PARTS.values() for parts in itertools.product(*(p.split("|") for p in several))]
    return sorted({*REFUSALS, *made})


def refusal_automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase in refusals():
        machine.add_word(f" {phrase} ", len(phrase) + 1)
    machine.make_automaton()
    return machine


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    w = words(MARKUP.sub(" ", answer))
    return not w or " ".join(w) in PLACEHOLDERS


def is_refusal(answer: str, machine: ahocorasick.Automaton) -> bool:
    """Declines, and doesn't go on in the same sentence with "but" and an answer."""
    text = LEAD.sub("", answer)
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text):
        w = words(sentence)
        line = f" {' '.join(w)} "
        for end, _ in machine.iter(line):
            rest = line[end:].split()
            turn = next((i for i, x in enumerate(rest) if x in CONTRAST), len(rest))
            if len(rest) - turn < 5:
                return True
    return False


def is_copy(query: str, answer: str, machine: SuffixAutomaton, size: int) -> bool:
    """Every line of the answer, lead-ins aside, is for the greater part a stretch of the query, and most of the query is there."""
    lines = [x for x in LEAD.sub("", answer).split("\n") if words(x)]
    if size < 3 or not lines:
        return False
    total = 0
    for line in lines:
        w = words(line)
        n = sum(machine.covered(w, min(2, len(w))))
        if n < 0.7 * len(w):
            return False
        total += n
    return total >= 0.7 * size


def is_truncated(answer: str) -> bool:
    text = answer.rstrip()
    if MARKER.search(text):
        return True
    if text.count("```") % 2:
        return True
    prose = re.sub(r"```.*?```", " ", text, flags=re.S)
    if prose.count("`") % 2 or prose.count('"') % 2:
        return True
    stack: list[str] = []
    for i, c in enumerate(prose):
        if c in OPEN:
            stack.append(c)
        elif c in CLOSE and stack and OPEN[CLOSE.index(c)] == stack[-1]:
            stack.pop()
    if stack:
        return True
    if text.endswith("```"):
        return False
    last = text.split("\n")[-1]
    item = ITEM.match(last)
    last = last[item.end() :] if item else last
    if FINISHED.search(last):
        return False
    if re.search(r"(?:[,:;(\[{/&+]|--?|[–—])\s*$", last):
        return bool(words(last)) or len(text.split("\n")) > 1
    w = words(last)
    if w and w[-1] in DANGLING:
        return True
    if CLOSED.search(last):
        return False
    return bool(INNER.search(last)) or (not item and len(w) >= 7)


def votes(w: list[str], common: dict[str, dict[str, float]]) -> dict[str, float]:
    """Each word's vote is shared by the languages it is common in."""
    out: dict[str, float] = {}
    for x in w:
        for lang, part in common.get(x, {}).items():
            out[lang] = out.get(lang, 0) + part
    return out


def in_other_language(query: str, answer: str, own: list[bool], answer_words: list[str], common: dict[str, dict[str, float]]) -> bool:
    asked = votes(words(query), common)
    if not asked:
        return False
    best = max(asked.values())
    wanted = {lang for lang, n in asked.items() if n >= 0.8 * best}
    names = {m.casefold() for m in REQUEST.findall(query)}
    wanted |= {lang for lang, known in NAMED.items() if names & set(known)}
    got = votes([w for w, copied in zip(answer_words, own) if not copied], common)
    if not got:
        return False
    top = max(got.values())
    return top >= 1.5 and top > 1.5 * max(got.get(lang, 0) for lang in wanted)


def defects(query: str | None, answer: str | None, machine, common) -> list[str]:
    if is_empty(answer):
        return ["empty"]
    query = query or ""
    asked, out = words(query), []
    automaton = SuffixAutomaton(asked)
    copied = is_copy(query, answer, automaton, len(asked))
    if copied:
        out.append("copy")
    if is_refusal(answer, machine):
        out.append("refusal")
    rest = LEAD.sub("", answer)
    w = words(rest)
    if not copied and is_truncated(answer):
        out.append("truncated")
    if not copied and in_other_language(query, rest, automaton.covered(w, 4), w, common):
        out.append("other_language")
    return out


def shared_votes(rows: list[tuple[str, str]]) -> dict[str, dict[str, float]]:
    langs: dict[str, set[str]] = {}
    for lang, word in [*rows, *((lang, w) for lang, text in ASKING.items() for w in text.split())]:
        langs.setdefault(word.casefold(), set()).add(lang)
    return {w: {lang: 1 / len(of) for lang in of} for w, of in langs.items()}


def _run(common):
    schema = pa.schema([("query_id", pa.int64()), ("defect", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = refusal_automaton()
        for batch in batches:
            rows = [(i, d) for i, q, a in zip(*(batch.column(k).to_pylist() for k in range(3))) for d in defects(q, a, machine, common)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(schema)], schema=schema)

    return run


def defective_pairs(pairs: DataFrame, common_words: DataFrame, *, id_col: str = "query_id", query_col: str = "query", answer_col: str = "answer", most: int = 20_000) -> DataFrame:
    """``query_id``, ``defect``: each defect of each pair once.

    NULL answers are ``empty``; a NULL query can neither be copied nor set a language. Pairs without an id are left out, and
    replays of a pair count once. ``common_words`` (``lang``, ``word``) is a fixed vocabulary; above ``most`` words this raises.
    """
    rows = [(r[0], r[1]) for r in common_words.select("lang", "word").where("lang is not null and word is not null").distinct().limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} common words")
    narrow = pairs.select(F.col(id_col).cast("long").alias("query_id"), F.col(query_col).alias("query"), F.col(answer_col).alias("answer"))
    narrow = narrow.where(F.col("query_id").isNotNull()).distinct()
    return narrow.mapInArrow(_run(shared_votes(sorted(rows))), "query_id long, defect string").distinct()
