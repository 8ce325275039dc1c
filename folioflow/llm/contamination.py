"""Evaluation passages inside a corpus: one Aho-Corasick automaton over the items' normalised words.

Any ``run`` consecutive words of an item hold one of its anchors: stretches of half that length, a stride apart. The anchors (items
shorter than ``run`` whole) are the automaton's patterns, a fourteenth of the nodes that all windows would take; each text is
normalised to the same word numbers and scanned once, and a hit is extended to both sides to the whole stretch that item and text
share. A text holds an item if a stretch has ``run`` words, so partial leaks count. The positions of a stretch are mapped back to the
original text, also where lower-casing changes its length.

The machine is built once, on the driver, and shipped; a worker process loads it once. Items beyond MOST_BYTES of automaton go to
further machines, and each of these scans the texts in tasks of its own: a worker never holds two.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.storage import spread

WORD = re.compile(r"[^\W_]+")
#: Bytes of one automaton, at most, and of all items' texts.
MOST_BYTES, MOST_TEXT = 256 << 20, 1 << 30
#: Digits that a word's number is written in for the automaton. Each place has an alphabet of its own, so no hit begins inside a word.
DIGITS = 3


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Machine:
    numbers: dict[str, int]  # from 1; other words are 0
    codes: list[str]
    items: dict[int, list[tuple[int, list[int]]]]  # word numbers of an item's texts, by place in the list of texts
    automaton: ahocorasick.Automaton | None
    run: int

    def scan(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Item to its first stretch's first word, its last one's last word (excluded), and the number of ``run``-word windows in them."""
        out: dict[int, tuple[int, int, int]] = {}
        if self.automaton is None:
            return out
        known = self.numbers
        w = [known.get(x, 0) for x in words(text)]
        codes, seen = self.codes, {}
        for end, anchors in self.automaton.iter("".join([codes[n] for n in w])):
            stop = (end + 1) // DIGITS
            for item, size, offset in anchors:
                name, own = self.items[item]
                a, i = stop - size, offset
                if seen.get((item, a - i), 0) >= stop:
                    continue  # inside a stretch that is known
                b, j, need = stop, offset + size, min(self.run, len(own))
                while a and i and w[a - 1] == own[i - 1]:
                    a, i = a - 1, i - 1
                while b < len(w) and j < len(own) and w[b] == own[j]:
                    b, j = b + 1, j + 1
                seen[item, a - i] = b
                if b - a >= need:
                    first, last, n = out.get(name, (a, b, 0))
                    out[name] = (min(first, a), max(last, b), n + b - a - need + 1)
        return out


def machines(items: list[tuple[int, str]], run: int, most_bytes: int | None = None) -> list[Machine]:
    """The machines that hold the items between them, one unless that would be larger than ``most_bytes``."""
    most = max(1, (most_bytes or MOST_BYTES) // 32)  # nodes
    size, held = (run + 1) // 2, []
    stride = run - size + 1
    numbers: dict[str, int] = {}
    for name, text in items:
        if w := [numbers.setdefault(x, len(numbers) + 1) for x in words(text or "")]:
            held.append((name, w))
    base = max(2, next(b for b in range(2, 1 << 20) if b**DIGITS > len(numbers)))
    codes = ["\uffff" * DIGITS] + ["".join(chr(0x100 + k * base + n // base**k % base) for k in range(DIGITS)) for n in range(1, len(numbers) + 1)]
    out: list[Machine] = []

    def close(patterns: dict[str, list], texts: dict) -> None:
        machine = ahocorasick.Automaton()
        for key, found in patterns.items():
            machine.add_word(key, tuple(found))
        machine.make_automaton()
        used = {n for _, w in texts.values() for n in w}
        mine = numbers if len(texts) == len(held) else {x: n for x, n in numbers.items() if n in used}
        out.append(Machine(mine, codes, texts, machine, run))

    patterns, texts, nodes = {}, {}, 0
    for k, (name, w) in enumerate(held):
        texts[k] = (name, w)
        starts = range(0, len(w) - size + 1, stride) if len(w) >= run else [0]
        n = size if len(w) >= run else len(w)
        for i in starts:
            patterns.setdefault("".join([codes[x] for x in w[i : i + n]]), []).append((k, n, i))
            nodes += n * DIGITS
        if nodes > most:
            close(patterns, texts)
            patterns, texts, nodes = {}, {}, 0
    if patterns:
        close(patterns, texts)
    return out


def spans(text: str) -> list[tuple[int, int]]:
    """Where each word of the normalised text stands in the original."""
    low = text.lower()
    found = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return found
    origin = [i for i, c in enumerate(text) for _ in range(len(c.lower()))]
    return [(origin[a], origin[b - 1] + 1) for a, b in found]


def _scan(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("windows", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value  # loaded once a worker process
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if hits := machine.scan(text):
                    where = spans(text)
                    rows += [(doc, item, where[a][0], where[b - 1][1], n) for item, (a, b, n) in hits.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return task


def leaked_items(
    documents: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", run: int = 12, most: int = 1_000_000, most_bytes: int | None = None
) -> DataFrame:
    """``doc_id``, ``item_id``, ``start``, ``end`` (characters of the text from the first shared stretch to the last), ``windows``.

    A row for each document and item of which the document's words hold ``run`` consecutive words, or all words of a
    shorter item. Items without a word, NULL texts and NULL ids match nothing; repeated items and documents match each for
    itself. The items are a held-out set of bounded size: above ``most`` of them, or MOST_TEXT characters, this raises before it
    collects them. Machines of more than ``most_bytes`` (MOST_BYTES) are split by items, and each part scans all texts.
    """
    held = items.select(F.col(item_col), F.col(item_text)).where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull())
    n, size = held.agg(F.count("*"), F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()
    if n > most or size > MOST_TEXT:
        raise ValueError(f"{n} evaluation items of {size} characters; at most {most} of {MOST_TEXT} are taken")
    context = documents.sparkSession.sparkContext
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = spread(texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()))
    kind = "doc_id long, item_id long, start long, end long, windows long"
    built = machines(sorted(tuple(r) for r in held.collect()), run, most_bytes) or [Machine({}, [], {}, None, run)]
    parts = [texts.mapInArrow(_scan(context.broadcast(machine)), kind) for machine in built]
    return functools.reduce(DataFrame.unionByName, parts)
