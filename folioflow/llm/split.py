"""Splitting oversized texts at natural boundaries by pointer doubling.

Every boundary of a text (paragraph, line and sentence ends; inside stretches that have none, word ends and, failing
these, fixed steps) is joined to its farthest legal successor: the last natural boundary that a piece can reach which
begins ``overlap`` before this boundary, or the last other one if it reaches no natural boundary. Squaring that
successor table again and again, all cuts of the greedy split of all texts of a batch are marked in a number of rounds
that grows with the logarithm of the number of pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run of blanks that ends a line or paragraph, or follows the end of a sentence; or the end of an unspaced sentence.
NATURAL = re.compile(r"[.!?…][\"'”’»)\]]*\s+|\s*\n\s*|[。！？]")
BLANKS = re.compile(r"\s+")
#: The limit of a piece and the overlap, in tokens, and the characters of a token.
LIMIT, OVERLAP, CHARS = 1000, 80, 4
KINDS = ("start", "paragraph", "line", "sentence", "word", "hard", "end")
PARAGRAPH, LINE, SENTENCE, WORD, HARD, END = 1, 2, 3, 4, 5, 6


def boundaries(text: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may end, ascending from 0 to the text's length, and their kinds; no gap is above ``reach``."""
    at, kind = [0], [0]

    def fill(end: int) -> None:
        """Word ends and fixed steps up to ``end``, where natural boundaries are more than ``reach`` apart."""
        if end - at[-1] <= reach:
            return
        for m in [*(m.end() for m in BLANKS.finditer(text, at[-1] + 1, end)), end]:
            while m - at[-1] > reach:
                at.append(at[-1] + reach)
                kind.append(HARD)
            if at[-1] < m < end:
                at.append(m)
                kind.append(WORD)

    for m in NATURAL.finditer(text):
        if at[-1] < m.end() < len(text):
            fill(m.end())
            at.append(m.end())
            lines = m.group().count("\n")
            kind.append(PARAGRAPH if lines > 1 else LINE if lines else SENTENCE)
    fill(len(text))
    if at[-1] < len(text):
        at.append(len(text))
        kind.append(END)
    return np.array(at), np.array(kind)


def successors(at: np.ndarray, kind: np.ndarray, most: int, overlap: int) -> np.ndarray:
    """Index of each boundary's farthest legal successor; the last boundary is its own."""
    limit = np.where(np.arange(len(at)) == 0, 0, at - overlap) + most
    farthest = np.searchsorted(at, limit, "right") - 1
    natural = np.flatnonzero((kind != WORD) & (kind != HARD))
    best = natural[np.searchsorted(natural, farthest, "right") - 1]
    return np.where(best > np.arange(len(at)), best, np.maximum(farthest, np.minimum(np.arange(len(at)) + 1, len(at) - 1)))


def mark_cuts(successor: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which boundaries lie on the paths from ``starts`` to ``ends``, by squaring the successor table."""
    on = np.zeros(len(successor), bool)
    on[starts] = True
    while not on[ends].all():
        on[successor[np.flatnonzero(on)]] = True
        successor = successor[successor]
    return on


def _pieces(most: int, overlap: int, chars: int):
    schema = pa.schema([("id", pa.string()), ("chunk_index", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("token_count", pa.int64()), ("cut", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            tables = [boundaries(t, most - overlap) for t in texts]
            if not tables:
                continue
            base = np.cumsum([0, *(len(a) for a, _ in tables)])
            successor = np.concatenate([successors(a, k, most, overlap) + b for (a, k), b in zip(tables, base)])
            on = mark_cuts(successor, base[:-1], base[1:] - 1)
            rows = []
            for n, (name, text) in enumerate(zip(ids, texts)):
                cut = np.flatnonzero(on[base[n] : base[n + 1]])
                at, kind = tables[n][0][cut], tables[n][1][cut]
                for i in range(1, len(at)):
                    start = max(0, int(at[i - 1]) - overlap) if i > 1 else 0
                    end = int(at[i])
                    rows.append((name, i - 1, start, end, (end - start) // chars, KINDS[kind[i]], text[start:end]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def split_oversized(df: DataFrame, id_col: str, text_col: str, *, limit: int = LIMIT, overlap: int = OVERLAP, chars: int = CHARS) -> DataFrame:
    """Pieces of the texts of more than ``limit`` tokens, a token being ``chars`` code points.

    ``id``, ``chunk_index`` from 0, ``start`` and ``end`` in the text, ``token_count``, ``cut`` (what the piece ends at)
    and ``text``. A piece has at most ``limit`` tokens and begins ``overlap`` tokens before its predecessor's end, or at the text's beginning.
    Texts within the limit, NULL texts and empty tables give nothing; rows that repeat an id are each split for themselves.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    large = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.length("text") >= (limit + 1) * chars)
    kind = "id string, chunk_index int, start long, end long, token_count long, cut string, text string"
    return large.mapInArrow(_pieces(limit * chars + chars - 1, overlap * chars, chars), kind)
