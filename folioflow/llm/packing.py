"""Filling fixed-capacity sequences with texts: pattern packing by non-negative least squares.

Only the histogram of lengths (at most ``capacity`` numbers) reaches the driver. There, patterns of up to three lengths
that fill the capacity exactly, or an exact half, quarter or eighth of it several times over, are enumerated; repeat
counts are fitted to the histogram by non-negative least squares, first of all patterns, then of a bounded number of them drawn evenly
along the first fit, and rounded; what is left is packed best-fit, longest first, in bulk. The resulting plan says for every range
of ranks among the texts of one length which sequences they go to; a text finds its range by one sorted search. Ranks are counted
per length and salt, so a length that a third of all texts share is no hot group.

The plan's size depends on the capacity alone: at most SUPPORT x capacity patterns of three lengths, and two best-fit groups a length
(a step of :func:`best_fit` either ends a length or moves a whole group).
"""

from __future__ import annotations

import importlib.util
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.storage import materialize

TOKENIZERS = "/opt/tokenizers"
#: Parts of the capacity that a pattern fills; rounds of the first fit, and of that of the chosen patterns; texts counted in one salt, at most.
PARTS, ROUNDS, REFINED, PER_SALT = (1, 2, 4, 8), 40, 2000, 1_000_000
#: Patterns chosen, in capacities; sequences that a chosen pattern should have, at least (fewer make rounding dominate).
SUPPORT, REPEATS = 4, 4


def tokenizer(folder: str, name: str):
    """An encoder of the public byte-pair vocabulary ``name`` in ``folder``."""
    import base64

    import tiktoken

    spec = importlib.util.spec_from_file_location("_tokenizers", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


_loaded: dict = {}


def _count(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (folder, name) not in _loaded:  # once a worker process
            _loaded[folder, name] = tokenizer(folder, name)
        encode = _loaded[folder, name].encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t)) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "tokens"])

    return run


def patterns(present: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Triples of lengths (0: none) with the number of times each is repeated to fill ``capacity`` exactly."""
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    has[0] = True
    triples, times = [], []
    for part in PARTS:
        if capacity % part:
            continue
        room = capacity // part
        own = np.flatnonzero(has[: room + 1])
        for a in own[own * 3 >= room]:
            b = own[(own <= a) & (own * 2 >= room - a) & (own <= room - a)]
            b = b[has[room - a - b]]
            triples.append(np.stack([np.full(len(b), a), b, room - a - b], 1))
            times.append(np.full(len(b), part))
    if not triples:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    return np.concatenate(triples), np.concatenate(times)


def fit(histogram: np.ndarray, triples: np.ndarray, times: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |Ax - histogram|, weighted by length, by accelerated projected gradients."""
    size = len(histogram)
    weight = np.arange(size, dtype=float) / size
    weight[0] = 0
    share = weight[triples] * times[:, None]

    def down(x):
        return np.bincount(triples.ravel(), (share * x[:, None]).ravel(), size)

    target, x = weight * histogram, np.zeros(len(triples))
    v = np.full(len(triples), 1 / max(1, len(triples)) ** 0.5)
    for _ in range(12):  # the largest singular value
        v = (share * down(v)[triples]).sum(1)
        norm = np.linalg.norm(v)
        v /= norm or 1
    step, y, t = 1 / max(norm * 1.05, 1e-12), x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y + step * (share * (target - down(y))[triples]).sum(1))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


def choose(x: np.ndarray, triples: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` patterns, in even steps along the repeat counts ``x`` in the order of their lengths: alike patterns stand for one another."""
    order = np.lexsort((triples[:, 1], triples[:, 0]))
    total = np.cumsum(x[order])
    return order[np.unique(np.searchsorted(total, (np.arange(most) + 0.5) * total[-1] / most))]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to number of texts) and how many sequences follow each; every text of the histogram is in one.

    ``histogram[n]`` texts have length n, n from 1 to ``capacity``.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[dict[int, int], int]] = []
    triples, times = patterns(np.flatnonzero(left), capacity)
    x = fit(left, triples, times)
    if x.sum() >= 1:
        chosen = choose(x, triples, min(SUPPORT * capacity, max(1, int(x.sum() / REPEATS))))
        triples, times = triples[chosen], times[chosen]
        x = np.rint(fit(left, triples, times, REFINED))
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            content: dict[int, int] = defaultdict(int)
            for length in triples[k]:
                if length:
                    content[int(length)] += int(times[k])
            n = min(int(x[k]), *(int(left[length]) // m for length, m in content.items()))
            if n > 0:
                out.append((dict(content), n))
                for length, m in content.items():
                    left[length] -= n * m
    return out + best_fit(left, capacity)


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram; sequences with the same content are handled together."""
    rooms: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    open_ = np.zeros(capacity + 1, bool)

    def put(content, n, room):
        if n:
            rooms[room].append((content, n))
            open_[room] = True

    for length in np.flatnonzero(histogram)[::-1].tolist():
        n = int(histogram[length])
        while n:
            fitting = np.flatnonzero(open_[length:])
            if len(fitting):
                room = length + int(fitting[0])
                content, m = rooms[room].pop()
                open_[room] = bool(rooms[room])
            else:
                room, content, m = capacity, {}, -(-n // (capacity // length))
            each = min(room // length, n)
            full = min(m, n // each)
            put(content | {length: each}, full, room - each * length)
            n -= full * each
            put(content, m - full, room)
            if content == {} and m > full:  # the last new sequence takes what remains
                rooms[room].pop()
                open_[room] = bool(rooms[room])
                put({length: n}, 1 if n else 0, room - n * length)
                n = 0
    return [group for groups in rooms.values() for group in groups]


@dataclass
class Steps:
    """A plan as arrays sorted by ``key``, length and first rank of a range of texts."""

    key: np.ndarray
    low: np.ndarray
    first: np.ndarray  # sequence of the range's first texts
    times: np.ndarray  # texts of the length in a sequence
    at: np.ndarray  # position of the first of them
    sequences: int

    SHIFT = 44  # ranks are below 2 ** 44

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and position of each text."""
        k = np.searchsorted(self.key, (length << self.SHIFT) | rank, "right") - 1
        turn = rank - self.low[k]
        return self.first[k] + turn // self.times[k], self.at[k] + turn % self.times[k] * length


def steps(packed: list[tuple[dict[int, int], int]]) -> Steps:
    used: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for content, n in packed:
        at = 0
        for length, m in sorted(content.items(), reverse=True):
            rows.append((length << Steps.SHIFT | used[length], used[length], first, m, at))
            used[length] += n * m
            at += length * m
        first += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Steps(*table, first)


def _place(shared, capacity: int):
    names = ["doc_id", "piece", "token_start", "n_tokens", "sequence_id", "position"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, length, rank = (np.asarray(batch.column(k)) for k in (1, 2, 3))
            sequence, position = shared.value.find(length, rank)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (whole * capacity, length, sequence, position))], names)

    return run


def pack(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id``, ``piece``, ``token_start``, ``n_tokens``, ``sequence_id``, ``position``, ``tokenizer``: where every text goes.

    Texts of more than ``capacity`` tokens, and only those, are cut into pieces of exactly that size and a rest. NULL and
    empty texts have no tokens and go nowhere; rows that repeat an id are placed each for itself; an empty table gives an empty
    result.
    """
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    counted = materialize(texts.mapInArrow(_count(folder, name), "doc_id long, tokens long"), "tokens")
    spark, rest = documents.sparkSession, F.col("tokens") % capacity
    total = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.floor(F.col("tokens") / capacity)), F.lit(0)).alias("whole")).first()
    lengths = counted.where(rest > 0).groupBy(rest.alias("length")).count().collect()  # fewer rows than the capacity
    histogram = np.zeros(capacity + 1, np.int64)
    for r in lengths:
        histogram[r["length"]] = r["count"]
    found = steps(plan(histogram, capacity))
    sequences, shared = found.sequences, spark.sparkContext.broadcast(found)

    salts = max(16, total["n"] // PER_SALT)

    def ranked(df: DataFrame, keys: list[str]) -> DataFrame:
        """Ranks from 0 within ``keys``, counted salt by salt."""
        salted = df.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        sizes = salted.groupBy(*keys, "salt").count()
        before = F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = F.row_number().over(Window.partitionBy(*keys, "salt").orderBy("doc_id", *[c for c in df.columns if c == "piece"]))
        return salted.withColumn("own", own).join(sizes.withColumn("before", before).drop("count"), [*keys, "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)

    pieces = counted.select("doc_id", F.floor(F.col("tokens") / capacity).alias("whole"), rest.alias("length"), "tokens")
    tails = ranked(pieces.where("length > 0"), ["length"]).select("doc_id", "whole", "length", F.col("rank").cast("long").alias("rank"))
    tails = tails.mapInArrow(_place(shared, capacity), "doc_id long, piece long, token_start long, n_tokens long, sequence_id long, position long")
    whole = pieces.where("whole > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece"))
    whole = ranked(whole.withColumn("length", F.lit(capacity).cast("long")), ["length"]).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("token_start"), F.lit(capacity).cast("long").alias("n_tokens"), (F.col("rank") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("position")
    )
    return tails.unionByName(whole).withColumn("tokenizer", F.lit(name))
