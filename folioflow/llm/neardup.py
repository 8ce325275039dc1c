"""Near-duplicate texts: banded minwise signatures, sequential Bayesian pruning, exact verification.

A text is its set of distinct ``width``-word sequences. Each of BANDS x ROWS minwise hashes agrees between two texts
with probability J, their Jaccard similarity; texts that agree on all rows of some band are candidates. Of each
candidate pair single bits of the signatures are compared in batches of 32: a bit agrees with probability (1+J)/2, and
after each batch the pair is dropped if the posterior probability of J >= threshold, from a uniform prior, is below the
chosen miss probability. The Jaccard similarity of the survivors is computed from their whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.storage import discard, materialize, spread

BANDS, ROWS, BITS, BATCH = 40, 4, 128, 32
WORD = re.compile(r"[^\W_]+")
#: Buckets and classes above these sizes, the same however large the table, are cut into blocks; one class in SAMPLE tells which buckets are.
BUCKET, BLOCK, SAMPLE = 4096, 1024, 16


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def least_matches(threshold: float, miss: float, bits: int = BITS, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest agreeing bits at which P(J >= threshold | bits) is still at least ``miss``."""
    j = (np.arange(4000) + 0.5) / 4000
    p, out = (1 + j) / 2, []
    for n in range(batch, bits + 1, batch):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(log - log.max(axis=1, keepdims=True))
        above = like[:, j >= threshold].sum(axis=1) / like.sum(axis=1)
        out.append(int(np.argmax(above >= miss)))
    return out


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_611)
    n = BANDS * ROWS
    return rng.integers(1, 2**32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)


class Shingler:
    """Word sequences of texts as 32-bit hashes; hashes of words are remembered up to a fixed number."""

    KEPT = 500_000

    def __init__(self, width: int):
        self.width, self.memo = width, {}

    def _word(self, w: str) -> int:
        if len(self.memo) > self.KEPT:
            self.memo.clear()
        h = self.memo[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def __call__(self, text: str) -> np.ndarray:
        """Hashes of the text's word sequences (repeats included: a minimum doesn't mind); empty below ``width`` words."""
        memo, new = self.memo, self._word
        w = [memo[x] if x in memo else new(x) for x in words(text)]
        if len(w) < self.width:
            return np.empty(0, np.uint32)
        h = np.array(w, dtype=np.uint64)
        out = h[: len(h) - self.width + 1].copy()
        with np.errstate(over="ignore"):
            for k in range(1, self.width):
                out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - self.width + 1 + k]
            out ^= out >> np.uint64(32)
            out *= np.uint64(0xD6E8FEB86659FD93)
        return (out >> np.uint64(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x BANDS, uint64) and bit signatures (n x 2, uint64) of non-empty hash lists."""
    a, b = _parameters()
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    mins = np.empty((len(sets), BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        mins[:, k] = np.minimum.reduceat(flat * a[k] + b[k], starts)
    with np.errstate(over="ignore"):
        mixed = (mins ^ (mins >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        mixed ^= mixed >> np.uint32(12)
        keys = np.zeros((len(sets), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + mixed[:, r::ROWS].astype(np.uint64)
    bits = np.packbits((mixed[:, :BITS] >> np.uint32(7)).astype(np.uint8) & 1, axis=1)
    return keys, np.ascontiguousarray(bits).view(np.uint64)


def _band_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(width), set()  # of one task: copies of a text send one set of rows per task

        def flush(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            keys, bits = signatures(sets)
            n = np.array(ids, dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(n, BANDS)), *(pa.array(np.repeat(bits[:, i].copy().view(np.int64), BANDS)) for i in (0, 1))],
                ["bucket", "cls", "s1", "s2"],
            )

        for batch in batches:
            ids, sets, size = [], [], 0
            for cls, k2, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (cls, k2) in seen:
                    continue
                seen.add((cls, k2))
                if len(h := shingle(text)):
                    ids.append(cls)
                    sets.append(h)
                    size += len(h)
                if size > 400_000:
                    yield flush(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield flush(ids, sets)

    return run


def _pairs_in_buckets(least: list[int]):
    """Surviving pairs of each run of equal ``cell`` in rows sorted by it; side -1: pairs of all, else of side 0 with side 1."""

    def compare(x: np.ndarray, y: np.ndarray, cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keep = cols[0][x] != cols[0][y]
        x, y = x[keep], y[keep]
        agree = np.zeros(len(x), np.int64)
        for k, need in enumerate(least):
            word = cols[1 + k // 2]
            part = (word[x] ^ word[y]) >> np.uint64(32 * (k % 2)) & np.uint64(0xFFFFFFFF)
            agree = agree + BATCH - np.bitwise_count(part)
            keep = agree >= need
            x, y, agree = x[keep], y[keep], agree[keep]
        return x, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def emit(cell, side, cols):
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            for n in np.unique(sizes[sizes > 1]):
                at = starts[sizes == n]
                if n <= 64:
                    i, j = np.triu_indices(n, 1)
                    step = max(1, 2_000_000 // len(i))
                    parts = (((at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()) for k in range(0, len(at), step))
                else:
                    parts = ((np.repeat(np.arange(s + k, min(s + k + 256, s + n)), n), np.tile(np.arange(s, s + n), min(256, n - k))) for s in at for k in range(0, n, 256))
                for x, y in parts:
                    if n > 64:
                        keep = x < y
                        x, y = x[keep], y[keep]
                    keep = (side[x] < 0) | (side[x] != side[y])
                    x, y = compare(x[keep], y[keep], cols)
                    if len(x):
                        a, b = cols[0][x], cols[0][y]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            now = [np.asarray(batch.column(k)) for k in range(5)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            cut = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0
            held = [x[cut:].copy() for x in now]
            head = [x[:cut] for x in now]
            if cut:
                yield from emit(head[0], head[4], [head[1], head[2].view(np.uint64), head[3].view(np.uint64)])
        if held is not None and len(held[0]):
            yield from emit(held[0], held[4], [held[1], held[2].view(np.uint64), held[3].view(np.uint64)])

    return run


def _verify(width: int, threshold: float):
    def grams(text: str) -> set:
        w = words(text)
        return set(zip(*(w[k:] for k in range(width))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, last, own = [], None, set()
            for a, a2, b, b2, x, y in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (a, a2) != last:
                    last, own = (a, a2), grams(x)
                other = grams(y)
                both = len(own & other)
                either = len(own) + len(other) - both
                if either and both / either >= threshold:
                    out.append((a, a2, b, b2, both / either))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["a", "a2", "b", "b2", "similarity"])

    return run


def _long_enough(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array([len(words(t)) >= width for t in batch.column(2).to_pylist()], pa.bool_()))

    return run


def _in_cells(rows: DataFrame, key: list[str], hot: DataFrame, member: str) -> DataFrame:
    """Rows with the ``cell`` they are compared in and their ``side`` of it.

    A key listed in ``hot`` with its number of ``blocks`` is cut into them by the hash of ``member``, and each pair of blocks is a cell of
    its own (sides 0 and 1; a block with itself is side -1): no task gets a whole hot key and no pair is lost. ``hot`` is a written
    table, so Spark knows its size: it is sent round while it is small and merge-joined, skewed parts split, where it isn't.
    """
    zero = F.lit(0).cast("long")
    tagged = rows.join(hot, key, "left").withColumn("block", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64(member, F.lit(7)), F.col("blocks"))))
    others = F.when(F.col("blocks").isNull(), F.array(zero)).otherwise(F.sequence(zero, F.col("blocks") - 1))
    cell = F.when(F.col("blocks").isNull(), F.xxhash64(*key)).otherwise(F.xxhash64(*key, F.least("block", "other"), F.greatest("block", "other")))
    side = F.when(F.col("blocks").isNull() | (F.col("block") == F.col("other")), -1).otherwise((F.col("block") > F.col("other")).cast("int"))
    return tagged.withColumn("other", F.explode(others)).withColumns({"cell": cell, "side": side.cast("long")}).drop("blocks", "block", "other")


def _blocks(size: Column, most: int) -> Column:
    """Blocks such that two of them hold about ``most`` members."""
    return F.ceil(size * 2 / most).cast("long").alias("blocks")


def similar_classes(texts: DataFrame, *, width: int = 5, threshold: float = 0.8, miss: float = 1e-4, bucket_size: int = BUCKET, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of similar classes, and the texts that were compared.

    ``texts``: ``cls``, ``k2``, the two halves of a class, and its ``text``; one class is one text, and its rows may repeat.
    The pairs: ``a``, ``a2``, ``b``, ``b2`` (``a`` < ``b``) and their Jaccard ``similarity`` >= ``threshold``. The texts: those of
    candidates and of the classes in ``also``, once each. Texts of fewer than ``width`` words and NULL texts pair with nothing.

    Candidates carry the first half only: two texts that share it send their bands under one name and are verified each for itself.
    Which buckets hold more than ``bucket_size`` classes, whatever the number of texts, is estimated from every 16th class. The estimate
    decides how a bucket is cut and never what is found; that a bucket of twice the size is missed has a probability below 1e-25.
    """
    narrow = texts.select("cls", "k2", "text").where(F.col("text").isNotNull())
    schema = "bucket long, cls long, s1 long, s2 long"
    rows = spread(narrow).mapInArrow(_band_rows(width), schema)
    sampled = narrow.where(F.pmod(F.xxhash64("cls"), F.lit(SAMPLE)) == 0).mapInArrow(_band_rows(width), schema)
    size = (F.count("*") * SAMPLE).alias("size")
    hot = materialize(sampled.groupBy("bucket").agg(size).where(F.col("size") > bucket_size).select("bucket", _blocks(F.col("size"), bucket_size)), "hot")
    cells = _in_cells(rows, ["bucket"], hot, "cls").select("cell", "cls", "s1", "s2", "side")
    found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_pairs_in_buckets(least_matches(threshold, miss)), "a long, b long")
    pairs = materialize(found.distinct(), "candidates")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b"))
    wanted = wanted.union(also.select("cls")) if also is not None else wanted
    # Merge joins at every size: none of these sides has a bound.
    kept = materialize(narrow.join(wanted.distinct().hint("merge"), "cls", "left_semi").dropDuplicates(["cls", "k2"]), "texts")
    left = pairs.hint("merge").join(kept.select(F.col("cls").alias("a"), F.col("k2").alias("a2"), F.col("text").alias("x")), "a")
    both = left.hint("merge").join(kept.select(F.col("cls").alias("b"), F.col("k2").alias("b2"), F.col("text").alias("y")), "b")
    return both.select("a", "a2", "b", "b2", "x", "y").mapInArrow(_verify(width, threshold), "a long, a2 long, b long, b2 long, similarity double"), kept


def class_of(text: Column) -> tuple[Column, Column]:
    """The class of a text, ``cls`` and ``k2``: two 64-bit hashes of it; NULL for NULL. Only texts that agree in both are taken to be one."""
    return F.when(text.isNotNull(), F.xxhash64(text)).alias("cls"), F.when(text.isNotNull(), F.xxhash64(text, F.lit(1))).alias("k2")


def near_duplicate_classes(members: DataFrame, texts: DataFrame, *, width: int = 5, threshold: float = 0.8, miss: float = 1e-4, bucket_size: int = BUCKET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of similar classes, membership, and sizes of classes: the whole result without spelling copies out.

    ``members``: ``id``, ``cls`` and ``k2``, the class of its text; ``texts``: ``cls``, ``k2`` and ``text``, with the text of every
    class. Texts may repeat, and may be of classes without members, as older versions are: so whole texts needn't be shuffled to
    find the current ones. Pairs: ``a``, ``a2``, ``b``, ``b2``. Membership: ``id``, ``cls``, ``k2``, once each; NULL ids and
    texts take no part. Sizes: ``cls``, ``k2``, ``n`` (members), ``first`` (the smallest id), ``alike``: whether its members are
    similar to one another, which texts of fewer than ``width`` words are not.
    """
    member = members.where(F.col("id").isNotNull() & F.col("cls").isNotNull()).select("id", "cls", "k2").distinct()
    size = materialize(member.groupBy("cls", "k2").agg(F.count("*").alias("n"), F.min("id").alias("first")), "classes")
    pairs, kept = similar_classes(texts, width=width, threshold=threshold, miss=miss, bucket_size=bucket_size, also=size.where("n > 1"))
    pairs = materialize(pairs.select("a", "a2", "b", "b2"), "links")
    alike = kept.join(size.where("n > 1").select("cls", "k2"), ["cls", "k2"], "left_semi").mapInArrow(_long_enough(width), "cls long, k2 long")
    return pairs, member, materialize(size.join(alike.withColumn("alike", F.lit(True)), ["cls", "k2"], "left"), "sizes")


def near_duplicate_links(
    members: DataFrame, texts: DataFrame, *, width: int = 5, threshold: float = 0.8, miss: float = 1e-4, bucket_size: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """Every pair ``id_a < id_b`` of different ids with similar texts, copies included, once each.

    Inputs as for :func:`near_duplicate_classes`. Classes of more than ``block`` copies are cut into blocks and spelled out
    a pair of blocks at a time. Ties, repeated rows, NULLs and empty tables need no care: nothing comes from nothing.
    """
    pairs, member, sizes = near_duplicate_classes(members, texts, width=width, threshold=threshold, miss=miss, bucket_size=bucket_size)
    key = ["cls", "k2"]
    hot = materialize(sizes.where(F.col("n") > block).select(*key, _blocks(F.col("n"), block)), "hot")
    number = F.coalesce(F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")), F.lit(0).cast("long"))
    blocked = member.join(hot, key, "left").select(*key, number.alias("block"), "id")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks") - 1, F.lit(0).cast("long"))))
    for side in ("a", "b"):
        mine = hot.withColumnsRenamed({"cls": side, "k2": f"{side}2"})
        pairs = pairs.join(mine, [side, f"{side}2"], "left").withColumn(f"{side}_block", every).drop("blocks")
    left = blocked.withColumnsRenamed({"cls": "a", "k2": "a2", "block": "a_block", "id": "u"})
    right = blocked.withColumnsRenamed({"cls": "b", "k2": "b2", "block": "b_block", "id": "v"})
    across = pairs.join(left, ["a", "a2", "a_block"]).join(right, ["b", "b2", "b_block"]).select(F.least("u", "v").alias("id_a"), F.greatest("u", "v").alias("id_b"))
    several = member.join(sizes.where("n > 1 and alike").select(*key), key, "left_semi")
    cells = _in_cells(several, key, hot, "id").select(*key, "cell", "side", "id")
    other = cells.withColumnsRenamed({"id": "id_b", "side": "other_side"})
    opposite = F.col("id").__lt__(F.col("id_b")) & ((F.col("side") < 0) | (F.col("side") != F.col("other_side")))
    within = cells.join(other, [*key, "cell"]).where(opposite).select(F.col("id").alias("id_a"), "id_b")
    return across.unionByName(within)


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """``id``, ``group``: each linked id with the smallest id of its component (alternating large and small stars).

    The number of rounds grows with the logarithm of the longest chain. Links stay in the shared folder, never on the driver.
    """
    edges = materialize(links.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = (
            least.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        edges, old = materialize(new, "edges"), edges
        discard(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("the components have not settled; raise rounds")
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("group")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct())


def near_duplicate_groups(members: DataFrame, texts: DataFrame, *, width: int = 5, threshold: float = 0.8, miss: float = 1e-4, bucket_size: int = BUCKET) -> DataFrame:
    """One row per id with a non-NULL text: ``id``, ``group`` (the smallest id it is linked with, directly or through others) and ``n_links``.

    Inputs as for :func:`near_duplicate_classes`. ``n_links`` is the number of other ids with a similar text, summed from the sizes of
    classes; components are those of classes, each under its smallest id. Copies are never spelled out.
    """
    key = ["cls", "k2"]
    pairs, member, sizes = near_duplicate_classes(members, texts, width=width, threshold=threshold, miss=miss, bucket_size=bucket_size)
    one, two = {"a": "cls", "a2": "k2", "b": "o", "b2": "o2"}, {"b": "cls", "b2": "k2", "a": "o", "a2": "o2"}
    both = pairs.withColumnsRenamed(one).unionByName(pairs.withColumnsRenamed(two))
    theirs = sizes.select(F.col("cls").alias("o"), F.col("k2").alias("o2"), F.col("n"), F.col("first").alias("other"))
    linked = materialize(both.join(theirs, ["o", "o2"]).join(sizes.select(*key, "first"), key).select(*key, "n", "first", "other"), "linked")
    within = sizes.where("n > 1 and alike").select(*key, F.col("n") - 1)
    degree = linked.select(*key, "n").union(within).groupBy(*key).agg(F.sum("n").alias("n_links"))
    group = components(linked.where("first < other").select(F.col("first").alias("id_a"), F.col("other").alias("id_b")))
    named = sizes.join(degree, key, "left").join(group.withColumnRenamed("id", "first"), "first", "left")
    named = named.select(*key, F.coalesce("group", F.when(F.col("alike"), F.col("first"))).alias("group"), "n_links")
    return member.join(named, key).select("id", F.coalesce("group", "id").alias("group"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
