"""Most similar vectors for every vector, by additive quantisation.

Codebooks: LEVELS full-dimensional books, each trained by k-means on what the books before it leave over (a bounded
sample of vectors chosen by hash). Encoding keeps a beam of partial sums and takes the best complete one. The first code names the
inverted list a vector is stored in; there are about four times as many lists as the square root of the number of vectors, and groups of
the sample get lists by their size, so that dense regions are cut finely. A query visits the list that suits it best and those that suit it
almost as well, few in clear cases and up to ``probes`` in doubtful ones. There it is
scored against all codes through lookup tables and the stored norms of the sums, and the best are scored again exactly. If
another member can still be among the best, by how far it lies from its sum, all members are scored exactly: in the lists a
query visits nothing is lost. With ``probes=ALL`` every vector is looked at, in blocks that needn't be lists.

Every vector is indexed. Identical vectors are searched once: each group of copies keeps its k + 1 smallest ids, which is
all that any top-k can hold of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.storage import materialize

#: Vectors the codebooks are fitted on, at least this many and PER_LIST for each list; codebooks after the first; their entries; width of the beam.
TRAINED_ON, PER_LIST, LEVELS, ENTRIES, BEAM = 40_000, 8, 6, 64, 4
#: Vectors of a list, at least, on average.
MEMBERS = 128
#: Lists at most (the sample is bounded with them); lists a query visits at most; by how much one may suit it less than the best is told below.
MOST_LISTS, PROBES = 65_536, 32
#: That margin: GAP, and more where lists are few and therefore wide (WIDER over the root of their number).
GAP, WIDER = 0.06, 0.9
#: Exactly scored candidates per query and list; members of a list, and queries, that meet in one task.
SHORTLIST, BLOCK, ASKS = 64, 16_384, 65_536
#: As ``probes``: look at every vector.
ALL = 1 << 30
#: A candidate of the shortlist is scored exactly at once if its looked-up cosine is at most this much below the floor.
SLACK = 0.3


def usable(embedding: Column, dim: int) -> Column:
    """Arrays of ``dim`` finite numbers that are not all zero; NULL arrays and NULL entries are not usable."""
    wide = F.lit(float("inf"))
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < wide))
    return F.coalesce((F.size(embedding) == dim) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


@dataclass
class Codebooks:
    """The first code names the list a vector is stored in. ``stored`` and ``asking``: the shares of vectors that lie in each list, and visit it."""

    books: list[np.ndarray]
    stored: np.ndarray
    asking: np.ndarray

    @property
    def lists(self) -> int:
        return len(self.books[0])

    def encode(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x books) of unit vectors by beam search, and the lists each visits (n x ``probes``, -1 for none), best first."""
        score = x @ self.books[0].T - (self.books[0] ** 2).sum(1) / 2
        keep = min(max(probes, BEAM), self.lists)
        best = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)
        score = np.take_along_axis(score, best, 1)
        near = np.where(score >= score[:, :1] - (GAP + WIDER / self.lists**0.5), best, -1)[:, :probes]
        states, score = best[:, :BEAM, None], score[:, :BEAM]
        sums = self.books[0][states[:, :, 0]]
        for book in self.books[1:]:
            gain = (x @ book.T - (book**2).sum(1) / 2)[:, None, :] - sums @ book.T  # what the new entry shares with the sum so far doesn't count twice
            total = (score[:, :, None] + gain).reshape(len(x), -1)
            keep = min(BEAM, total.shape[1])
            top = np.argpartition(-total, keep - 1, axis=1)[:, :keep]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(total, top, 1), axis=1, kind="stable"), 1)
            score = np.take_along_axis(total, top, 1)
            state, entry = np.divmod(top, len(book))
            states = np.concatenate([np.take_along_axis(states, state[:, :, None].repeat(states.shape[2], 2), 1), entry[:, :, None]], 2)
            sums = np.take_along_axis(sums, state[:, :, None], 1) + book[entry]
        return states[:, 0], near


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _closest(x, centres)
        order = np.argsort(near, kind="stable")
        filled, starts = np.unique(near[order], return_index=True)
        centres[filled] = np.add.reduceat(x[order], starts) / np.diff(np.r_[starts, len(x)])[:, None]
        empty = np.setdiff1d(np.arange(k), filled)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres, near


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step, half = max(16, 16_000_000 // len(centres)), (centres**2).sum(1) / 2
    return np.concatenate([(x[i : i + step] @ centres.T - half).argmax(1) for i in range(0, len(x), step)])


def _list_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres in two steps: groups, and in each a number of centres that follows its size, however tight it is."""
    if k <= 64:
        return _kmeans(x, k, rng)[0]
    groups, near = _kmeans(x, int(k**0.5), rng)
    size = np.bincount(near, minlength=len(groups))
    share = size * (k / len(x))
    own = np.where(size > 0, np.maximum(1, share.astype(int)), 0)
    for g in np.argsort(own - share)[: max(0, k - own.sum())]:
        own[g] += size[g] > 0
    return np.concatenate([_kmeans(x[near == g], min(int(n), int(size[g])), rng)[0] for g, n in enumerate(own) if n])


def fit(sample: np.ndarray, lists: int, probes: int = PROBES) -> Codebooks:
    rng, rest = np.random.default_rng(7), sample.astype(np.float32)
    books = [_list_centres(rest, max(1, min(lists, len(sample))), rng)]
    stored = _closest(rest, books[0])
    rest = rest - books[0][stored]
    for _ in range(LEVELS):
        book, near = _kmeans(rest, min(ENTRIES, max(1, len(sample))), rng)
        books.append(book)
        rest = rest - book[near]
    model = Codebooks(books, np.bincount(stored, minlength=len(books[0])) / len(sample), np.empty(0))
    some, step = sample[:10_000].astype(np.float32), max(16, 16_000_000 // model.lists)
    visited = np.concatenate([model.encode(some[i : i + step], min(probes, PROBES))[1].ravel() for i in range(0, len(some), step)])
    model.asking = np.bincount(visited[visited >= 0], minlength=model.lists) / len(some)
    return model


def _unit(packed: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), np.float32).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


ROWS = pa.schema(
    [("cell", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("gid", pa.int64()), ("asks", pa.bool_()), ("stored", pa.bool_()), ("first", pa.string()), ("codes", pa.binary()), ("vec", pa.binary())]
)
KIND = "cell int, block int, part int, gid long, asks boolean, stored boolean, first string, codes binary, vec binary"


def _repeated(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place as often as ``times`` says, and the number of each repeat."""
    return np.repeat(np.arange(len(times)), times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def _spread(model: Codebooks, blocks: np.ndarray, parts: np.ndarray, dim: int, probes: int, asking: bool, storing: bool):
    """A vector as a query, in every block of each list it visits, and as a member, in every part of the queries of its own list.

    Its code as a member names block and part by hash; a row that is query and member at once serves as both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = int(np.clip(16_000_000 // model.lists, 16, 2000))
        for big in batches:
            for start in range(0, big.num_rows, step):
                batch = big.slice(start, step)
                gid = np.asarray(batch.column(0))
                mixed = gid.view(np.uint64)
                x = _unit(batch.column(2).to_pylist(), dim).astype(np.float32)
                if probes >= ALL:
                    codes = model.encode(x, 1)[0]
                    own = np.zeros(len(gid), np.int64)
                    near = own[:, None]
                else:
                    codes, near = model.encode(x, probes)
                    own = codes[:, 0]
                home = ((mixed >> np.uint64(20)) % blocks[own].astype(np.uint64)).astype(np.int64)
                part = lambda cell, row: ((mixed[row] >> np.uint64(8)) % parts[cell].astype(np.uint64)).astype(np.int64)
                columns = []
                if asking:
                    row, place = np.nonzero(near >= 0)
                    cell = near[row, place]
                    k, block = _repeated(blocks[cell])
                    row, cell = row[k], cell[k]
                    both = (cell == own[row]) & (block == home[row]) if storing else np.zeros(len(row), bool)
                    columns.append((row, cell, block, part(cell, row), np.ones(len(row), bool), both))
                if storing:
                    row, number = _repeated(parts[own])
                    cell = own[row]
                    if asking:  # its own list is always visited first
                        keep = number != part(cell, row)
                        row, number, cell = row[keep], number[keep], cell[keep]
                    columns.append((row, cell, home[row], number, np.zeros(len(row), bool), np.ones(len(row), bool)))
                row, cell, block, number, asks, stored = map(np.concatenate, zip(*columns))
                packed = pa.array([c.tobytes() for c in codes.astype(np.uint16)], pa.binary())
                index, kept = pa.array(row), pa.array(~stored)
                nothing = lambda column: pc.if_else(kept, pa.scalar(None, column.type), column.take(index))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(v.astype(np.int32)) for v in (cell, block, number)), batch.column(0).take(index), pa.array(asks), pa.array(stored), nothing(batch.column(1)), nothing(packed), batch.column(2).take(index)],
                    schema=ROWS,
                )

    return run


def _score(model: Codebooks, dim: int, k: int, floor: float, shortlist: int):
    schema = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("first", pa.string()), ("cosine", pa.float64())])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        stored = np.asarray(group["stored"])
        asks = np.flatnonzero(np.asarray(group["asks"]))
        if not stored.any() or not len(asks):
            return schema.empty_table()
        gid = np.asarray(group["gid"])
        x = _unit(group["vec"].to_pylist(), dim)
        at = np.flatnonzero(stored)
        first = np.array(group["first"].take(pa.array(at)).to_pylist(), dtype=object)
        order = np.argsort(first, kind="stable")  # equal scores then rank by id
        at, first = at[order], first[order]
        member, member_gid = x[at], gid[at]
        codes = np.frombuffer(b"".join(group["codes"].take(pa.array(at)).to_pylist()), np.uint16).reshape(len(at), -1).astype(np.int64)
        used, codes[:, 0] = np.unique(codes[:, 0], return_inverse=True)  # one list, or the few of a block
        books = [model.books[0][used], *model.books[1:]]
        whole = sum(book[codes[:, m]] for m, book in enumerate(books))
        norm = np.linalg.norm(whole, axis=1).astype(np.float32)
        norm[norm == 0] = 1
        # How far a member lies from the direction of its sum: what a looked-up score can be wrong by.
        along = (np.einsum("nd,nd->n", member, whole / norm[:, None])[:, None]).astype(np.float32)
        aside = np.sqrt(np.maximum(0, 1 - along * along))
        width = min(k, len(at))
        out: list[list] = [[], [], [], []]
        r = min(shortlist, len(at))
        step = max(1, min(1024, 4_000_000 // len(at)))
        for s in range(0, len(asks), step):
            ask = asks[s : s + step]
            q = x[ask].astype(np.float32)
            score = np.zeros((len(at), len(ask)), np.float32)
            for m, book in enumerate(books):
                score += (book @ q.T)[codes[:, m]]
            score /= norm[:, None]
            near = np.argpartition(-score, r - 1, axis=0)[:r] if r < len(at) else np.broadcast_to(np.arange(r)[:, None], score.shape)
            likely = (np.take_along_axis(score, near, 0) >= floor - SLACK).T
            np.clip(score, -1, 1, out=score)
            most = np.where(score >= along, np.float32(1), score * along + np.sqrt(1 - score * score) * aside)  # the greatest cosine it can have
            np.put_along_axis(most, near, np.where(likely.T, np.float32(-2), np.take_along_axis(most, near, 0)), 0)
            near = np.ascontiguousarray(near.T)
            cosine = np.full(near.shape, -2.0)
            i, j = np.nonzero(likely & (member_gid[near] != gid[ask][:, None]))
            cosine[i, j] = np.round(np.einsum("nd,nd->n", x[ask[i]], member[near[i, j]]), 9)
            cosine = np.take_along_axis(cosine, by_id := np.argsort(near, axis=1), 1)
            near = np.take_along_axis(near, by_id, 1)
            best = np.argsort(-cosine, axis=1, kind="stable")[:, :width]
            chosen, value = np.zeros((len(ask), width), np.int64), np.full((len(ask), width), -2.0)
            chosen[:, : best.shape[1]], value[:, : best.shape[1]] = np.take_along_axis(near, best, 1), np.take_along_axis(cosine, best, 1)
            # Where a member that wasn't scored exactly can still be among the best, the whole block is.
            unsure = np.flatnonzero((most >= np.maximum(value[:, -1], floor) - 1e-4).any(0))
            if len(unsure):
                exact = np.round(x[ask[unsure]] @ member.T, 9)
                exact[member_gid[None, :] == gid[ask[unsure]][:, None]] = -2
                i, j = np.nonzero(exact >= np.partition(exact, len(at) - width, axis=1)[:, [len(at) - width]])
                order = np.lexsort((j, -exact[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, place = i[place < width], j[place < width], place[place < width]
                chosen[unsure[i], place], value[unsure[i], place] = j, exact[i, j]
            i, j = np.nonzero(value >= max(floor, -1.5))
            c = chosen[i, j]
            for column, part in zip(out, (gid[ask][i], member_gid[c], first[c], value[i, j])):
                column.append(part)
        return pa.Table.from_arrays([pa.array(np.concatenate(o), t.type) for o, t in zip(out, schema)], schema=schema)

    return run


def nearest(
    vectors: DataFrame, id_col: str, vector_col: str, *, dim: int, k: int = 5, floor: float = -1.0, probes: int = PROBES, shortlist: int = SHORTLIST, trained_on: int = TRAINED_ON, asked: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``id``, ``neighbour``, ``cosine``, ``rank``: for each usable vector its ``k`` most similar others with a cosine of at least ``floor``.

    Cosines are rounded to 9 decimals; equal ones rank by the smaller id. ``vectors`` has one row per id; unusable vectors
    (see :func:`usable`) and NULL ids take no part. ``asked``, from an id to a condition, restricts whose neighbours are
    sought, not where. An empty input gives an empty result.
    """
    if k < 1:
        raise ValueError("k must be positive")
    rows = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), dim))
    keyed = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64("v", F.lit(1))})
    rank = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    packed = keyed.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))
    groups = packed.select(F.xxhash64("k1", "k2").alias("gid"), "k1", "k2", "ids", F.col("v").cast("array<float>").alias("v"))
    groups = materialize(groups.mapInArrow(_pack(dim), "gid long, k1 long, k2 long, ids array<string>, vec binary"), "vectors")
    count = groups.count()
    spark = vectors.sparkSession
    if not count:
        return spark.createDataFrame([], "id string, neighbour string, cosine double, rank int")
    lists = int(np.clip(min(4 * 2 ** round(np.log2(count) / 2), count // MEMBERS), 4, MOST_LISTS))
    wanted = max(trained_on, PER_LIST * lists)
    sample = groups.where(F.pmod(F.xxhash64("gid"), F.lit(max(1, count // wanted))) == 0).orderBy(F.xxhash64("gid")).limit(2 * wanted)
    sample = _unit(sample.select("vec").toArrow()["vec"].to_pylist() or groups.select("vec").limit(1).toArrow()["vec"].to_pylist(), dim).astype(np.float32)
    model = fit(sample, lists, probes)
    if probes >= ALL:  # one list of all vectors
        blocks, parts = np.array([-(-count // BLOCK)]), np.array([1])
    else:
        blocks = np.maximum(1, np.ceil(model.stored * count / BLOCK)).astype(np.int64)
        parts = np.maximum(1, np.ceil(model.asking * count / ASKS)).astype(np.int64)
    every = groups.select("gid", F.element_at("ids", 1).alias("first"), "vec")
    if asked is None:
        spread = every.mapInArrow(_spread(model, blocks, parts, dim, probes, True, True), KIND)
    else:
        # Of ids beyond those that are kept, too.
        some = groups.join(keyed.where(asked(F.col("id"))).select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
        some = materialize(some.select("gid", F.element_at("ids", 1).alias("first"), "vec"), "asked")
        if probes >= ALL:
            parts = np.array([max(1, -(-some.count() // ASKS))])
        stored = every.mapInArrow(_spread(model, blocks, parts, dim, probes, False, True), KIND)
        spread = stored.unionByName(some.mapInArrow(_spread(model, blocks, parts, dim, probes, True, False), KIND))
    hits = spread.groupBy("cell", "block", "part").applyInArrow(_score(model, dim, k, floor, shortlist), "q long, c long, first string, cosine double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "first"))
    hits = materialize(hits.withColumn("place", place).where(F.col("place") <= k).select("q", "c", "cosine"), "hits")
    ids = groups.select("gid", "ids")
    others = hits.join(ids.withColumnsRenamed({"gid": "c", "ids": "theirs"}), "c").select("q", F.col("cosine"), F.explode("theirs").alias("neighbour"))
    own = ids.where(F.size("ids") > 1).select(F.col("gid").alias("q"), F.lit(1.0).alias("cosine"), F.explode("ids").alias("neighbour"))
    own = own.where(F.col("cosine") >= floor)
    found = ids.select(F.col("gid").alias("q"), F.explode("ids").alias("id")).join(others.unionByName(own), "q").where("id <> neighbour")
    # Ids beyond the k + 1 that a group of copies keeps: theirs are the smallest of its ids and those of groups at cosine 1, scaled copies.
    # The groups are a written table, so Spark knows its size: it is sent round while small, else merge-joined, wide groups split.
    tied = others.where("cosine = 1").groupBy("q").agg(F.collect_list("neighbour").alias("tied")).withColumnRenamed("q", "gid")
    best = F.slice(F.array_sort(F.concat("ids", F.coalesce("tied", F.array().cast("array<string>")))), 1, k)
    wide = materialize(groups.where(F.size("ids") == k + 1).join(tied, "gid", "left").select("k1", "k2", "ids", best.alias("best")), "wide")
    late = keyed.select("id", "k1", "k2").join(wide, ["k1", "k2"]).where(~F.array_contains("ids", F.col("id")))
    late = late.select("id", F.lit(1.0).alias("cosine"), F.explode("best").alias("neighbour")).where(F.col("cosine") >= floor)
    both = found.select("id", "cosine", "neighbour").unionByName(late)
    if asked is not None:
        both = both.where(asked(F.col("id")))
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return both.withColumn("rank", last).where(F.col("rank") <= k).select("id", "neighbour", "cosine", "rank")


def _pack(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(4).flatten(), dtype=np.float32).reshape(-1, dim)
            vec = pa.array([v.tobytes() for v in flat], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), vec], ["gid", "k1", "k2", "ids", "vec"])

    return run
