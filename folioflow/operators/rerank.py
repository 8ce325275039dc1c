"""Rerankers: from results with ``text`` and ``retrieval_rank`` to results with ``rerank_score``."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import blank_terms
from folioflow.storage import materialize

log = logging.getLogger(__name__)


class TermOverlap:
    """Share of the query's distinct words, between blanks and lower-cased, that the text has."""

    def score(self, rows: DataFrame, query: str) -> DataFrame:
        wanted = sorted(set(query.lower().split()))
        if not wanted:
            return rows.withColumn("rerank_score", F.lit(0.0))
        shared = F.size(F.array_intersect(blank_terms(F.col("text")), F.array(*map(F.lit, wanted))))
        return rows.withColumn("rerank_score", shared / F.lit(max(1, len(wanted))))


class ModelReranker:
    """A model that reads query and text together, made once a task: ``make()`` gives ``predict(pairs) -> scores``."""

    def __init__(self, make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
        self.make = make

    def score(self, rows: DataFrame, query: str) -> DataFrame:
        make, names = self.make, rows.columns
        shape = rows.withColumn("rerank_score", F.lit(None).cast("double")).schema

        def run(batches):
            predict = make()
            for batch in batches:
                texts = batch.column(names.index("text")).to_pylist()
                scores = [float(s) for s in predict([(query, t or "") for t in texts])]
                if len(scores) != len(texts):
                    raise ValueError("the model returned another number of scores")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, "rerank_score"])

        return rows.mapInArrow(run, shape)


class Fallback:
    """Tries the first reranker on the driver once; after a failure the second is used from then on."""

    def __init__(self, first, second):
        self.first, self.second, self.failed = first, second, False

    def score(self, rows: DataFrame, query: str) -> DataFrame:
        if not self.failed:
            try:
                return materialize(self.first.score(rows, query), "scored")  # few rows; a failure shows here
            except Exception as error:
                log.warning("reranking failed, falling back: %s", error)
                self.failed = True
        return self.second.score(rows, query)


def overlap_pairs(queries: DataFrame, texts: DataFrame, query: str, text: str, most: int = 5_000_000) -> DataFrame:
    """``query_id``, ``text_id``, ``score``: the share of the query's words a text has, for every pair that shares one.

    The queries' words, at most ``most`` of them (else this raises), go to the tasks as one inverted list; every text counts its
    hits in it, and nothing is shuffled: a word that all texts share is no hot key. A row of ``queries`` or ``texts`` each is taken for itself.
    """
    held = queries.select("query_id", blank_terms(F.col(query)).alias("w")).where(F.size("w") > 0)
    size = held.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"more than {most} words of queries; compare them in several calls")
    rows = sorted(map(tuple, held.collect()))
    lists: dict[str, list[int]] = {}
    for i, (_, found) in enumerate(rows):
        for w in found:
            lists.setdefault(w, []).append(i)
    shared = queries.sparkSession.sparkContext.broadcast(({w: np.array(at, np.int32) for w, at in lists.items()}, np.array([len(w) for _, w in rows], np.float64), pa.array([i for i, _ in rows])))
    q_type, t_type = queries.schema["query_id"].dataType.simpleString(), texts.schema["text_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sizes, names = shared.value
        for big in batches:
            for start in range(0, big.num_rows, 1000):
                batch = big.slice(start, 1000)
                at, found, score = [], [], []
                for k, words in enumerate(batch.column(1).to_pylist()):
                    if hits := [index[w] for w in words if w in index]:
                        q, n = np.unique(np.concatenate(hits), return_counts=True)
                        at.append(np.full(len(q), k))
                        found.append(q)
                        score.append(n / sizes[q])
                if at:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(found))), batch.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(score))], ["query_id", "text_id", "score"])

    return texts.select("text_id", blank_terms(F.col(text)).alias("w")).mapInArrow(run, f"query_id {q_type}, text_id {t_type}, score double")
