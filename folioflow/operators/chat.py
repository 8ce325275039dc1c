"""Answering questions from retrieved chunks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators import guard
from folioflow.operators.observe import ChatLog

# The instructions of a prompt.
INSTRUCTIONS = "You are a helpful assistant. Use ONLY the context below to answer.\nIf the answer is not in the context, say 'I don't know'.\n\n"


def prompt(context: Column, query: Column) -> Column:
    return F.concat(F.lit(INSTRUCTIONS + "Context:\n"), context, F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))


def hit_context(hits: DataFrame, keys: list[str], text: str, source: str, distance: str, rank: str) -> DataFrame:
    """Per question: texts joined by blank lines in rank order, distinct sources in order, mean distance, number of hits."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
    return hits.groupBy(*keys).agg(
        F.array_join(F.transform(pairs, lambda x: x["t"]), "\n\n").alias("context"),
        F.array_sort(F.collect_set(F.coalesce(F.col(source), F.lit("unknown")))).alias("sources"),
        F.round(F.avg(distance), 6).alias("avg_distance"),
        F.count("*").alias("n_hits"),
    )


def gate(questions: DataFrame, contexts: DataFrame, key: str, query: str) -> DataFrame:
    """Questions with their context, whether they are blocked, and what blocks or warns. Questions without hits are blocked as irrelevant."""
    both = questions.join(contexts, key, "left")
    problem = guard.input_problem(F.col(query))
    far = guard.relevance_warning(F.col("avg_distance"))
    return both.select(
        key,
        F.coalesce("avg_distance", F.lit(1.0)).alias("avg_distance"),
        F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"),
        guard.topic_warning(F.col(query)).alias("topic_warning"),
        F.when(problem != "", problem).otherwise(far).alias("blocked_by"),
        ((problem != "") | (far != "")).alias("blocked"),
        F.when((problem == "") & (far == ""), prompt(F.col("context"), F.col(query))).alias("prompt"),
    )


class Chat:
    """Answers one question at a time: ``search(query, k)`` gives hits with ``text``, ``source`` and ``distance``, ``model(prompt)`` the answer.

    Every outcome has the same keys. Questions refused on input aren't logged; those refused as irrelevant are.
    """

    def __init__(self, spark, search: Callable[[str, int], DataFrame], model: Callable[[str], str], log: ChatLog | None = None, k: int = 3):
        self.spark, self.search, self.model, self.log, self.k = spark, search, model, log, k

    def ask(self, query: str) -> dict:
        out = dict.fromkeys(("answer", "sources", "num_chunks", "avg_chunk_score", "retrieval_ms", "generation_ms", "topic_warning", "blocked"))
        question = F.lit(query)
        problem, warning = self.spark.range(1).select(guard.input_problem(question), guard.topic_warning(question)).first()
        if problem:
            return out | {"answer": problem, "sources": [], "num_chunks": 0, "blocked": True}
        warning = warning or None
        began = time.monotonic()
        hits = self.search(query, self.k).limit(self.k).collect()
        retrieval_ms = (time.monotonic() - began) * 1000
        mean = sum(h["distance"] for h in hits) / len(hits) if hits else 1.0
        sources = sorted({h["source"] or "unknown" for h in hits})
        if mean > guard.FARTHEST:
            self._write(query, guard.IRRELEVANT, sources, retrieval_ms, 0.0, mean)
            return out | {"answer": guard.IRRELEVANT, "sources": sources, "num_chunks": len(hits), "blocked": True}
        text = INSTRUCTIONS + "Context:\n" + "\n\n".join(h["text"] for h in hits) + f"\n\nQuestion: {query}\nAnswer:"
        began = time.monotonic()
        answer = self.model(text)
        generation_ms = (time.monotonic() - began) * 1000
        self._write(query, answer, sources, retrieval_ms, generation_ms, mean)
        return out | {
            "answer": answer, "sources": sources, "num_chunks": len(hits), "avg_chunk_score": round(mean, 3), "retrieval_ms": round(retrieval_ms, 1),
            "generation_ms": round(generation_ms, 1), "topic_warning": warning, "blocked": False,
        }

    def _write(self, *row) -> None:
        if self.log:
            self.log.append(*row)
