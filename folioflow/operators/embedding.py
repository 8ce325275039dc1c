"""Embedding: pluggable models, run in Arrow batches, on what the checkpoint doesn't cover."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.cache import with_retries
from folioflow.functions.text import content_hash, count_tokens


class Embedder(Protocol):
    """A model: its name, version, dimension and price, and vectors for a batch of texts."""

    name: str
    version: str
    dimension: int
    cost_per_1k_tokens: float

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic stand-in: a unit vector drawn from a generator seeded by the text's hash."""

    name, version, cost_per_1k_tokens = "mock-embedder", "v1", 0.0

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            draw = np.random.RandomState(int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big")).normal(0, 1, self.dimension)
            out.append((draw / np.linalg.norm(draw)).tolist())
        return out


def embed(texts: DataFrame, text: str, make: Callable[[], Embedder], batch_size: int = 50, *, tries: int = 3, wait: float = 0.5, errors: bool = False) -> DataFrame:
    """Adds ``embedding``: one model a task, made where it runs; batches of ``batch_size``. NULL texts keep a NULL vector.

    A vector of another length than the model's dimension, or another number of vectors than texts, is an error. A batch that fails is
    tried ``tries`` times. If it still fails, so does the job; with ``errors`` the batch's rows get no vector and the message in ``embedding_error``.
    """
    names = texts.columns
    wide = texts.withColumn("embedding", F.lit(None).cast("array<float>"))
    shape = (wide.withColumn("embedding_error", F.lit(None).cast("string")) if errors else wide).schema

    def vectors_of(model: Embedder, part: list[str]) -> list[list[float]]:
        got = model.embed_batch(part)
        if len(got) != len(part) or any(len(v) != model.dimension for v in got):
            raise ValueError("the model returned vectors of another number or length")
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            values = batch.column(names.index(text)).to_pylist()
            at = [i for i, t in enumerate(values) if t is not None]
            vectors: list = [None] * len(values)
            failed: list = [None] * len(values)
            for k in range(0, len(at), batch_size):
                part = at[k : k + batch_size]
                try:
                    for i, v in zip(part, with_retries(lambda: vectors_of(model, [values[i] for i in part]), tries, wait)):
                        vectors[i] = v
                except Exception as error:
                    if not errors:
                        raise
                    for i in part:
                        failed[i] = f"{type(error).__name__}: {error}"[:200]
            more = [pa.array(failed, pa.string())] if errors else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32())), *more], shape.names)

    return texts.mapInArrow(run, shape)


def embedding_plan(chunks: DataFrame, checkpoint: DataFrame, version: str) -> DataFrame:
    """Adds ``status``: ``skipped`` if the checkpoint has the chunk with the same hash and model version, else ``pending``."""
    key = ["chunk_id", "content_hash", "model_version"]
    wanted = chunks.withColumn("content_hash", content_hash(F.col("text_for_embedding"))).withColumn("model_version", F.lit(version))
    covered = checkpoint.select(*key).distinct().withColumn("_covered", F.lit(True))
    both = wanted.join(covered, key, "left")
    return both.withColumn("status", F.when(F.col("_covered"), "skipped").otherwise("pending")).drop("_covered")


def run_metrics(plan: DataFrame, batch_size: int = 50, cost_per_1k: float = 0.00013) -> DataFrame:
    """One row: chunks processed, skipped and failed, their tokens, model calls and price."""
    due = F.col("status") == "pending"
    tokens = F.coalesce(F.sum(F.when(due, count_tokens(F.col("text_for_embedding")))), F.lit(0)).cast("long")
    return plan.agg(
        F.count_if(due).alias("chunks_processed"),
        F.count_if(F.col("status") == "skipped").alias("chunks_skipped"),
        F.count_if(F.col("status") == "failed").alias("chunks_failed"),
        tokens.alias("total_tokens"),
        F.ceil(F.count_if(due) / batch_size).cast("long").alias("total_api_calls"),
        F.round(tokens / 1000 * cost_per_1k, 6).alias("total_cost_usd"),
    )


def batch_number(order: Column, size: int, *keys: str) -> Column:
    """Numbers of fixed-size batches in order, from 0, within ``keys``; without keys the window is one task, fit for reports only."""
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
    return F.floor((F.row_number().over(w) - 1) / size).cast("long")


def last_of_key(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """Of rows with the same key the one written last."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(sequence)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def merge_vectors(stored: DataFrame, fresh: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Fresh rows, and stored ones whose key isn't among them."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
