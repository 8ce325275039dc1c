"""Vector similarity as Arrow functions: a batch of lists becomes one matrix, scored with one product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the usable lists (``dim`` finite numbers, not all zero) and their places."""
    fit = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False))
    at = np.flatnonzero(fit)
    flat = lists.take(pa.array(at)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return x[good], at[good]


def cosine_to(query: list[float], places: int = 6):
    """A function from an array column to its cosine with ``query``, rounded; NULL for vectors that can't be compared.

    The product runs in blocks of one batch; a query without direction is an error.
    """
    q = np.asarray(query, dtype=np.float64)
    norm = np.linalg.norm(q)
    if not np.isfinite(norm) or norm == 0:
        raise ValueError("the query vector has no direction")
    q = q / norm

    @F.arrow_udf(DoubleType())
    def cosine(v: pa.Array) -> pa.Array:
        x, at = matrix(v, len(q))
        out = np.full(len(v), np.nan)
        out[at] = np.round(x @ q / np.linalg.norm(x, axis=1), places)
        return pa.array(out, from_pandas=True)

    return cosine


def cosine(a: Column, b: Column, places: int = 6) -> Column:
    """Cosine of two array columns, inside the JVM; NULL if lengths differ or a norm is zero."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm))
    return F.round(F.when(~F.isnan(value), value), places)
