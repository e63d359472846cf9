"""Nearest neighbours by inner product, as a block matrix join with int8 tiles.

In a tile, vectors are rounded to 8-bit integers with a scale of their own. The integer products
of the tile differ from the true inner products by at most ``|q-q'| |b| + |q'| |b-b'|`` (``'``:
as rounded), so each has a lower and an upper bound. Candidates whose upper bound reaches the
k-th largest lower bound of their query are recomputed in double precision from the original
vectors. Nothing else can be among the best, so the answer is exact.

Vectors that are null, empty, zero or hold null, NaN or infinite components take no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrastmill.llm.vector_grid import best, expand, nearest, same_vectors, usable

STRIP = 256


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Integers from -127 to 127, their scale, the norm as rounded and the norm of what rounding changed."""
    scale = np.abs(x).max(axis=1) / 127
    whole = np.rint(x / np.where(scale > 0, scale, 1)[:, None])
    back = whole * scale[:, None]
    return whole, scale, np.sqrt((back**2).sum(1)), np.sqrt(((x - back) ** 2).sum(1))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of ``a`` with rows of ``b``, summed from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def int8_tile(query_ids, queries, ids, vectors, k):
    queries, vectors = queries.astype(np.float64), vectors.astype(np.float64)
    at, ids, begin, count = same_vectors(ids, vectors, k + 1)
    distinct = vectors[at]
    whole, scale, _, lost = quantised(distinct)
    norm = np.sqrt((distinct**2).sum(1))
    # products of 8-bit integers are exact in float32 up to 2**24
    kind = np.float32 if distinct.shape[1] * 127 * 127 < 1 << 24 else np.float64
    whole = whole.astype(kind).T.copy()
    parts = []
    for first in range(0, len(queries), STRIP):
        q = queries[first : first + STRIP]
        q_whole, q_scale, q_norm, q_lost = quantised(q)
        near = (q_whole.astype(kind) @ whole).astype(np.float64) * q_scale[:, None] * scale
        error = q_lost[:, None] * norm + q_norm[:, None] * lost
        error += 1e-9 * (error + np.abs(near)) + 1e-300
        lower = near - error
        keep = min(k + 1, lower.shape[1])
        least = np.partition(lower, -keep, axis=1)[:, -keep]
        rows, columns = np.nonzero(near + error >= least[:, None])
        scores = inner_products(q[rows], distinct[columns])
        rows, found, scores = expand(rows + first, columns, scores, ids, begin, count)
        other = found != query_ids[rows]
        rows, found, scores = rows[other], found[other], scores[other]
        top = best(rows, found, scores, k)
        parts.append((rows[top], found[top], scores[top]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def nearest_neighbours(embeddings: DataFrame, is_query: Column, k: int = 20, **blocks) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of every query, ties by id."""
    taken = embeddings.where(usable(F.col("embedding"))).where(F.exists("embedding", lambda x: x != 0))
    vectors = taken.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    return nearest(vectors.where("vec_id is not null"), is_query, int8_tile, k, "double", **blocks)
