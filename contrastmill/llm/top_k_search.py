"""Exact top-k by integer inner product with block-at-a-time pruning.

The components of a vector are its terms, ``floor(256 x)`` their impact. Within a tile, the
documents in order of id are cut into ranges of ``RANGE``. A range knows the largest and smallest
impact of each term, so a query's bound on it is the sum of ``max(q * largest, q * smallest)``.
Each query visits the ranges by falling bound, scores them whole through their forward index (the
range's rows) and stops when the bound falls below its k-th score so far. Bounds that equal the
k-th score are still visited, since ties go to the smaller id.

Vectors that are null, empty or hold null, NaN or infinite components take no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrastmill.llm.vector_grid import best, expand, nearest, same_vectors, usable

RANGE = 128


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """Doubles where all sums of products are whole numbers they can hold, else 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float64 if top < 2**53 else np.int64


def pruned_tile(query_ids, queries, ids, vectors, k):
    at, ids, begin, count = same_vectors(ids, vectors, k + 1)
    smallest = ids[begin]
    order = np.argsort(smallest, kind="stable")
    at, begin, count = at[order], begin[order], count[order]
    kind = exact_type(queries, vectors)
    rows, q = vectors[at].astype(kind), queries.astype(kind)
    starts = np.arange(0, len(rows), RANGE)
    largest, least = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
    bounds = np.maximum(q, 0) @ largest.T + np.minimum(q, 0) @ least.T
    visits = np.argsort(-bounds, axis=1, kind="stable")
    held_row, held_id, held_score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
    kth = np.full(len(q), -np.inf)
    for turn in range(len(starts)):
        block = visits[:, turn]
        active = np.flatnonzero(bounds[np.arange(len(q)), block] >= kth)
        if not len(active):
            break
        new = []
        for b in np.unique(block[active]):
            who = active[block[active] == b]
            scores = q[who] @ rows[starts[b] : starts[b] + RANGE].T
            r, c = np.nonzero(scores >= kth[who][:, None])
            r, found, s = expand(who[r], c + starts[b], scores[r, c], ids, begin, count)
            other = found != query_ids[r]
            new.append((r[other], found[other], s[other]))
        r, found, s = (np.concatenate([x, *y]) for x, y in zip((held_row, held_id, held_score), zip(*new)))
        top = best(r, found, s, k)
        held_row, held_id, held_score = r[top], found[top], s[top]
        have = np.bincount(held_row, minlength=len(q))
        full = np.flatnonzero(have >= k)
        last = np.cumsum(have) - 1
        kth[full] = held_score[last[full]]
    return held_row, held_id, held_score.astype(np.int64)


def top_k_search(embeddings: DataFrame, is_query: Column, k: int = 5, **blocks) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows of every query, ties by id."""
    taken = embeddings.where(usable(F.col("embedding")))
    impacts = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    vectors = taken.select(F.col("vec_id").cast("long").alias("vec_id"), impacts.alias("v"))
    return nearest(vectors.where("vec_id is not null"), is_query, pruned_tile, k, "long", **blocks)
