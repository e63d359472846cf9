"""A stated set of queries against all vectors, as tiles of a grid of blocks.

Queries and candidates are dealt into blocks of about equal size by a hash of their ids. A tile
holds one block of each and is one group of a cogroup, so the memory of a task is that of two
blocks and no step sees the pairs as rows. Each tile answers with its best ``k`` per query; a
window over a query's answers keeps the best of those.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastmill.runtime import materialize

QUERY_BLOCK = 2048
BLOCK = 8192

#: queries (ids, vectors), candidates (ids, vectors), k -> row of the query, candidate id, score
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(vector: Column) -> Column:
    """The vector has components, none of them null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each row: by falling score, then by rising id."""
    order = np.lexsort((ids, -scores, rows))
    ordered = rows[order]
    first = np.searchsorted(ordered, ordered, "left")
    return order[np.arange(len(order)) - first < k]


def same_vectors(ids: np.ndarray, vectors: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors and, of each, the ``keep`` smallest ids: no more copies can be among the best.

    Returns the position of one row of each distinct vector, and ids with begin and count by vector.
    """
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, at, inverse = np.unique(raw, return_index=True, return_inverse=True)
    order = np.lexsort((ids, inverse))
    group = inverse[order]
    rank = np.arange(len(group)) - np.searchsorted(group, group, "left")
    order, group = order[rank < keep], group[rank < keep]
    begin = np.searchsorted(group, np.arange(len(at)))
    return at, ids[order], begin, np.diff(np.append(begin, len(order)))


def expand(rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, ids, begin, count):
    """Pairs of query row and distinct vector as pairs of query row and id."""
    n = count[columns]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(rows, n), ids[np.repeat(begin[columns], n) + inner], np.repeat(scores, n)


def nearest(
    vectors: DataFrame, is_query: Column, kernel: Kernel, k: int, score_type: str,
    query_block: int = QUERY_BLOCK, block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best of every query (``vectors``: ``vec_id``, ``v``).

    A query is not its own candidate: rows with its id are left out. Only vectors of a query's
    length are compared with it. Rows that agree in id and vector count once; queries that share
    an id but not the vector have one answer each.
    """
    vectors = vectors.dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v"))
    vectors = materialize(vectors)
    queries = vectors.where(is_query).withColumn("q", F.xxhash64("v"))
    n_blocks = max(1, -(-vectors.count() // block))
    n_query_blocks = max(1, -(-queries.count() // query_block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", deal(n_query_blocks)).withColumn("b", every(n_blocks))
    right = vectors.withColumn("b", deal(n_blocks)).withColumn("qb", every(n_query_blocks))

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            rows, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            rows, ids, scores = kernel(
                q.column("vec_id").to_numpy(), matrix(q), c.column("vec_id").to_numpy(), matrix(c), k
            )
        return pa.table(
            {
                "query_id": q.column("vec_id").combine_chunks().take(pa.array(rows)),
                "q": q.column("q").combine_chunks().take(pa.array(rows)),
                "vec_id": pa.array(ids, pa.int64()),
                "score": pa.array(scores, {"long": pa.int64(), "double": pa.float64()}[score_type]),
            }
        )

    key = ["dim", "b", "qb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        tile, f"query_id long, q long, vec_id long, score {score_type}"
    )
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
