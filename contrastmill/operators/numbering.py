"""Numbers for rows and for sorted values, without one task or one key seeing all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastmill.runtime import materialize


def with_row_number(rows: DataFrame, name: str) -> DataFrame:
    """A number for every row; neighbours in a partition have neighbouring numbers.

    Rows are put in order of their content within each partition first, so a task that runs again
    after an executor is lost numbers them alike. Equal rows are interchangeable.
    """
    ordered = rows.sortWithinPartitions(F.xxhash64(*rows.columns))
    return ordered.withColumn(name, F.monotonically_increasing_id())


def rank_within(values: DataFrame, scope: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rank from 1 of each row among those of its ``scope``, in ``order``; rows must be distinct.

    The rows are sorted by range over all partitions and written. Each partition counts its rows
    of every scope; only these counts are summed up in order, one number for a partition and scope.
    """
    ranged = values.repartitionByRange(*scope, *order).sortWithinPartitions(*scope, *order)
    written = materialize(
        ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    )
    sizes = written.groupBy("__part", *scope).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*scope).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    offsets = offsets.select("__part", "__first", "__before", *[F.col(c).alias(f"__{c}") for c in scope])
    same: list[Column] = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in scope]
    ranked = written.alias("w").join(offsets.alias("o"), [F.col("w.__part") == F.col("o.__part"), *same])
    rank = F.col("__at") - F.col("__first") + F.col("__before") + 1
    return ranked.select(*[F.col(f"w.{c}") for c in values.columns], rank.alias(name))
