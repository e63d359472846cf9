"""Groups of records: how rows are tagged, and how many there are.

Every tagged table has the columns ``population`` and ``g``. There are two modes.

* exclusive: a row belongs to at most one group; all rows form the reference, and ``g`` is null
  for rows of no selected group.
* overlapping: a row appears once per group it belongs to, and the rows with null ``g`` form
  the reference. Predicate groups and foreign populations use this mode.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastmill.runtime import materialize

POPULATION = "population"
GROUP = "g"


def col(name: str) -> Column:
    """Column by its literal name, which may hold dots and spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_population(df: DataFrame, name: str = "all") -> DataFrame:
    return df if POPULATION in df.columns else df.withColumn(POPULATION, F.lit(name))


def group_by_equality(
    df: DataFrame, column: str, names: Sequence[str] | DataFrame | None = None
) -> DataFrame:
    """Tag rows by the value of a column, in one pass for all groups.

    ``names`` limits the groups: a list, or a table ``(population, g)`` when they differ by
    population. Values not asked for become null before any shuffle.
    """
    df = with_population(df)
    value = col(column).cast("string")
    if isinstance(names, DataFrame):
        wanted = names.select(F.col(POPULATION), F.col(GROUP).alias("__wanted")).distinct()
        tagged = df.withColumn("__value", value).alias("r").join(
            wanted.alias("w"),
            (F.col(f"r.{POPULATION}") == F.col(f"w.{POPULATION}")) & (F.col("__value") == F.col("__wanted")),
            "left",
        )
        kept = [F.col("r." + "`" + c.replace("`", "``") + "`") for c in df.columns]
        return tagged.select(*kept, F.col("__wanted").alias(GROUP))
    if names is not None:
        value = F.when(value.isin(list(names)), value)
    return df.withColumn(GROUP, value)


def group_by_predicate(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """Named groups from arbitrary conditions; a row may be in several."""
    hits = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()]))
    reference = F.array(F.lit(None).cast("string"))
    return with_population(df).withColumn(GROUP, F.explode(F.concat(reference, hits)))


def compare_populations(reference: DataFrame, groups: Mapping[str, DataFrame]) -> DataFrame:
    """Put a reference and unrelated populations side by side as overlapping groups."""
    both = with_population(reference).withColumn(GROUP, F.lit(None).cast("string"))
    for name, df in groups.items():
        both = both.unionByName(
            with_population(df).withColumn(GROUP, F.lit(name)), allowMissingColumns=True
        )
    return both


#: Groups up to which the items that can reach a support are told by the size of each group.
FEW_GROUPS = 1 << 14


def support_bounds(totals: DataFrame, min_support: float) -> DataFrame:
    """``population, g, least``: an item whose support reaches ``min_support`` in a group or in the
    reference of exclusive groups has ``least`` rows in one of the groups, rows of no group included.

    Groups make up the reference, so one of them has at least the support of the whole. ``totals``
    holds all groups. ``least`` is a little lower, so that no rounding can hide an item.
    """
    size = totals.select(POPULATION, GROUP, "total_group")
    rest = totals.groupBy(POPULATION).agg((F.max("total_reference") - F.sum("total_group")).alias("total_group"))
    size = size.unionByName(rest.withColumn(GROUP, F.lit(None).cast(totals.schema[GROUP].dataType)))
    return size.select(POPULATION, GROUP, (F.col("total_group") * (min_support * (1 - 1e-9))).alias("least"))


def reaching(counts: DataFrame, keys: Sequence[str], least: DataFrame) -> DataFrame:
    """The ``keys`` that reach ``least`` in one of their groups, each once; groups it lacks reach it."""
    bounds = least.select("least", *[F.col(c).alias(f"__{c}") for c in (POPULATION, GROUP)])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (POPULATION, GROUP)]
    enough = F.col("count_group") >= F.coalesce("least", F.lit(0.0))
    return counts.join(bounds, same, "left").where(enough).select(*keys).distinct()


def with_reference_count(
    counts: DataFrame,
    keys: Sequence[str],
    overlapping: bool = False,
    many_groups: bool = False,
    least: DataFrame | None = None,
) -> DataFrame:
    """Add ``count_reference`` to counts per key and group, keeping the rows of real groups.

    The reference count is the sum over all groups, or with overlapping groups the count of the
    reference rows themselves. With few groups a key has few rows and a window adds its sum in
    one shuffle. With ``many_groups`` a key may have a row for each of millions of them, so the
    sum is a partial aggregate joined back, which splits such keys; the counts are written
    first, as both sides would otherwise scan the records. With ``least`` (``support_bounds``) only
    keys that reach it are summed and returned; the others, most of all keys, are read once more but
    never shuffled again. It is for exclusive groups with ``many_groups``.
    """
    own = F.col("count_group")
    counted = F.when(F.col(GROUP).isNull(), own) if overlapping else own
    if not many_groups:
        total = F.sum(counted).over(Window.partitionBy(*keys))
        with_total = counts.withColumn("count_reference", F.coalesce(total, F.lit(0)))
        return with_total.where(F.col(GROUP).isNotNull())
    counts = materialize(counts)
    if least is not None:
        kept = materialize(reaching(counts, keys, least))
        kept = kept.select(*[F.col(k).alias(f"__{k}") for k in keys])
        counts = materialize(counts.join(kept, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_semi"))
    sums = counts.groupBy(*keys).agg(F.coalesce(F.sum(counted), F.lit(0)).alias("count_reference"))
    sums = sums.select("count_reference", *[F.col(k).alias(f"__{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    real = counts.where(F.col(GROUP).isNotNull())
    return real.join(sums, same).drop(*[f"__{k}" for k in keys])


def reference_total(tagged: DataFrame, overlapping: bool = False) -> DataFrame:
    """Rows per population."""
    rows = tagged.where(F.col(GROUP).isNull()) if overlapping else tagged
    return rows.groupBy(POPULATION).agg(F.count(F.lit(1)).alias("total_reference"))


def group_totals(tagged: DataFrame, overlapping: bool = False) -> DataFrame:
    """Rows per group, with the size of the reference next to it."""
    sizes = tagged.groupBy(POPULATION, GROUP).agg(F.count(F.lit(1)).alias("total_group"))
    part = sizes.where(F.col(GROUP).isNull()) if overlapping else sizes
    reference = part.groupBy(POPULATION).agg(F.sum("total_group").alias("total_reference"))
    return (
        sizes.where(F.col(GROUP).isNotNull())
        .join(reference, POPULATION, "left")
        .withColumn("total_reference", F.coalesce("total_reference", F.lit(0)))
    )


def min_group_filter(totals: DataFrame, min_count: int = 5) -> tuple[DataFrame, DataFrame]:
    """Split the totals into groups large enough to test and the ones skipped."""
    large = F.col("total_group") >= min_count
    return totals.where(large), totals.where(~large)


def top_groups(df: DataFrame, column: str, number: int) -> DataFrame:
    """The most frequent values of a column in each population, ties by name."""
    counted = (
        with_population(df).where(col(column).isNotNull())
        .groupBy(POPULATION, col(column).cast("string").alias(GROUP))
        .agg(F.count(F.lit(1)).alias("total_group"))
    )
    return rank_groups(counted, number)


def rank_groups(counted: DataFrame, number: int) -> DataFrame:
    """The same out of ``population, g, total_group``."""
    order = Window.partitionBy(POPULATION).orderBy(F.desc("total_group"), F.asc(GROUP))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= number)
