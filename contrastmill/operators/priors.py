"""The prior graph, and explaining a deviation by another attribute."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastmill.operators.features import VERSION_SUFFIX
from contrastmill.operators.groups import GROUP, POPULATION
from contrastmill.operators.pruning import change_threshold
from contrastmill.runtime import materialize


def prior_edges(spark: SparkSession, edges: Iterable[tuple[str, str]]) -> DataFrame:
    """Edge table; a node is an attribute name, or ``@family`` for all members of a family."""
    rows = [F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in dict.fromkeys(edges)]
    table = F.array(*rows) if rows else F.array().cast("array<struct<src:string,dst:string>>")
    return spark.range(1).select(F.inline(table))


def prior_closure(edges: DataFrame) -> DataFrame:
    """Pairs of different nodes with a path from the first to the second.

    Path lengths double each round, so a graph of n nodes needs log2(n) rounds; cycles end it
    like anything else, once a round finds no new pair.
    """
    reach = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    known = -1
    while True:
        longer = reach.alias("a").join(reach.alias("b"), F.col("a.dst") == F.col("b.src"))
        new = longer.select("a.src", "b.dst").where(F.col("src") != F.col("dst"))
        reach = materialize(reach.union(new).distinct())
        found = reach.count()
        if found == known:
            return reach
        known = found


def node_of(key: Column, family: Column) -> Column:
    """Where an item stands in the prior graph."""
    return F.coalesce(F.concat(F.lit("@"), family), key)


def possible_priors(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """One row per pair and member from which the other member is reachable.

    ``prior`` says which one; the fields of both members are repeated as ``prior_*`` and
    ``other_*``. A member of a family also reaches its own version.
    """
    paths = closure.select(F.col("src").alias("__src"), F.col("dst").alias("__dst")).distinct()

    def reaches(frame: DataFrame, a: str, b: str) -> DataFrame:
        nodes = frame.withColumns(
            {
                "__a": node_of(F.col(f"{a}_key"), F.col(f"{a}_family")),
                "__b": node_of(F.col(f"{b}_key"), F.col(f"{b}_family")),
            }
        )
        found = nodes.join(
            paths, (F.col("__a") == F.col("__src")) & (F.col("__b") == F.col("__dst")), "left"
        )
        own_version = (F.col(f"{b}_family") == F.concat(F.col(f"{a}_family"), F.lit(VERSION_SUFFIX))) & (
            F.col(f"{b}_key") == F.concat(F.col(f"{a}_key"), F.lit(VERSION_SUFFIX))
        )
        return found.withColumn(
            f"__{a}", F.col("__src").isNotNull() | F.coalesce(own_version, F.lit(False))
        ).drop("__a", "__b", "__src", "__dst")

    both = reaches(reaches(pairs, "lo", "hi"), "hi", "lo")
    sides = F.array_compact(F.array(F.when(F.col("__lo"), "lo"), F.when(F.col("__hi"), "hi")))
    rows = both.withColumn("prior", F.explode(sides)).drop("__lo", "__hi")
    is_lo = F.col("prior") == "lo"
    fields = [c[3:] for c in pairs.columns if c.startswith("lo_")]
    added = {"prior_id": F.when(is_lo, F.col("lo")).otherwise(F.col("hi"))}
    added["other_id"] = F.when(is_lo, F.col("hi")).otherwise(F.col("lo"))
    for f in fields:
        added[f"prior_{f}"] = F.when(is_lo, F.col(f"lo_{f}")).otherwise(F.col(f"hi_{f}"))
        added[f"other_{f}"] = F.when(is_lo, F.col(f"hi_{f}")).otherwise(F.col(f"lo_{f}"))
    return rows.withColumns(added)


def conditional_support(priors: DataFrame) -> DataFrame:
    """Support of the other member given the prior, on both sides, and how far apart they are."""
    given = {s: F.col(f"count_{s}") / F.col(f"prior_count_{s}") for s in ("group", "reference")}
    return priors.withColumns(
        {
            "given_group": given["group"],
            "given_reference": given["reference"],
            "given_diff": F.abs(given["reference"] - given["group"]),
        }
    )


def explained_away(priors: DataFrame, min_support_diff: float) -> DataFrame:
    """Items whose deviation vanishes given a prior: ``population, g, item_id``."""
    return (
        priors.where(F.col("given_diff") < min_support_diff)
        .select(POPULATION, GROUP, F.col("other_id").alias("item_id"))
        .distinct()
    )


def without_explained(pairs: DataFrame, explained: DataFrame) -> DataFrame:
    """Drop every pair that contains an explained item."""
    for member in ("lo", "hi"):
        gone = explained.withColumnRenamed("item_id", member)
        pairs = pairs.join(gone, [POPULATION, GROUP, member], "left_anti")
    return pairs


def prior_no_effect(priors: DataFrame, min_support_diff: float) -> DataFrame:
    """Drop priors that leave the support of the other member as it is."""
    t = change_threshold(min_support_diff)
    other_group = F.col("other_count_group") / F.col("total_group")
    other_reference = F.col("other_count_reference") / F.col("total_reference")
    idle = (F.abs(other_group - F.col("given_group")) < t) & (
        F.abs(other_reference - F.col("given_reference")) < t
    )
    return priors.where(~idle)


def best_prior(priors: DataFrame) -> DataFrame:
    """For each explained-in-part item the prior that leaves the least difference, ties by key
    and value: ``population, g, item_id, prior``."""
    prior = F.struct(
        F.struct(
            *[F.col(f"prior_{f}").alias(f) for f in ("key", "value", "vtype", "family", "name")]
        ).alias("item"),
        "count_reference",
        "count_group",
        F.col("prior_count_reference").alias("total_reference"),
        F.col("prior_count_group").alias("total_group"),
    )
    order = F.struct("given_diff", "prior_key", F.coalesce("prior_value", F.lit("")), "prior_id")
    return priors.groupBy(POPULATION, GROUP, F.col("other_id").alias("item_id")).agg(
        F.min_by(prior, order).alias("prior")
    )
