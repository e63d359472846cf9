"""From surviving items and pairs to accepted rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrastmill.functions import stats
from contrastmill.operators.groups import GROUP, POPULATION
from contrastmill.operators.pairs import MEMBER_FIELDS, PAIR

FIGURES = ["count_group", "count_reference", "total_group", "total_reference"]


def with_statistics(counts: DataFrame) -> DataFrame:
    """Supports, chi-squared, its p-value and phi of each row of counts and totals."""
    group, reference = F.col("count_group"), F.col("count_reference")
    total_group, total_reference = F.col("total_group"), F.col("total_reference")
    return (
        counts.withColumns(
            {
                "support_group": group / total_group,
                "support_reference": reference / total_reference,
                "chi2": stats.rule_chi2(group, reference, total_group, total_reference),
            }
        )
        .withColumn("p", stats.chi2_pvalue(F.col("chi2")))
        .withColumn("phi", stats.phi_coefficient(F.col("chi2"), total_group, total_reference))
    )


def support_difference(rows: DataFrame, min_support_diff: float) -> DataFrame:
    return rows.where(F.abs(F.col("support_reference") - F.col("support_group")) >= min_support_diff)


def candidate_levels(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Items and pairs in one table: an item is a candidate with a first member only."""
    fields = [F.col(f).alias(f"lo_{f}") for f in MEMBER_FIELDS]
    singles = items.select(
        POPULATION, GROUP, F.lit(1).alias("level"), F.col("item_id").alias("lo"), *fields, *FIGURES
    )
    members = [f"{m}_{f}" for m in PAIR for f in MEMBER_FIELDS]
    both = pairs.select(POPULATION, GROUP, F.lit(2).alias("level"), *PAIR, *members, *FIGURES)
    return singles.unionByName(both, allowMissingColumns=True)


def layered_alpha(candidates: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add the significance level of each candidate's group and level, and that of the group's
    first level as ``alpha_first``.

    The budget is halved per level, shared among the candidates of the level, and never above
    that of the level before.
    """
    group = Window.partitionBy(POPULATION, GROUP)
    size = F.count(F.lit(1)).over(Window.partitionBy(POPULATION, GROUP, "level"))
    share = F.lit(alpha) / F.pow(F.lit(2.0), F.col("level")) / F.col("candidates")
    so_far = group.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min(F.when(F.col("level") == 1, share)).over(group)
    return candidates.withColumn("candidates", size).withColumns(
        {"alpha": F.min(share).over(so_far), "alpha_first": first}
    )


def independence_check(pairs: DataFrame) -> DataFrame:
    """Drop pairs about as frequent in the group as independent members would be."""
    expected = (F.col("lo_count_group") / F.col("total_group")) * (
        F.col("hi_count_group") / F.col("total_group")
    )
    support = F.col("count_group") / F.col("total_group")
    slack = F.greatest(F.lit(0.01), support * 0.15)
    return pairs.where(F.abs(expected - support) > slack)


def interaction_test(pairs: DataFrame, table: str = "shifted") -> DataFrame:
    """Keep pairs whose members interact in the group, by the exact test at the first level.

    Pairs are few and small but the test is heavy, so they are spread over all cores by hand.
    """
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    pairs = pairs.repartition(cores, POPULATION, GROUP, *PAIR)
    cells = stats.interaction_cells(
        F.col("count_group"), F.col("lo_count_group"), F.col("hi_count_group"), F.col("total_group"), table
    )
    return pairs.where(stats.fisher_at_most(*cells, F.col("alpha_first")))


def significant(rows: DataFrame, min_corr: float) -> DataFrame:
    """Keep rows significant at their level and correlated enough; undefined statistics go."""
    return rows.where((F.col("p") <= F.col("alpha")) & (F.col("phi") >= min_corr))
