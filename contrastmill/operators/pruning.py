"""Pruning of items and pairs that cannot become useful rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastmill.functions import stats
from contrastmill.operators.features import NOT_INSTALLED, VERSION_SUFFIX
from contrastmill.operators.groups import GROUP, POPULATION

# Values next to which a missing value says nothing more.
PRESENT_VALUES = ("1", "Active")

# Fixed value: a version this close to its add-on's support adds nothing.
SAME_SUPPORT = 0.01

# Fixed value: parents and pair this alike do not differ.
NO_DIFFERENCE = 0.5


def change_threshold(min_support_diff: float) -> float:
    return min(0.05, min_support_diff / 2)


def prune_support(counts: DataFrame, min_support_diff: float, min_count: int = 5) -> DataFrame:
    """Keep what occurs often enough to be tested and, on one side, to matter."""
    return counts.where(
        (F.col("count_reference") >= min_count)
        & (F.col("count_group") >= min_count)
        & ((F.col("support_reference") >= min_support_diff) | (F.col("support_group") >= min_support_diff))
    )


def _any_of_key(condition: Column) -> Column:
    """Does some surviving item of the same group and key meet the condition."""
    return F.max(F.coalesce(condition, F.lit(False))).over(Window.partitionBy(POPULATION, GROUP, "key"))


def prune_false_flag(items: DataFrame) -> DataFrame:
    """A false flag goes when the true one is there."""
    boolean = F.col("vtype") == "bool"
    has_true = _any_of_key(boolean & (F.col("value") == "true"))
    return (
        items.withColumn("__true", has_true)
        .where(~(boolean & (F.col("value") == "false") & F.col("__true")))
        .drop("__true")
    )


def prune_null_value(items: DataFrame) -> DataFrame:
    """A missing value goes when the value that means *present* is there."""
    present = (F.col("vtype") == "str") & F.col("value").isin(*PRESENT_VALUES)
    return (
        items.withColumn("__present", _any_of_key(present))
        .where(~((F.col("vtype") == "null") & F.col("__present")))
        .drop("__present")
    )


def prune_infobar(items: DataFrame, only_true: Sequence[str] = ("submitted_from_infobar",)) -> DataFrame:
    """Of these keys only the true value is of interest."""
    is_true = (F.col("vtype") == "bool") & F.col("value").eqNullSafe("true")
    return items.where(~F.col("key").isin(list(only_true)) | is_true)


def prune_addon_version(items: DataFrame, families: Sequence[str] = ("addon",)) -> DataFrame:
    """A version goes when it names none, or follows its add-on's support."""
    versions = [f + VERSION_SUFFIX for f in families]
    is_version = F.coalesce(F.col("family").isin(versions), F.lit(False))
    is_member = F.coalesce(F.col("family").isin(list(families)), F.lit(False)) & (F.col("value") == "true")
    cut = len(VERSION_SUFFIX)
    family = F.when(is_version, F.expr(f"left(family, length(family) - {cut})")).otherwise(F.col("family"))
    member = F.when(is_version, F.expr(f"left(key, length(key) - {cut})")).otherwise(F.col("key"))
    of_member = Window.partitionBy(POPULATION, GROUP, "__family", "__member")
    support = F.max(F.when(is_member, F.col("support_group"))).over(of_member)
    nothing = F.col("value").isNull() | (F.col("value") == NOT_INSTALLED)
    same = F.coalesce(F.abs(F.col("support_group") - F.col("__support")) <= SAME_SUPPORT, F.lit(False))
    return (
        items.withColumns({"__family": family, "__member": member})
        .withColumn("__support", support)
        .where(~(is_version & (nothing | same)))
        .drop("__family", "__member", "__support")
    )


def with_parent_supports(pairs: DataFrame) -> DataFrame:
    """Support of a pair, of each member, and of the pair within each member."""
    sides = {"group": F.col("total_group"), "reference": F.col("total_reference")}
    added = {}
    for side, total in sides.items():
        added[f"support_{side}"] = F.col(f"count_{side}") / total
        for m in ("lo", "hi"):
            added[f"{m}_support_{side}"] = F.col(f"{m}_count_{side}") / total
            added[f"given_{m}_{side}"] = F.col(f"count_{side}") / F.col(f"{m}_count_{side}")
    return pairs.withColumns(added)


def prune_no_change(pairs: DataFrame, min_support_diff: float) -> DataFrame:
    """Drop pairs that hardly change the support of a member; adds ``clear``, true for pairs
    that plainly change both and need no further test."""
    t = change_threshold(min_support_diff)

    def moved(m: str) -> Column:
        return (F.abs(F.col(f"{m}_support_reference") - F.col(f"given_{m}_reference")) > t) | (
            F.abs(F.col(f"{m}_support_group") - F.col(f"given_{m}_group")) > t
        )

    def same(m: str) -> Column:
        return (F.abs(F.col(f"{m}_support_reference") - F.col("support_reference")) < t) & (
            F.abs(F.col(f"{m}_support_group") - F.col("support_group")) < t
        )

    return pairs.withColumn("clear", moved("lo") & moved("hi")).where(
        F.col("clear") | ~(same("lo") | same("hi"))
    )


def prune_insignificant(pairs: DataFrame) -> DataFrame:
    """Of the pairs not clear yet, drop those that differ from neither member."""

    def p(m: str) -> Column:
        chi2 = stats.chi2_yates(
            F.col(f"{m}_count_group"), F.col("count_group"),
            F.col(f"{m}_count_reference"), F.col("count_reference"),
        )
        return F.coalesce(stats.chi2_pvalue(chi2), F.lit(0.0))

    return pairs.where(F.col("clear") | (p("lo") <= NO_DIFFERENCE) | (p("hi") <= NO_DIFFERENCE))
