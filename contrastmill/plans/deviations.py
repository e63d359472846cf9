"""The whole mining job as one plan with written tables between its passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrastmill.operators import discovery, items, pairs, priors, pruning, rules
from contrastmill.operators import groups as grouping
from contrastmill.operators.features import FeatureSet, derive_features
from contrastmill.operators.groups import GROUP, POPULATION
from contrastmill.operators.items import Layout
from contrastmill.runtime import materialize

FIGURES = [*rules.FIGURES, "chi2", "phi"]
ITEM_FIELDS = ("key", "value", "vtype", "family", "name")


@dataclass(frozen=True)
class Settings:
    """Thresholds of the job."""

    min_support_diff: float = 0.15
    min_corr: float = 0.03
    min_count: int = 5
    alpha: float = 0.05
    interaction_table: str = "shifted"


@dataclass(frozen=True)
class Deviations:
    """``rules``: accepted rules with their priors. ``totals``: sizes of the groups tested.
    ``skipped``: groups too small to test. ``families``: what the items stand for."""

    rules: DataFrame
    totals: DataFrame
    skipped: DataFrame
    features: FeatureSet


def surviving_items(
    tagged: DataFrame,
    layout: Layout,
    totals: DataFrame,
    settings: Settings,
    overlapping: bool,
    only_true: Sequence[str] = (),
    many_groups: bool = False,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Level 1: count, discover and prune in one scan of the records.

    With ``sizes``, the totals of all groups, reference counts are summed up only for items that can
    pass the support test. Where groups are very many nearly all can, and all are summed.
    """
    s = settings.min_support_diff
    few = many_groups and not overlapping and sizes is not None and sizes.count() <= grouping.FEW_GROUPS
    least = grouping.support_bounds(sizes, s) if few else None
    counts = items.item_counts(tagged, layout, overlapping, many_groups, least)
    counted = items.min_count_filter(counts, settings.min_count)
    found = items.grouped_support(counted, totals)
    kept = discovery.keep_discovered(pruning.prune_support(found, s, settings.min_count), layout, s)
    # The rules below all look at the survivors of the support test, so they only mark rows
    # of one another's input that the others never look at.
    kept = pruning.prune_false_flag(kept)
    kept = pruning.prune_null_value(kept)
    if only_true:
        kept = pruning.prune_infobar(kept, only_true)
    versioned = [f.name for f in layout.families if f.version is not None]
    if versioned:
        kept = pruning.prune_addon_version(kept, versioned)
    return items.with_item_ids(kept)


def surviving_pairs(
    tagged: DataFrame,
    layout: Layout,
    level1: DataFrame,
    settings: Settings,
    overlapping: bool,
) -> DataFrame:
    """Level 2: pair up, count and prune in one more scan, over the columns with survivors."""
    s = settings.min_support_diff
    candidates = materialize(pairs.pair_candidates(level1, layout.restricted))
    counted = pairs.pair_counts(tagged, layout, level1, candidates, overlapping)
    kept = pruning.prune_support(pruning.with_parent_supports(counted), s, settings.min_count)
    return pruning.prune_insignificant(pruning.prune_no_change(kept, s))


def accept(level1: DataFrame, level2: DataFrame, closure: DataFrame, settings: Settings) -> DataFrame:
    """Tests, priors and final filtering; all on rule-sized tables."""
    s = settings.min_support_diff
    group = [POPULATION, GROUP]
    levels = rules.layered_alpha(rules.candidate_levels(level1, level2), settings.alpha)
    scored = materialize(rules.with_statistics(levels))
    singles = rules.significant(
        rules.support_difference(scored.where("level = 1"), s), settings.min_corr
    ).withColumnRenamed("lo", "item_id")
    both = scored.where("level = 2")

    accepted = singles.select(*group, F.col("item_id").alias("other_id"))
    linked = priors.possible_priors(both, closure).join(accepted, [*group, "other_id"], "left_semi")
    linked = materialize(priors.conditional_support(linked))
    gone = priors.explained_away(linked, s)
    effective = priors.prior_no_effect(priors.without_explained(linked, gone), s)
    best = priors.best_prior(effective)

    single_rules = (
        singles.join(gone, [*group, "item_id"], "left_anti")
        .join(best, [*group, "item_id"], "left")
        .select(*group, F.array(_member("lo_")).alias("items"), *FIGURES, "prior")
    )
    free = priors.without_explained(
        rules.significant(rules.independence_check(rules.support_difference(both, s)), settings.min_corr), gone
    ).join(effective.select(*group, "lo", "hi"), [*group, "lo", "hi"], "left_anti")
    pair_rules = rules.interaction_test(free, settings.interaction_table).select(
        *group, F.array(_member("lo_"), _member("hi_")).alias("items"), *FIGURES,
        F.lit(None).cast(best.schema["prior"].dataType).alias("prior"),
    )
    return single_rules.unionByName(pair_rules)


def _member(prefix: str) -> Column:
    return F.struct(*[F.col(prefix + f).alias(f) for f in ITEM_FIELDS])


def mine(
    tagged: DataFrame,
    layout: Layout,
    features: FeatureSet,
    settings: Settings,
    overlapping: bool,
    many_groups: bool = False,
    totals: DataFrame | None = None,
) -> Deviations:
    """Run the job on a tagged feature table; ``totals`` are counted unless they are known."""
    totals = materialize(grouping.group_totals(tagged, overlapping) if totals is None else totals)
    large, small = grouping.min_group_filter(totals, settings.min_count)
    level1 = materialize(
        surviving_items(tagged, layout, large, settings, overlapping, features.only_true, many_groups, totals)
    )
    level2 = materialize(surviving_pairs(tagged, layout, level1, settings, overlapping))
    edges = priors.prior_edges(tagged.sparkSession, features.edges)
    closure = priors.prior_closure(edges) if features.edges else edges
    return Deviations(accept(level1, level2, closure, settings), large, small, features)


def find_deviations(
    reference: DataFrame,
    *,
    group_column: str | None = None,
    names: Sequence[str] | DataFrame | None = None,
    predicates: Mapping[str, Column] | None = None,
    others: Mapping[str, DataFrame] | None = None,
    features: FeatureSet = FeatureSet(),
    settings: Settings = Settings(),
) -> Deviations:
    """Find the items and pairs over- or under-represented in each group.

    Give exactly one kind of group: the values of ``group_column`` (limited to ``names``),
    ``predicates`` over the reference, or ``others``, unrelated populations. Every column that
    is left after ``features`` have been derived and dropped is an attribute to look at.
    """
    kinds = [group_column is not None, predicates is not None, others is not None]
    if sum(kinds) != 1:
        raise ValueError("give one of group_column, predicates and others")
    if group_column is not None:
        tagged, overlapping = grouping.group_by_equality(reference, group_column, names), False
        if group_column != GROUP:
            tagged = tagged.drop(group_column)
    elif predicates is not None:
        tagged, overlapping = grouping.group_by_predicate(reference, predicates), True
    else:
        tagged, overlapping = grouping.compare_populations(reference, others), True
    prepared, families = derive_features(tagged, features)
    many = group_column is not None and names is None
    return mine(prepared, Layout.of(prepared, families), features, settings, overlapping, many)
