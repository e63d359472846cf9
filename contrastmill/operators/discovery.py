"""Which members of a family are frequent enough to be worth a feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrastmill.operators.features import VERSION_SUFFIX, Family
from contrastmill.operators.groups import GROUP, POPULATION, with_reference_count
from contrastmill.operators.items import Layout
from contrastmill.operators.numbering import rank_within
from contrastmill.runtime import materialize


def member_counts(tagged: DataFrame, members: Column, overlapping: bool = False, record_id: str | None = None) -> DataFrame:
    """Rows that have a member, per group and in the reference.

    ``members`` lists each member of a row once. When several rows can share a record id, name
    it, and each pair of record and member counts once.
    """
    ids = [] if record_id is None else [record_id]
    rows = tagged.select(POPULATION, GROUP, *ids, F.explode(members).alias("member"))
    if ids:
        rows = rows.dropDuplicates([POPULATION, GROUP, record_id, "member"])
    counts = rows.groupBy(POPULATION, "member", GROUP).agg(F.count(F.lit(1)).alias("count_group"))
    return with_reference_count(counts, [POPULATION, "member"], overlapping, many_groups=True)


def substring_counts(tagged: DataFrame, family: Family, overlapping: bool = False) -> DataFrame:
    """Rows whose text holds each dictionary string."""
    return member_counts(tagged, family.present(), overlapping)


def addon_counts(tagged: DataFrame, family: Family, overlapping: bool = False) -> DataFrame:
    """Rows that list each add-on, unparsable entries ignored."""
    return member_counts(tagged, family.present(), overlapping)


def module_counts(tagged: DataFrame, family: Family, overlapping: bool = False, record_id: str | None = None) -> DataFrame:
    """Records that load each module."""
    return member_counts(tagged, family.present(), overlapping, record_id)


def clamp_counts(counts: DataFrame) -> DataFrame:
    """Cap counts at the size of their population, for sources that list a member twice."""
    return counts.withColumns(
        {
            "count_group": F.least("count_group", "total_group"),
            "count_reference": F.least("count_reference", "total_reference"),
        }
    )


def feature_threshold(counts: DataFrame, min_support: float, by_reference: bool | Column = True) -> DataFrame:
    """Keep members above the threshold in the group, or in the reference where that counts."""
    by_reference = F.lit(by_reference) if isinstance(by_reference, bool) else by_reference
    own = F.col("support_group") > min_support
    return counts.where(own | (by_reference & (F.col("support_reference") > min_support)))


def feature_ids(kept: DataFrame, prefix: Column | str = "MOD") -> DataFrame:
    """Short ids that do not change between runs: numbered by name within a family."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    ranked = rank_within(kept.select("family", "member").distinct(), ["family"], ["member"], "__rank")
    return ranked.withColumn("feature_id", F.concat(prefix, (F.col("__rank") - 1).cast("string"))).drop("__rank")


def keep_discovered(items: DataFrame, layout: Layout, min_support: float) -> DataFrame:
    """Apply the thresholds to the families inside an item table with supports.

    Versions stay if their member is kept anywhere in the population; other items pass. Give it
    the items that passed the support test, which are few; it adds no scan of the records.
    """
    found = layout.discovered
    if not found:
        return items
    family = F.coalesce("family", F.lit(""))
    is_member = family.isin([f.name for f in found])
    own_only = family.isin([f.name for f in found if not f.by_reference])
    passes = (F.col("support_group") > min_support) | (~own_only & (F.col("support_reference") > min_support))
    versions = [f.version_name for f in found if f.versions is not None]
    if not versions:
        return items.where(~is_member | passes)
    is_version = family.isin(versions)
    base = F.when(is_version, F.substr(family, F.lit(1), F.length(family) - len(VERSION_SUFFIX))).otherwise(family)
    marked = materialize(
        items.withColumns({"__base": base, "__name": F.coalesce("name", "key"), "__kept": is_member & passes})
    )
    # members kept anywhere in a population, once each, whatever the number of its groups
    same = [POPULATION, "__base", "__name"]
    listed = marked.where("__kept").select(*same).distinct()
    of_listed = marked.where(is_version).join(listed, same, "left_semi")
    others = marked.where(F.col("__kept") | ~(is_member | is_version))
    return others.unionByName(of_listed).drop("__base", "__name", "__kept")
