"""All channels in one job."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastmill.operators import groups as grouping
from contrastmill.operators import reports, words
from contrastmill.operators.features import FeatureSet, derive_features
from contrastmill.operators.groups import GROUP, POPULATION
from contrastmill.operators.items import Layout
from contrastmill.plans.deviations import Deviations, Settings, mine
from contrastmill.runtime import materialize
from contrastmill.sinks import results
from contrastmill.sources import records as source


@dataclass(frozen=True)
class BatchResult:
    deviations: Deviations
    rules: DataFrame  # labelled
    sizes: DataFrame  # population, total_reference
    top_words: DataFrame | None  # population, g, top_words
    related: DataFrame  # groups related to add-ons

    def rows(self) -> DataFrame:
        """Everything as one table, a row for each ``kind`` of thing.

        ``size``: records of a population. ``group``: records of a group. ``rule``: a rule with its
        place, as in the files, and its prior. ``related``: the rules about add-ons that make a group
        related to them. ``word``: a word with its rank.
        """
        group, reference, difference = reports.differences()
        text = F.array_join(F.array_sort(F.transform("items", lambda i: reports.item_text(F.array(i)))), " ∧ ")
        figures = ["count_group", "count_reference", "total_group", "total_reference"]
        order = Window.partitionBy(POPULATION, GROUP).orderBy(F.size("items"), F.desc(difference), text)
        placed = self.rules.select(
            F.lit("rule").alias("kind"), POPULATION, GROUP, F.row_number().over(order).alias("place"), text.alias("text"),
            *figures, F.when(F.col("prior").isNotNull(), reports.item_text(F.array("prior.item"))).alias("prior"),
            *[F.col(f"prior.{c}").alias(f"prior_{c}") for c in figures],
        )
        about = reports.addon_related_rules(self.rules).select(POPULATION, GROUP, text.alias("text")).distinct()
        related = placed.join(about, [POPULATION, GROUP, "text"], "left_semi").withColumn("kind", F.lit("related"))
        sizes = self.sizes.select(F.lit("size").alias("kind"), POPULATION, "total_reference")
        groups = self.deviations.totals.select(F.lit("group").alias("kind"), POPULATION, GROUP, *figures[2:])
        out = placed
        parts = [related, sizes, groups]
        if self.top_words is not None:
            words_ = self.top_words.select(POPULATION, GROUP, F.posexplode("top_words").alias("place", "text"))
            parts.append(words_.withColumns({"kind": F.lit("word"), "place": F.col("place") + 1}))
        for part in parts:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    def write(self, path: str, date: str | Column) -> None:
        """Publish everything under ``path``, replacing what was there."""
        results.write_group_results(self.rules, self.deviations.totals, f"{path}/groups", self.top_words)
        results.write_totals(self.sizes, date, f"{path}/all")
        results.write_related_groups(self.rules, f"{path}/addon_related")


def batch_by_channel(
    records: DataFrame,
    channels: DataFrame,
    *,
    group_column: str,
    as_of: str | Column,
    product: str | None = None,
    mobile_products: Iterable[str] = (),
    product_column: str = "product",
    version_column: str = "version",
    date_column: str = "crash_date",
    comment: str | None = "user_comments",
    locale: str | None = "useragent_locale",
    number: int = 200,
    days: int = 5,
    word_days: int = 30,
    features: FeatureSet = FeatureSet(),
    settings: Settings = Settings(),
    names: DataFrame | None = None,
    stem: bool = True,
) -> BatchResult:
    """Top groups, deviations and words of every channel.

    ``channels`` is ``(population, version)``. The channel travels with every key, so all of
    them are counted in the same scans, whatever their number. The records are read three times:
    for sizes, ranking and words of their several windows at once, for items, and for pairs.
    """
    if product is not None:
        records = records.where(grouping.col(product_column) == product)
        records = source.prune_platform_columns(records, product, mobile_products)
    channels = materialize(channels.select(POPULATION, "version").distinct())
    records = source.assign_channels(records, channels, version_column)
    comment = comment if comment in records.columns else None
    locale = locale if locale in records.columns else None
    # The search for the most frequent groups looks back one day less than the job itself.
    windows = {"ranked": days - 1, "record": days, "word": word_days}
    counted = materialize(window_counts(records, group_column, date_column, as_of, windows, comment, locale))

    ranked = counted.where("kind = 'ranked' and g is not null").select(POPULATION, GROUP, F.col("n").alias("total_group"))
    wanted = materialize(grouping.rank_groups(ranked, number).select(POPULATION, GROUP))
    members = counted.where("kind = 'record'").select(POPULATION, GROUP, F.col("n").alias("total_group"))
    sizes = materialize(members.groupBy(POPULATION).agg(F.sum("total_group").alias("total_reference")))
    totals = members.join(wanted, [POPULATION, GROUP], "left_semi").join(sizes, POPULATION)

    window = source.filter_date_window(records, date_column, as_of, days)
    tagged = grouping.group_by_equality(window, group_column, wanted).drop(group_column)
    prepared, families = derive_features(tagged, features)
    layout = Layout.of(prepared, families)
    found = mine(prepared, layout, features, settings, overlapping=False, totals=totals)
    labelled = materialize(reports.label_items(found.rules, families, names))

    lists = None
    if comment is not None:
        raw = counted.where("kind = 'word'").select(POPULATION, GROUP, "word", F.col("n").alias("tf"))
        terms = words.stop_words(words.clean_words(raw, stem))
        lists = words.word_lists(words.rank_counted(terms, counted.where("kind = 'comment'"), wanted))
    return BatchResult(found, labelled, sizes, lists, reports.addon_related_groups(labelled))


def window_counts(
    records: DataFrame,
    group_column: str,
    date_column: str,
    as_of: str | Column,
    windows: dict[str, int],
    comment: str | None = None,
    locale: str | None = None,
) -> DataFrame:
    """``kind, population, g, word, n``: what several windows of days need to know, in one scan.

    ``windows`` gives the days of ``ranked`` and ``record``, which count the rows of each group, and
    of ``word``, which counts the comments with each different raw word. ``comment`` counts the
    comments of a group. A row is tagged once for each window that it is in, and the tags are
    aggregated in the stage of the scan.
    """

    def within(days: int) -> Column:
        return grouping.col(date_column) >= source.first_day(as_of, days)

    def entry(kind: str, word: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if word is None else word).cast("string").alias("word"))

    kinds = ["ranked", "record"]
    entries = F.array_compact(F.array(*[F.when(within(windows[k]), entry(k)) for k in kinds]))
    if comment is not None:
        kinds.append("word")
        distinct = F.array_distinct(words.tokenize(grouping.col(comment)))
        listed = F.concat(F.transform(distinct, lambda w: entry("word", w)), F.array(entry("comment")))
        said = words.is_comment(comment, locale) & within(windows["word"])
        entries = F.concat(entries, F.when(said, listed).otherwise(F.array().cast("array<struct<kind:string,word:string>>")))
    rows = records.where(within(max(windows[k] for k in kinds)))
    group = grouping.col(group_column).cast("string").alias(GROUP)
    return rows.select(POPULATION, group, F.inline(entries)).groupBy("kind", POPULATION, GROUP, "word").agg(F.count(F.lit(1)).alias("n"))
