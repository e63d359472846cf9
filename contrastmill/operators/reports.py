"""Readable rules: display names, text report, chart table, related groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastmill.operators.features import VERSION_SUFFIX, Family
from contrastmill.operators.groups import GROUP, POPULATION

RULE = [POPULATION, GROUP]


def name_dimension(rows: DataFrame, column: str, names: DataFrame, target: str) -> DataFrame:
    """Display name of an identifier out of a table ``(id, name)``; the identifier itself when
    the table has none. ``id`` must be unique in it."""
    table = names.select(F.col("id").alias("__id"), F.col("name").alias("__name"))
    return (
        rows.join(table, F.col(column) == F.col("__id"), "left")
        .withColumn(target, F.coalesce("__name", F.col(column)))
        .drop("__id", "__name")
    )


def _member_name(item: Column, families: Sequence[Family]) -> Column:
    """Name of the family member an item is about, null for plain attributes."""
    versions = [f.version_name for f in families if f.version is not None]
    key = item["key"]
    if versions:
        base = F.substr(key, F.lit(1), F.length(key) - len(VERSION_SUFFIX))
        key = F.when(item["family"].isin(versions), base).otherwise(key)
    return F.when(item["family"].isNotNull(), F.coalesce(item["name"], key))


def _label(item: Column, member: Column, families: Sequence[Family]) -> Column:
    chain = item["key"]
    for f in families:
        chain = F.when(item["family"] == f.name, F.format_string(f.label, member)).otherwise(chain)
        if f.version is not None:
            version = F.format_string(f.version_label, member)
            chain = F.when(item["family"] == f.version_name, version).otherwise(chain)
    return chain


def label_items(rules: DataFrame, families: Sequence[Family] = (), names: DataFrame | None = None) -> DataFrame:
    """Add a ``label`` to every item of a rule and of its prior.

    ``names`` maps members to display names. A rule has at most two items and one prior, so each
    place is looked up with its own join to the small table.
    """
    places = {"a": F.get("items", F.lit(0)), "b": F.get("items", F.lit(1)), "p": F.col("prior.item")}
    out = rules.withColumns({f"__{n}": _member_name(i, families) for n, i in places.items()})
    if names is not None:
        for n in places:
            out = name_dimension(out, f"__{n}", names, f"__{n}")

    def labelled(n: str) -> Column:
        item = places[n]
        with_label = item.withField("label", _label(item, F.col(f"__{n}"), families))
        return F.when(item.isNotNull(), with_label)

    prior = F.col("prior").withField("item", labelled("p"))
    return out.withColumns(
        {
            "items": F.array_compact(F.array(labelled("a"), labelled("b"))),
            "prior": F.when(F.col("prior").isNotNull(), prior),
        }
    ).drop(*[f"__{n}" for n in places])


def item_map(items: Column) -> Column:
    """Items as a map from label to value, all values text."""
    return F.map_from_entries(F.transform(items, lambda i: F.struct(i["label"], i["value"])))


def value_text(item: Column) -> Column:
    """The value as the report prints it."""
    return (
        F.when(item["vtype"] == "null", "None")
        .when(item["vtype"] == "bool", F.initcap(item["value"]))
        .otherwise(item["value"])
    )


def item_text(items: Column) -> Column:
    """``label="value"`` of every item, joined by a logical and."""
    parts = F.transform(
        items, lambda i: F.concat(i["label"], F.lit('="'), value_text(i), F.lit('"'))
    )
    return F.array_join(parts, " ∧ ")


def hundredths(x: Column) -> Column:
    """A number from 0 up in whole hundredths, by its exact binary value; exact ties go to the even one.

    The fraction below 1 is a whole number of 2**-56, or of 2**-60 if it is below 1/16 and does not
    round to nothing anyway, and a hundred times that fits in 64 bits.
    """
    whole = F.floor(x).cast("long")
    fraction = x - whole

    def cents(bits: int) -> Column:
        scaled = F.floor(fraction * float(2**bits)).cast("long") * 100
        down = F.shiftright(scaled, bits)
        rest, half = scaled - F.shiftleft(down, bits), F.lit(2 ** (bits - 1))
        return down + F.when((rest > half) | ((rest == half) & (down % 2 == 1)), 1).otherwise(0)

    return whole * 100 + F.when(fraction < 1 / 256, 0).when(fraction < 1 / 16, cents(60)).otherwise(cents(56))


def percentage(share: Column) -> Column:
    """Two decimals and at least two digits before them, ``100.0`` for the whole."""
    n = hundredths(share * 100)
    text = F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.when(text == "100.00", "100.0").otherwise(F.lpad(text, F.greatest(F.length(text), F.lit(5)), "0"))


def differences() -> tuple[Column, Column, Column]:
    group = F.col("count_group") / F.col("total_group")
    reference = F.col("count_reference") / F.col("total_reference")
    return group, reference, F.abs(reference - group)


def deviation_report(rules: DataFrame, reference_name: str = "overall") -> DataFrame:
    """One line per rule: single items by difference first, then pairs by rounded difference."""
    group, reference, difference = differences()
    items = F.size("items")
    single = items == 1
    given = F.concat(
        F.lit(" ["), percentage(F.col("prior.count_group") / F.col("prior.total_group")),
        F.lit("% vs "), percentage(F.col("prior.count_reference") / F.col("prior.total_reference")),
        F.lit("% given "), item_text(F.array(F.col("prior.item"))), F.lit("]"),
    )
    line = F.concat(
        F.lit("("), percentage(group), F.lit("% in "), F.col(GROUP), F.lit(" vs "),
        percentage(reference), F.lit(f"% {reference_name}) "), item_text(F.col("items")),
        F.coalesce(F.when(F.col("prior").isNotNull(), given), F.lit("")),
    )
    rows = rules.select(
        *RULE, items.alias("__n"), F.when(single, difference).otherwise(hundredths(difference).cast("double")).alias("__d"),
        item_text(F.col("items")).alias("__t"), line.alias("line"),
    )
    order = Window.partitionBy(*RULE).orderBy("__n", F.desc("__d"), "__t")
    return rows.select(*RULE, F.row_number().over(order).alias("line_no"), "line")


def support_chart_table(rules: DataFrame) -> DataFrame:
    """Bars of a support chart in drawing order."""
    group, reference, difference = differences()
    rows = rules.select(
        *RULE, item_text(F.col("items")).alias("label"),
        (reference * 100).alias("percent_reference"), (group * 100).alias("percent_group"),
        F.size("items").alias("__n"), hundredths(difference).alias("__d"), hundredths(reference).alias("__s"),
    )
    order = Window.partitionBy(*RULE).orderBy(F.desc("__n"), "__d", "__s", "label")
    return rows.withColumn("position", F.row_number().over(order)).drop("__n", "__d", "__s")


def addon_related_rules(rules: DataFrame, word: str = "Addon") -> DataFrame:
    """Single-item rules about an add-on that is more frequent in the group."""
    group, reference, _ = differences()
    about = F.get("items", F.lit(0))["label"].contains(word)
    return rules.where((F.size("items") == 1) & about & (group > reference))


def addon_related_groups(rules: DataFrame, word: str = "Addon") -> DataFrame:
    """Groups with such rules, and the rules."""
    rule = F.struct("items", "count_reference", "count_group", "prior")
    return (
        addon_related_rules(rules, word)
        .groupBy(*RULE, "total_group")
        .agg(F.sort_array(F.collect_list(rule)).alias("addons"))
    )
