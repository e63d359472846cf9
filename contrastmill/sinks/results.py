"""Result files: gzip JSON by population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrastmill.operators.groups import GROUP, POPULATION
from contrastmill.operators.reports import addon_related_rules, item_text


def overwrite_publish(df: DataFrame, path: str, keep_other_populations: bool = False) -> None:
    """Replace what is at ``path``, or only the populations written now."""
    mode = "dynamic" if keep_other_populations else "static"
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .option("compression", "gzip")
        .option("ignoreNullFields", "true")
        .partitionBy(POPULATION)
        .json(path)
    )


def typed_value(item: Column) -> Column:
    """The value as JSON would have it: true, 12, "text" or null."""
    value = item["value"]
    plain = F.when(item["vtype"].isin("bool", "num"), F.try_parse_json(value))
    missing = F.when(item["vtype"] == "null", F.parse_json(F.lit("null")))
    return F.coalesce(plain, missing, value.cast("variant"))


def json_items(items: Column) -> Column:
    """Items as an object from label to typed value."""
    return F.map_from_entries(F.transform(items, lambda i: F.struct(i["label"], typed_value(i))))


def rule_documents() -> Column:
    """The rules of a group as a list in a stated order, to be used in an aggregate.

    Single items come before pairs, then the larger difference of supports, then the text of the
    items. A rule without a prior has a null there, which is kept in the file.
    """
    prior = F.struct(
        json_items(F.array("prior.item")).alias("item"), "prior.count_reference",
        "prior.count_group", "prior.total_reference", "prior.total_group",
    )
    nothing = F.parse_json(F.lit("null"))
    difference = F.abs(F.col("count_reference") / F.col("total_reference") - F.col("count_group") / F.col("total_group"))
    rule = F.struct(
        F.size("items").alias("n"), (-difference).alias("less"), item_text(F.col("items")).alias("text"),
        F.struct(
            json_items(F.col("items")).alias("item"), "count_reference", "count_group",
            F.when(F.col("prior").isNotNull(), F.to_variant_object(prior)).otherwise(nothing).alias("prior"),
        ).alias("rule"),
    )

    def order(a: Column, b: Column) -> Column:
        by = F.lit(0)
        for field in ("text", "less", "n"):
            by = F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(by)
        return by

    return F.transform(F.array_sort(F.collect_list(rule), order), lambda r: r["rule"])


def result_documents(rules: DataFrame, totals: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """One document per group, keyed by the SHA-1 of its name.

    ``rules`` are labelled; ``words`` is ``population, g, top_words``. A tested group without
    rules has an empty list.
    """
    found = rules.groupBy(POPULATION, GROUP).agg(rule_documents().alias("results"))
    docs = totals.select(POPULATION, GROUP, F.col("total_group").alias("total")).join(
        found, [POPULATION, GROUP], "left"
    )
    if words is not None:
        docs = docs.join(words, [POPULATION, GROUP], "left")
    nothing = F.array().cast(found.schema["results"].dataType)
    return docs.withColumn("results", F.coalesce("results", nothing)).withColumn("key", F.sha1(F.col(GROUP)))


def write_group_results(
    rules: DataFrame, totals: DataFrame, path: str, words: DataFrame | None = None, keep_other_populations: bool = False
) -> None:
    """One JSON line per group; rows of many groups share a file."""
    overwrite_publish(result_documents(rules, totals, words), path, keep_other_populations)


def totals_document(sizes: DataFrame, date: str | Column) -> DataFrame:
    """Reference size of every population and the date of the run, as one object.

    ``sizes`` has one row per population: ``population, total_reference``.
    """
    day = F.lit(date) if isinstance(date, str) else date
    entries = F.sort_array(F.collect_list(F.struct(POPULATION, "total_reference")))
    return sizes.agg(F.map_from_entries(entries).alias("totals")).select(
        day.cast("string").alias("date"), "totals"
    )


def write_totals(sizes: DataFrame, date: str | Column, path: str) -> None:
    totals_document(sizes, date).write.mode("overwrite").option("compression", "gzip").json(path)


def related_documents(rules: DataFrame, word: str = "Addon") -> DataFrame:
    """Per population the groups with rules about add-ons, and these rules, whole."""
    found = addon_related_rules(rules, word).groupBy(POPULATION, GROUP, F.col("total_group").alias("total"))
    return found.agg(rule_documents().alias("addons"))


def write_related_groups(rules: DataFrame, path: str, word: str = "Addon") -> None:
    """``rules`` are labelled."""
    overwrite_publish(related_documents(rules, word), path)
