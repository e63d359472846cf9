"""The provided tables in the roles the mining job needs.

Nothing here is part of the library: it gives records, arrays and texts out of the given tables,
each row by itself or with one plain join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastmill.functions import scalars
from contrastmill.operators.features import (
    FeatureSet,
    FeatureSpec,
    addon_family,
    module_family,
    text_family,
)
from contrastmill.sources.records import spread_scan

AS_OF = "2024-01-31"

# Strings looked for in the texts.
PATTERNS = ("the", "und", "que", "ción", "ê", "###", "@", "Lorem?")

# What may explain what among the document attributes.
DOC_EDGES = (
    ("has_the", "has_e"), ("size", "has_the"), ("toxic", "has_the"), ("source", "size"),
    ("source", "quality"), ("quality", "source"),
)
WORD_EDGES = (("long", "@addon"), ("long", "@addon-version"), ("long", "@module"), ("size", "@text"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for work that is heavy per row; the provided files have one split each."""
    return spread_scan(table(spark, sf, name))


def doc_features() -> list[Column | str]:
    text, n = F.col("text"), F.col("n_chars")
    return [
        "source", F.col("quality").cast("string").alias("quality"), "toxic",
        text.contains("the").alias("has_the"), text.contains("ê").alias("has_e"), (n > 2000).alias("long"),
        F.when(n < 500, "small").when(n < 4000, "medium").otherwise("large").alias("size"),
    ]


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels where they have some; ``lang`` is the group."""
    return spread(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("lang", *doc_features())


def raw_words():
    return F.split("text", " ")


def addon_entries():
    """Every word of three letters or more as ``lower:original``; shorter ones cannot be parsed."""
    return F.transform(raw_words(), lambda w: F.when(F.length(w) > 2, F.concat(F.lower(w), F.lit(":"), w)).otherwise(w))


def module_struct():
    """The words as a nested module list."""
    elements = F.transform(
        raw_words(), lambda w: F.struct(F.struct(w.alias("filename")).alias("element"))
    )
    return F.struct(F.struct(elements.alias("list")).alias("modules"))


def word_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records with add-ons, nested modules and a free text."""
    return spread(spark, sf, "documents").select(
        "doc_id", "lang", "source", "n_chars", "text",
        addon_entries().alias("addons"), module_struct().alias("json_dump"),
    )


WORD_ADDONS = addon_family("addons")
WORD_MODULES = None
WORD_TEXTS = text_family("text", PATTERNS, "text", '"%s" in text')


def word_modules(record_id: str | None = None):
    return module_family(
        scalars.module_names(F.col("json_dump.modules.list")), ("json_dump",), partners=("long", "size"), record_id=record_id
    )


def word_features() -> FeatureSet:
    n = F.col("n_chars")
    return FeatureSet(
        specs=(
            FeatureSpec(("n_chars",), "long", n > 2000),
            FeatureSpec(("n_chars",), "size", F.when(n < 500, "small").when(n < 4000, "medium").otherwise("large")),
        ),
        families=(WORD_ADDONS, word_modules(), WORD_TEXTS),
        drop=("doc_id", "n_chars", "text", "addons", "json_dump", "source"),
        edges=WORD_EDGES,
    )


def event_records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as records with a date, a product, a version and a group."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        "event_id", F.to_date("ts").alias("crash_date"),
        F.when(F.col("user_id") % 10 == 0, "tablet").otherwise("desktop").alias("product"),
        F.concat(F.lit("v"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("string")).alias("version"),
        F.concat("event_type", F.when(k < 50, "/low").otherwise("/high")).alias("signature"),
        (k < 20).alias("small"), (k % 2 == 0).alias("even"), (F.col("value") > 10).alias("dear"),
        F.when(F.hour("ts") < 12, "am").otherwise("pm").alias("half"),
    )


# What may explain what among the crossed attributes.
CROSSED_EDGES = (("kind", "place"), ("parity", "mood"), ("rating", "day"))


def crossed_records(spark: SparkSession, sf: str) -> DataFrame:
    """Events with attributes of every type, grouped by whether two of them agree, so that neither
    alone but both together tell groups apart."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = spread(spark, sf, "events").withColumns(
        {
            "k": k, "parity": F.when(k % 2 == 0, "even").otherwise("odd"),
            "price": F.when(F.col("value") > 35, "dear").otherwise("cheap"),
        }
    )
    kind, place = F.col("event_type"), F.col("k") < 60
    agree = (F.col("parity") == "even") == (F.col("price") == "dear")
    up = ((kind == "error") & (F.col("k") < 70)) | ((F.col("parity") == "even") & (F.col("k") < 50))
    return rows.select(
        F.concat(kind, F.when(agree, "/agree").otherwise("/differ")).alias("cross"),
        kind.alias("kind"), "parity", "price", (F.hour("ts") < 12).alias("morning"),
        F.when(kind == "view", None).when(kind == "click", 7).otherwise(F.col("user_id") % 5).alias("rating"),
        F.when(kind.isin("click", "view") & place, "screen").otherwise("other").alias("place"),
        F.when(up, "up").otherwise("down").alias("mood"),
        F.when(kind == "signup", F.lit("2024-01-01").cast("date")).otherwise(F.to_date("ts")).alias("day"),
    )


def channels(spark: SparkSession, sf: str) -> DataFrame:
    """Weeks as channels; the last two weeks are one channel, and the fourth is in two."""
    versions = event_records(spark, sf).select("version").distinct()
    late = F.when(F.col("version").isin("v3", "v4"), "late")
    names = F.array_compact(F.array(late, F.when(F.col("version") != "v4", F.concat(F.lit("week-"), "version"))))
    return versions.select(F.explode(names).alias("population"), "version")


def report_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as reports with a product, a version, a date, add-ons and a comment."""
    i, n = F.col("doc_id"), F.col("n_chars")
    return spread(spark, sf, "documents").select(
        "doc_id", F.when(i % 10 == 0, "tablet").otherwise("desktop").alias("product"),
        F.concat(F.lit("v"), (i % 4).cast("string")).alias("version"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 31).cast("int")).alias("crash_date"),
        F.concat("lang", F.lit("/"), (F.floor(i / 7) % 3).cast("string")).alias("signature"),
        F.col("lang").alias("useragent_locale"), F.col("text").alias("user_comments"), addon_entries().alias("addons"),
        (n > 2000).alias("long"), F.when(n < 500, "small").when(n < 4000, "medium").otherwise("large").alias("size"),
    )


def report_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions are a channel; the third channel has one of each."""
    versions = report_records(spark, sf).select("version").distinct()
    v = F.col("version")
    names = F.array_compact(F.array(F.when(v.isin("v0", "v2"), "even").otherwise("odd"), F.when(v.isin("v1", "v2"), "mixed")))
    return versions.select(F.explode(names).alias("population"), "version")


REPORT_EDGES = (("long", "@addon"), ("size", "@addon"), ("size", "long"))


def report_features() -> FeatureSet:
    return FeatureSet(
        families=(WORD_ADDONS,), edges=REPORT_EDGES,
        drop=("doc_id", "product", "version", "crash_date", "useragent_locale", "user_comments", "addons"),
    )


def part_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Current versions and release history of every brand."""
    part = table(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    history = part.select(
        F.col("p_brand").alias("product"),
        F.when(key % 2 == 0, "stability").otherwise("development").alias("category"),
        F.concat(size, F.lit("."), (key % 7).cast("string"), F.when(key % 5 == 0, ".1").otherwise("")).alias("version"),
    )
    low, high = F.min("p_size"), F.max("p_size")
    current = part.groupBy(F.col("p_brand").alias("product")).agg(
        F.concat(high.cast("string"), F.lit(".0.2")).alias("release"),
        F.concat((high - 1).cast("string"), F.lit(".0b3")).alias("beta"),
        F.concat((high + 2).cast("string"), F.lit(".0a1")).alias("nightly"),
        F.concat(low.cast("string"), F.lit(".4.0esr")).alias("esr"),
        F.when(F.count(F.lit(1)) % 2 == 0, F.concat((high - 3).cast("string"), F.lit(".0esr"))).otherwise("").alias("esr_next"),
    )
    return current, history


def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as source lines; the query is the attribute the line is about."""
    lines = table(spark, sf, "pages").select(F.explode(F.split("html", ">")).alias("line"))
    query = (
        F.when(F.col("line").contains("href="), "link")
        .when(F.col("line").contains("class="), "class").when(F.col("line").contains("lang="), "lang")
        .otherwise("other")
    )
    return lines.select(query.alias("query"), "line")


def devices(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as devices with memory, platform, driver and processor texts."""
    key, size = F.col("p_partkey"), F.col("p_size")
    memory = (
        F.when(key % 5 == 1, "n/a").when(key % 5 == 2, "").when(key % 5 > 2, (key * 3000000).cast("string"))
    )
    return table(spark, sf, "part").select(
        "p_partkey", memory.alias("total_virtual_memory"),
        F.when(size % 3 == 0, "Mac OS X").when(size % 3 == 1, "Linux").otherwise("Windows").alias("platform"),
        F.when(key % 7 == 0, None)
        .otherwise(F.concat("p_name", F.when(size % 4 == 0, " i686").when(size % 4 == 1, " x86_64").otherwise(" 10")))
        .alias("platform_version"),
        F.when(size % 5 == 0, "0x8086").when(size % 5 == 1, "10de").when(size % 5 == 2, "0x10de")
        .when(size % 5 == 3, "0x1002").alias("adapter_vendor_id"),
        F.when(key % 11 == 0, None).when(key % 11 == 1, "").when(key % 11 == 2, key.cast("string"))
        .otherwise(F.concat(size.cast("string"), F.lit(".15."), key.cast("string"))).alias("adapter_driver_version"),
        F.when(key % 13 > 0, F.concat("p_type", F.lit(" "), size.cast("string"), F.lit(" | "), (key % 3).cast("string")))
        .alias("cpu_info"),
        F.when(key % 3 > 0, size - 25).alias("memory_ghost_windows"),
        F.when(key % 4 > 0, 10 - size).alias("memory_top_none_detached"),
        F.when(key % 6 > 0, F.concat("p_brand", F.when(size % 2 == 0, " Has dual GPUs").otherwise(" one GPU"))).alias("app_notes"),
    )
