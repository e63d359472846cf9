"""Headline timings: prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import QUERIES  # noqa: E402
from contrastmill.operators import groups, items  # noqa: E402
from contrastmill.sources.records import spread_scan  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "item_counts", "pair_counts", "find_deviations", "find_deviations_families",
    "find_deviations_predicates", "batch_by_channel", "module_counts", "top_words",
    "top_words_stemmed", "deviation_report",
)


def lines(spark, sf):
    """Every order line with its part, nine attributes, grouped by return flag."""
    line = spread_scan(spark.read.parquet(f"{sf}/lineitem.parquet"))
    part = spark.read.parquet(f"{sf}/part.parquet")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        "p_brand", "p_type", "p_size", F.year("l_shipdate").alias("year"),
    )


def item_counts_lines(spark, sf):
    tagged = groups.group_by_equality(lines(spark, sf), "l_returnflag").drop("l_returnflag")
    return items.item_counts(tagged, items.Layout.of(tagged))


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy(F.col("id") % 7).count().collect()
    runs = {name: QUERIES[name] for name in HEADLINES}
    runs["item_counts_lines"] = item_counts_lines
    seconds = {}
    for name, query in runs.items():
        start = time.time()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


main()
