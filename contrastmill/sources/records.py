"""The record table: reading and filtering a population."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastmill.operators.groups import POPULATION, col

# Attributes only the mobile product reports.
PLATFORM_COLUMNS = (
    "android_board", "android_brand", "android_cpu_abi", "android_cpu_abi2", "android_device",
    "android_hardware", "android_manufacturer", "android_model", "android_version",
)


def first_day(as_of: str | Column, days: int) -> Column:
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return F.date_sub(day, days)


def filter_date_window(df: DataFrame, column: str, as_of: str | Column, days: int) -> DataFrame:
    """Rows from ``days`` before ``as_of`` on, that day included."""
    return df.where(col(column) >= first_day(as_of, days))


def filter_product_version(
    df: DataFrame,
    product: str,
    versions: Sequence[str] | DataFrame,
    product_column: str = "product",
    version_column: str = "version",
) -> DataFrame:
    """Rows of a product and of any of the versions; a table of versions is semi-joined."""
    df = df.where(col(product_column) == product)
    if isinstance(versions, DataFrame):
        wanted = versions.select(F.col(versions.columns[0]).alias(version_column))
        return df.join(wanted, version_column, "left_semi")
    return df.where(col(version_column).isin(list(versions)))


def prune_platform_columns(
    df: DataFrame, product: str, mobile_products: Iterable[str] = (), columns: Iterable[str] = PLATFORM_COLUMNS
) -> DataFrame:
    """Drop the mobile attributes unless a mobile product is asked for."""
    return df if product in set(mobile_products) else df.drop(*columns)


def read_records(spark: SparkSession, source: str | DataFrame, fmt: str = "parquet", **options: str) -> DataFrame:
    """The record table from any Spark source; add-on lists inside a struct are lifted out."""
    if isinstance(source, DataFrame):
        df = source
    else:
        df = spark.read.format(fmt).options(**options).load(source)
    fields = dict(df.dtypes)
    if fields.get("addons", "").startswith("struct<list:"):
        df = df.withColumn("addons", F.col("addons.list"))
    return df


def spread_scan(scan: DataFrame) -> DataFrame:
    """Spread a table read from few or unsplittable files over all cores.

    Give it the table as read, before any join or grouping: then the number of splits is known
    from planning alone. A table with at least as many splits as cores stays as it is, so that
    large inputs are never shuffled for this.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def load_population(
    spark: SparkSession,
    source: str | DataFrame,
    product: str,
    versions: Sequence[str] | DataFrame,
    days: int,
    as_of: str | Column,
    *,
    date_column: str = "crash_date",
    mobile_products: Iterable[str] = (),
    fmt: str = "parquet",
) -> DataFrame:
    """Records of one product, a list of versions and the last days."""
    df = filter_date_window(read_records(spark, source, fmt), date_column, as_of, days)
    df = prune_platform_columns(df, product, mobile_products)
    return filter_product_version(df, product, versions)


def assign_channels(df: DataFrame, channels: DataFrame, version_column: str = "version") -> DataFrame:
    """Put records into the populations of their version: ``channels`` is ``(population, version)``.

    A version listed for two populations puts its records into both.
    """
    wanted = channels.select(POPULATION, F.col("version").alias(version_column)).distinct()
    return df.join(wanted, version_column)


def cohort_filter(
    df: DataFrame,
    equals: dict[str, str] | None = None,
    prefixes: dict[str, str] | None = None,
    differs: dict[str, str] | None = None,
    select: Sequence[str] | None = None,
) -> DataFrame:
    """Rows that meet all equalities, prefixes and inequalities, projected to some columns."""
    for name, value in (equals or {}).items():
        df = df.where(col(name) == value)
    for name, value in (prefixes or {}).items():
        df = df.where(col(name).startswith(value))
    for name, value in (differs or {}).items():
        df = df.where(col(name) != value)
    return df if select is None else df.select(*[col(c) for c in select])
