"""Which versions a release channel consists of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def major(version: Column) -> Column:
    return F.substring_index(version, ".", 1)


def channel_versions(current: DataFrame) -> DataFrame:
    """Current version per channel: ``product, channel, version``.

    ``current`` has ``product, release, beta, nightly, esr, esr_next``. The next extended
    release counts once there is one, and its suffix is dropped.
    """
    esr = F.coalesce(F.nullif("esr_next", F.lit("")), F.col("esr"))
    by_channel = F.map_from_arrays(
        F.array(*[F.lit(c) for c in ("release", "beta", "nightly", "esr")]),
        F.array("release", "beta", "nightly", F.regexp_replace(esr, "esr$", "")),
    )
    return current.select("product", F.explode(by_channel).alias("channel", "version")).where(
        F.col("version").isNotNull()
    )


def release_versions(current: DataFrame, history: DataFrame) -> DataFrame:
    """All versions of each channel: ``product, channel, version``.

    Nightly is its current version. Release and extended release are ``major.0`` and every
    stability version of that major; beta is every development version of its major. ``history``
    has ``product, category, version`` with the categories ``stability`` and ``development``.
    """
    channels = channel_versions(current)
    based = channels.where(F.col("channel") != "nightly").select(
        "product", "channel", major(F.col("version")).alias("base"),
        F.when(F.col("channel") == "beta", "development").otherwise("stability").alias("category"),
    )
    past = history.where(F.col("version").contains(".")).select(
        "product", "category", major(F.col("version")).alias("base"), "version"
    )
    listed = based.join(past, ["product", "category", "base"]).select("product", "channel", "version")
    dot_zero = based.where(F.col("category") == "stability").select(
        "product", "channel", F.concat("base", F.lit(".0")).alias("version")
    )
    nightly = channels.where(F.col("channel") == "nightly")
    return nightly.unionByName(dot_zero).unionByName(listed).distinct()
