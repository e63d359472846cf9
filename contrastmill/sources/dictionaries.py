"""String dictionaries out of source-code lines ``(query, line)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The searches whose lines hold the strings, their known false hits, and the
# marks a feature string is written with.
FEATURE_QUERIES = ("ScopedGfxFeatureReporter ",)
ERROR_QUERIES = ("gfxCriticalError(", "gfxCriticalNote <<", "gfxCriticalErrorOnce(")
FEATURE_FALSE_HITS = ("gfxCrashReporterUtils.h",)
ERROR_FALSE_HITS = (", ",)
FEATURE_MARKS = ("?", "-", "+")


def first_quoted(lines: DataFrame, queries: Sequence[str] | None = None) -> DataFrame:
    """The first double-quoted string of each line, each once: ``pattern``."""
    if queries is not None:
        lines = lines.where(F.col("query").isin(list(queries)))
    quoted = F.regexp_substr("line", F.lit('"[^"\\n]*"'))
    text = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    return lines.select(text.alias("pattern")).where(F.col("pattern").isNotNull()).distinct()


def pattern_dictionary(
    lines: DataFrame,
    queries: Sequence[str] | None = FEATURE_QUERIES,
    false_hits: Sequence[str] = FEATURE_FALSE_HITS,
    marks: Sequence[str] = FEATURE_MARKS,
) -> DataFrame:
    """Feature strings, each with every mark."""
    found = first_quoted(lines, queries).where(~F.col("pattern").isin(list(false_hits)))
    mark = F.explode(F.array(*[F.lit(m) for m in marks]))
    return found.withColumn("mark", mark).select(F.concat("pattern", "mark").alias("pattern"))


def error_dictionary(
    lines: DataFrame,
    queries: Sequence[str] | None = ERROR_QUERIES,
    false_hits: Sequence[str] = ERROR_FALSE_HITS,
) -> DataFrame:
    """Error strings of several searches."""
    return first_quoted(lines, queries).where(~F.col("pattern").isin(list(false_hits)))


def pattern_list(patterns: DataFrame, limit: int = 10_000) -> list[str]:
    """The dictionary as a list, for expressions over a text column.

    The strings come from source code, not from records, so there are few; more than ``limit``
    is an error rather than a cut.
    """
    rows = patterns.select("pattern").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} patterns: not a dictionary")
    return sorted(r["pattern"] for r in rows)
