"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight that changes over training time 0 to 1 as a polygon through the values
of its schedule. The integral of the weight, scaled to the source's target, is the number of words
the mix has drawn from the source by then. A document's words stand at some place in its source's
order, so inverting that integral gives the time at which the mix reaches it: its position. The
result is sorted by position over ranges of it.

Sources count in the order of their names (code points, null last) and take ``weights`` and
``schedules`` in turn. Targets share the words of all documents by weight; none exceeds
``most_epochs`` times its source, and what is cut off is shared anew among the others. A source
takes its documents in the order of a hash of their id, whole epochs first and then the beginning
of the order again; the document at the end is taken in part.

Running sums within a source come from sums over 4096 ranges of the hash and one within each
range, so a source that holds most rows is spread over as many tasks.

Null texts and texts without words have size 0 and take nothing. Repeated rows are documents of
their own. An input column that has the name of an output column is replaced. No documents, no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastmill.runtime import materialize

WEIGHTS = (5, 2, 1)
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.0, 1.5))
MOST_EPOCHS = 3
RANGE_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, turn, target`` from ``source, source_size``.

    A source is at its limit if its limit is no more than its share of what is left after all
    sources with a smaller limit per weight took theirs. All sums are whole numbers.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = sizes.withColumn("turn", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") % len(weights) + 1).cast("long"))
    s = s.withColumn("limit", F.col("source_size") * most_epochs)
    s = s.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(by_limit), F.lit(0)))
    s = s.withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0)))
    s = s.withColumn("full", F.col("limit") * F.col("rest") <= F.col("left") * F.col("weight"))
    # the first source below its limit sets the share of all of them
    share = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "turn", "left", "rest"))).over(whole)
    s = s.withColumn("share", share)
    free = (F.col("share.left") * F.col("weight")).cast("double") / F.col("share.rest")
    return s.select(
        "source", "source_size", "turn", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(free).alias("target")
    )


def reached(share: Column, turn: Column, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """The time at which a source has given ``share`` (0 to 1) of what it gives."""
    tables = []
    for values in schedules:
        if len(values) < 2 or min(values) < 0 or sum(values) == 0:
            raise ValueError("a schedule needs two values or more, none negative and one above zero")
        step, done, parts = 1 / (len(values) - 1), 0.0, []
        for i, (a, b) in enumerate(zip(values, values[1:])):
            parts.append((i * step, done, float(a), (b - a) / step))
            done += (a + b) / 2 * step
        names = ("t", "c", "a", "slope")
        scaled = ((t, c / done, a / done, slope / done) for t, c, a, slope in parts)
        tables.append(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(p, names))) for p in scaled)))
    table = F.when(turn % len(schedules) == 0, tables[0])
    for i, other in enumerate(tables[1:], 1):
        table = table.when(turn % len(schedules) == i, other)
    part = F.element_at(F.filter(table, lambda p: p["c"] <= share), -1)
    y = share - part["c"]
    root = F.sqrt(F.greatest(part["a"] * part["a"] + 2 * part["slope"] * y, F.lit(0.0)))
    x = F.when(y > 0, 2 * y / (part["a"] + root)).otherwise(0.0)
    return F.least(part["t"] + x, F.lit(1.0))


def _placed(docs: DataFrame, weights: Sequence[int], most_epochs: int, size: Column | None) -> DataFrame:
    """``docs`` with ``_mix_size, _mix_source_size, _mix_target, _mix_taken, _mix_turn`` and ``_mix_before``, the words ahead in its source."""
    size = words(F.col("text")) if size is None else size
    code = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    rows = docs.withColumns({"_mix_size": size, "_mix_code": code, "_mix_range": F.substring(code, 1, RANGE_DIGITS)})
    small = materialize(rows.groupBy("source", "_mix_range").agg(F.sum("_mix_size").alias("n")))
    sources = targets(small.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most_epochs)
    earlier = Window.partitionBy("source").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = small.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    ranges = ranges.withColumnRenamed("source", "s")
    plan = sources.join(ranges, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("turn").alias("_mix_turn"), F.col("source").alias("_mix_source"), "source_size", "target",
        F.col("_mix_range").alias("_mix_r"), "ahead",
    )
    known = materialize(plan.select(*(F.col(c).alias(c if c[0] == "_" else f"_mix_{c}") for c in plan.columns)))
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    rows = rows.withColumn("_mix_name", name)
    known = known.withColumn("_mix_key", F.coalesce(F.concat(F.lit("s"), F.col("_mix_source")), F.lit("")))
    joined = rows.join(
        known, (F.col("_mix_name") == F.col("_mix_key")) & (F.col("_mix_range") == F.col("_mix_r"))
    )
    inside = (
        Window.partitionBy("_mix_name", "_mix_range").orderBy("_mix_code", "doc_id", "_mix_size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("_mix_ahead") + F.coalesce(F.sum("_mix_size").over(inside), F.lit(0))
    joined = joined.withColumn("_mix_before", before)
    goal = F.floor("_mix_target")
    whole = F.col("_mix_source_size")
    epochs = F.when(whole > 0, F.floor(goal / whole)).otherwise(0)
    # floor of a quotient of doubles, put right where rounding moved it
    epochs = epochs - F.when(epochs * whole > goal, 1).otherwise(0)
    joined = joined.withColumns({"_mix_epochs": epochs, "_mix_rest": goal - epochs * whole})
    taken = F.col("_mix_epochs") * F.col("_mix_size") + F.greatest(
        F.lit(0), F.least(F.col("_mix_size"), F.col("_mix_rest") - F.col("_mix_before"))
    )
    return joined.withColumn("_mix_taken", taken.cast("long"))


def _position(before: Column, schedules: Sequence[Sequence[float]]) -> Column:
    """The time at which the mix has taken ``before`` words of the source."""
    share = before / F.greatest(F.col("_mix_target"), F.lit(1.0))
    return reached(F.least(share, F.lit(1.0)), F.col("_mix_turn"), schedules)


def _without_own(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith("_mix_")))


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES,
    most_epochs: int = MOST_EPOCHS, size: Column | None = None,
) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, ``source``) with ``size, source_size, target, taken, position``.

    ``position`` is where the mix first takes the document (null: never). Rows come in its order.
    """
    placed = _placed(docs, weights, most_epochs, size).withColumns(
        {
            "size": F.col("_mix_size"), "source_size": F.col("_mix_source_size"), "target": F.col("_mix_target"),
            "taken": F.col("_mix_taken"), "position": F.when(F.col("_mix_taken") > 0, _position(F.col("_mix_before"), schedules)),
        }
    )
    return _without_own(placed).repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(
        F.col("position").asc_nulls_last(), "doc_id"
    )


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES,
    most_epochs: int = MOST_EPOCHS, size: Column | None = None,
) -> DataFrame:
    """The documents as the mix takes them, in its order: one row per time a document is taken, with its columns.

    Each time has a position of its own, after all words of the source's earlier epochs.
    """
    placed = _placed(docs, weights, most_epochs, size).where("_mix_taken > 0")
    times = F.ceil(F.col("_mix_taken") / F.col("_mix_size")).cast("int")
    rows = placed.withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    before = F.col("_mix_before") + F.col("_mix_epoch") * F.col("_mix_source_size")
    rows = rows.withColumn("_mix_position", _position(before, schedules))
    order = ["_mix_position", "doc_id", "_mix_epoch"]
    return _without_own(rows.repartitionByRange(*order).sortWithinPartitions(*order))
