"""Items: one (key, value) of one row, and how often each occurs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrastmill.operators import row_items
from contrastmill.operators.features import (
    VERSION_SUFFIX,
    Family,
    entry_names,
    entry_versions,
    member_column,
    record_column,
    version_column,
)
from contrastmill.operators.groups import GROUP, POPULATION, col, with_reference_count
from contrastmill.operators.numbering import rank_within
from contrastmill.runtime import materialize

ITEM = ["kid", "name", "value"]


def value_type(data_type: T.DataType, column: str) -> str:
    """The tag that keeps values of different types apart once all are text."""
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "str"
    if isinstance(data_type, T.NumericType):
        return "num"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    raise TypeError(
        f"column {column!r} of type {data_type.simpleString()} cannot be a feature: "
        "drop it or turn it into a family"
    )


@dataclass(frozen=True)
class Slot:
    """A column items come from. ``kid`` numbers it; ``key`` is null where the item names itself."""

    kid: int
    kind: str  # scalar, members, versions, or out of lists as they are: listed, entries, entry-names
    column: str
    vtype: str
    family: str | None = None
    key: str | None = None
    record: str | None = None  # rows that agree in this column count an item once


@dataclass(frozen=True)
class Layout:
    """Numbered item sources of a feature table, restricted families last."""

    slots: tuple[Slot, ...]
    families: tuple[Family, ...]

    @staticmethod
    def of(df: DataFrame, families: Sequence[Family] = (), ignore: Sequence[str] = ()) -> Layout:
        skip = {POPULATION, GROUP, *ignore}
        owner: dict[str, str] = {}
        for family in families:
            for member in family.known or ():
                owner[member] = family.name
                owner[member + VERSION_SUFFIX] = family.version_name
        found = [f for f in families if f.known is None]
        slots: list[tuple] = []
        for f in df.schema.fields:
            if f.name not in skip and not f.name.startswith("@"):
                slots.append(("scalar", f.name, value_type(f.dataType, f.name), owner.get(f.name), f.name))
        for family in sorted(found, key=lambda f: f.partners is not None):
            version = version_column(family)
            if family.entries is not None and df.schema[version].dataType == T.ArrayType(T.StringType()):
                slots.append(("entries", version, "str", family.version_name, None))
                slots.append(("entry-names", version, "bool", family.name, None))
                continue
            if family.versions is not None:
                slots.append(("versions", version, "str", family.version_name, None))
            record = record_column(family)
            record = record if record in df.columns else None
            kind = "listed" if record is None and family.listed is not None else "members"
            slots.append((kind, member_column(family), "bool", family.name, None, record))
        return Layout(tuple(Slot(i + 1, *s) for i, s in enumerate(slots)), tuple(families))

    @property
    def discovered(self) -> tuple[Family, ...]:
        return tuple(f for f in self.families if f.known is None)

    @property
    def restricted(self) -> dict[int, tuple[str, ...]]:
        """Slots whose items pair with few keys only, with those keys."""
        partners = {f.name: f.partners for f in self.families if f.partners is not None}
        return {s.kid: partners[s.family] for s in self.slots if s.family in partners}


def _item(kid: int, name: Column, value: Column) -> Column:
    return F.struct(F.lit(kid).alias("kid"), name.alias("name"), value.alias("value"))


def _member_item(kid: int):
    return lambda member: _item(kid, member, F.lit("true"))


def _version_item(kid: int):
    return lambda version: _item(kid, version["name"], version["value"])


def item_array(layout: Layout) -> Column:
    """All items of a row as one array."""
    no_name = F.lit(None).cast("string")
    plain = [_item(s.kid, no_name, col(s.column).cast("string")) for s in layout.slots if s.kind == "scalar"]
    parts = [F.array(*plain)] if plain else []
    for s in layout.slots:
        if s.kind == "members":
            parts.append(F.transform(col(s.column), _member_item(s.kid)))
        elif s.kind == "versions":
            parts.append(F.transform(col(s.column), _version_item(s.kid)))
        elif s.kind == "entries":
            parts.append(F.transform(entry_versions(col(s.column)), _version_item(s.kid)))
        elif s.kind == "listed":
            parts.append(F.transform(F.array_distinct(F.array_compact(col(s.column))), _member_item(s.kid)))
        elif s.kind == "entry-names":
            parts.append(F.transform(entry_names(col(s.column)), _member_item(s.kid)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def item_rows(tagged: DataFrame, layout: Layout) -> DataFrame:
    """One row per item; feeds an aggregate in the same stage, so it is never shuffled as such."""
    return tagged.select(POPULATION, GROUP, F.inline(item_array(layout)))


def batch_slots(tagged: DataFrame, layout: Layout) -> tuple[DataFrame, list[tuple[int, str, str]]]:
    """Columns of the slots, scalars as text, and where each slot is, for ``row_items``."""
    kinds = {s.column: s.kind for s in layout.slots}
    names = {c: f"c{i}" for i, c in enumerate(kinds)}
    read = [(col(c).cast("string") if kind == "scalar" else col(c)).alias(names[c]) for c, kind in kinds.items()]
    return tagged.select(POPULATION, GROUP, *read), [(s.kid, s.kind, names[s.column]) for s in layout.slots]


def in_batches(layout: Layout) -> bool:
    """Are there lists whose items are better made in Arrow batches than by expressions."""
    kinds = {s.kind for s in layout.slots}
    return kinds.issubset(row_items.KINDS) and kinds != {"scalar"}


def _row_counts(tagged: DataFrame, layout: Layout) -> DataFrame:
    """``population, g, kid, name, value, count_group``, each row by itself."""
    if in_batches(layout):
        return row_items.counted(*batch_slots(tagged, layout))
    return _counted(item_rows(tagged, layout))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy(POPULATION, *ITEM, GROUP).agg(F.count(F.lit(1)).alias("count_group"))


def _record_rows(tagged: DataFrame, slots: Sequence[Slot], record: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the members of ``slots`` that count as they are, and those to be told apart by record.

    Equal rows of a record become one. A record that is then a single row counts as that row does, as
    do rows without an id; only records that have different rows are left to the second table.
    """
    owner = [POPULATION, GROUP, "record"]
    rows = tagged.select(POPULATION, GROUP, col(record).alias("record"), *[col(s.column).alias(f"m{s.kid}") for s in slots])
    known = materialize(rows.where(F.col("record").isNotNull()).distinct())
    several = known.groupBy(*owner).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
    several = materialize(several.select(*[F.col(c).alias(f"__{c}") for c in owner]))
    same = [F.col("record") == F.col("__record"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (POPULATION, GROUP)]]
    alone = known.join(several, same, "left_anti")
    return alone.unionByName(rows.where(F.col("record").isNull())), known.join(several, same, "left_semi")


def _record_items(tagged: DataFrame, slots: Sequence[Slot], record: str) -> DataFrame:
    """Items of ``slots``, once a record."""

    def listed(rows: DataFrame) -> DataFrame:
        if len(slots) == 1:
            kid = slots[0].kid
            item = [F.lit(kid).alias("kid"), F.explode(f"m{kid}").alias("name"), F.lit("true").alias("value")]
            return rows.select(POPULATION, GROUP, "record", *item)
        each = F.concat(*[F.transform(f"m{s.kid}", _member_item(s.kid)) for s in slots])
        return rows.select(POPULATION, GROUP, "record", F.inline(each))

    alone, told = map(listed, _record_rows(tagged, slots, record))
    return alone.drop("record").unionByName(told.distinct().drop("record"))


def item_counts(
    tagged: DataFrame,
    layout: Layout,
    overlapping: bool = False,
    many_groups: bool = False,
    least: DataFrame | None = None,
) -> DataFrame:
    """Occurrences of every item, null values included, per group and in the reference.

    Scalars and all families are counted in the same scan, in tasks before the shuffle, so what
    crosses it is one count per task or batch, item and group, however often it occurs. Slots
    with a record id have scans of their own and count a record once; rows without an id count each.
    ``least`` leaves out items that reach it in no group (``groups.with_reference_count``).
    """
    records = {s.record: [x for x in layout.slots if x.record == s.record] for s in layout.slots if s.record is not None}
    plain = Layout(tuple(s for s in layout.slots if s.record is None), layout.families)
    parts = [_row_counts(tagged, plain)] if plain.slots or not records else []
    if records:
        # slots have their own numbers, so what is counted in one part is in no other
        parts.append(_counted(reduce(DataFrame.unionByName, [_record_items(tagged, s, r) for r, s in records.items()])))
    counts = reduce(DataFrame.unionByName, parts)
    return describe_items(with_reference_count(counts, [POPULATION, *ITEM], overlapping, many_groups, least), layout)


def describe_items(counts: DataFrame, layout: Layout) -> DataFrame:
    """Attach key, type and family to items known by the number of their slot."""

    def by_slot(attribute: str) -> Column:
        values = F.array(*[F.lit(getattr(s, attribute)).cast("string") for s in layout.slots])
        return F.get(values, F.col("kid") - 1)

    versions = [s.kid for s in layout.slots if s.kind in ("versions", "entries")]
    named = F.col("name")
    if versions:
        named = F.when(F.col("kid").isin(versions), F.concat(named, F.lit(VERSION_SUFFIX))).otherwise(named)
    return counts.withColumns(
        {
            "key": F.coalesce(by_slot("key"), named),
            "vtype": F.when(F.col("value").isNull(), "null").otherwise(by_slot("vtype")),
            "family": by_slot("family"),
        }
    )


def min_count_filter(counts: DataFrame, min_count: int = 5, columns: Sequence[str] = ("count_group", "count_reference")) -> DataFrame:
    """Keep counts of at least ``min_count``, each side on its own."""
    for c in columns:
        counts = counts.where(F.col(c) >= min_count)
    return counts


def zero_fill(reference: DataFrame, groups: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Counts of both sides next to each other; a side that did not count an item has zero.

    ``reference`` holds ``keys, count_reference``; ``groups`` holds ``keys, g, count_group``.
    Every item of the reference gets a row for each group in ``names``.
    """
    slots = reference.withColumn(GROUP, F.explode(F.array(*[F.lit(n) for n in names])))
    both = slots.alias("r").join(
        groups.alias("c"),
        [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, GROUP)],
        "full",
    )
    return both.select(
        *[F.coalesce(f"r.{k}", f"c.{k}").alias(k) for k in (*keys, GROUP)],
        F.coalesce("count_group", F.lit(0)).alias("count_group"),
        F.coalesce("count_reference", F.lit(0)).alias("count_reference"),
    )


def sparse_zero_fill(
    reference: DataFrame, groups: DataFrame, keys: Sequence[str], totals: DataFrame, min_support: float
) -> DataFrame:
    """Counts of both sides next to each other, with zeros only where one side can pass.

    ``totals`` is ``g, total_group, total_reference``. An item that a group does not count gets a
    zero there only if its support in the reference reaches ``min_support``; all that a group counts
    stays. So the rows are those counted and, for each group, the few items that are frequent in the
    reference, instead of every item for every group.
    """
    sizes = totals.select(GROUP, "total_reference").distinct()
    least = sizes.agg(F.min(F.col("total_reference") * min_support).alias("least"))
    frequent = reference.join(least, F.col("count_reference") >= F.col("least"), "left_semi")
    needed = F.col("count_reference") >= F.col("total_reference") * min_support
    zeros = frequent.join(sizes, needed).select(*keys, GROUP, F.lit(0).cast("bigint").alias("count_group"))
    own = groups.select(*keys, GROUP, "count_group").unionByName(zeros)
    own = own.groupBy(*keys, GROUP).agg(F.sum("count_group").alias("count_group"))
    r = reference.select("count_reference", *[F.col(k).alias(f"__{k}") for k in keys])
    filled = own.join(r, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    return filled.select(*keys, GROUP, "count_group", F.coalesce("count_reference", F.lit(0)).alias("count_reference"))


def grouped_support(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Join the totals and divide."""
    return counts.join(totals, [POPULATION, GROUP]).withColumns(
        {
            "support_group": F.col("count_group") / F.col("total_group"),
            "support_reference": F.col("count_reference") / F.col("total_reference"),
        }
    )


def with_item_ids(items: DataFrame) -> DataFrame:
    """Number the surviving items: slot in the upper half, rank within the slot in the lower."""
    items = materialize(items)
    ranked = rank_within(items.select(*ITEM).distinct(), ["kid"], ["name", "value"], "__rank")
    item_id = F.shiftleft(F.col("kid").cast("bigint"), 32) + F.col("__rank")
    ids = ranked.select(*[F.col(c).alias(f"__{c}") for c in ITEM], item_id.alias("item_id"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ITEM]
    return items.join(ids, same).drop(*[f"__{c}" for c in ITEM])


def slot_of(item_id: Column) -> Column:
    return F.shiftright(item_id, 32).cast("int")
