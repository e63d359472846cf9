"""Pairs of items: candidates and their counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrastmill.operators import row_items
from contrastmill.operators.bitmaps import PAIR, count_pairs, row_bitmaps
from contrastmill.operators.groups import GROUP, POPULATION
from contrastmill.operators.items import ITEM, Layout, batch_slots, in_batches, item_array
from contrastmill.operators.numbering import with_row_number
from contrastmill.runtime import materialize

# Item fields a pair carries for each of its two members.
MEMBER_FIELDS = ("key", "value", "vtype", "family", "name", "kid", "count_group", "count_reference")


#: Different items, and bytes of them, that are sent to every task; more are joined to the rows.
SENT_ITEMS, SENT_BYTES = 1 << 17, 1 << 24


def pair_constraint(candidates: DataFrame, restricted: Mapping[int, Sequence[str]]) -> DataFrame:
    """Items of a restricted slot pair only with the keys named for it, in either position."""
    for kid, keys in restricted.items():
        allowed = [k for k in keys]
        for this, other in (("lo", "hi"), ("hi", "lo")):
            fits = F.col(f"{other}_key").isin(allowed) & F.col(f"{other}_family").isNull()
            candidates = candidates.where((F.col(f"{this}_kid") != kid) | fits)
    return candidates


def pair_candidates(items: DataFrame, restricted: Mapping[int, Sequence[str]] | None = None) -> DataFrame:
    """Pairs of surviving items of one group with different keys.

    Free items pair among themselves, a group has at most a few per key. Items of a restricted
    slot, which may be many, are joined by key to the free ones they are named for, and never to
    each other.
    """
    restricted = restricted or {}

    def side(rows: DataFrame, name: str, totals: bool = False) -> DataFrame:
        fields = [F.col(f).alias(f"{name}_{f}") for f in MEMBER_FIELDS]
        more = ["total_group", "total_reference"] if totals else []
        return rows.select(POPULATION, GROUP, F.col("item_id").alias(name), *fields, *more)

    free = items.where(~F.col("kid").isin(list(restricted))) if restricted else items
    different = F.col("lo_key") != F.col("hi_key")
    both = side(free, "lo", True).join(side(free, "hi"), [POPULATION, GROUP])
    pairs = both.where((F.col("lo") < F.col("hi")) & different)
    plain = free.where(F.col("family").isNull())
    for kid, keys in restricted.items():
        held, partner = items.where(F.col("kid") == kid), plain.where(F.col("key").isin(list(keys)))
        for lo, hi in ((held, partner), (partner, held)):
            met = side(lo, "lo", True).join(side(hi, "hi"), [POPULATION, GROUP])
            pairs = pairs.unionByName(met.where((F.col("lo") < F.col("hi")) & different))
    return pairs


def _sent_items(layout: Layout, known: DataFrame) -> pa.Table | None:
    """``kid, text, item_id`` of the items as ``row_items`` finds them, nothing if they are too many."""
    entries = [s.kid for s in layout.slots if s.kind == "entries"]
    scalars = [s.kid for s in layout.slots if s.kind == "scalar"]
    both = F.concat("name", F.lit(":"), "value")
    text = F.when(F.col("kid").isin(entries), both).when(F.col("kid").isin(scalars), F.col("value")).otherwise(F.col("name"))
    texts = known.select("kid", text.alias("text"), "item_id")
    many, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return texts.toArrow() if many <= SENT_ITEMS and size <= SENT_BYTES else None


def occurrences(tagged: DataFrame, layout: Layout, items: DataFrame) -> DataFrame:
    """``population, g, row, items``: the numbers of the surviving items of every row, as a list, or
    ``population, g, row, item_id`` with each in a row of its own.

    Only slots with a survivor are read. Items out of lists find their numbers in Arrow batches,
    before rows are numbered, and stay lists. Where they are too many to be sent to every task, and
    for scalars alone, an item finds its number by a hash of what it is, and what it is is compared too.
    """
    kids = {r["kid"] for r in items.select("kid").distinct().collect()}  # at most one for each column
    layout = Layout(tuple(s for s in layout.slots if s.kid in kids), layout.families)
    if not layout.slots:
        empty = items.where("false")
        return empty.select(POPULATION, GROUP, F.col("item_id").alias("row"), "item_id")
    known = items.select(*ITEM, "item_id").distinct()
    sent = _sent_items(layout, known) if in_batches(layout) else None
    if sent is not None:
        read, slots = batch_slots(tagged, layout)
        found = read.mapInArrow(row_items.find_batches(slots, sent), row_items.with_owner(tagged.schema, "items array<long>"))
        return with_row_number(found.where(F.size("items") > 0), "row")
    rows = with_row_number(tagged.select(POPULATION, GROUP, item_array(layout).alias("items")), "row")
    each = rows.select(POPULATION, GROUP, "row", F.inline("items")).withColumn("hash", F.xxhash64(*ITEM))
    known = known.select("item_id", F.xxhash64(*ITEM).alias("hash"), *[F.col(c).alias(f"__{c}") for c in ITEM])
    same: list[Column] = [each["hash"] == known["hash"]]
    same += [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ITEM]
    return each.join(known, same).select(POPULATION, GROUP, "row", "item_id")


def pair_counts(
    tagged: DataFrame, layout: Layout, items: DataFrame, candidates: DataFrame, overlapping: bool = False
) -> DataFrame:
    """Rows that have both items of a candidate pair, per group and in the reference.

    ``items`` and ``candidates`` should be written tables. Rows become bitmaps of items in the
    stage of the scan, and only candidates are ever counted (``operators.bitmaps``).
    """
    bitmaps = materialize(row_bitmaps(occurrences(tagged, layout, items)))
    counts = materialize(count_pairs(bitmaps, candidates.select(POPULATION, GROUP, *PAIR), overlapping))
    own = counts.where(~F.col("reference")).select(POPULATION, GROUP, *PAIR, F.col("n").alias("count_group"))
    total = counts.where("reference").select(POPULATION, *PAIR, F.col("n").alias("count_reference"))
    found = own.join(total, [POPULATION, *PAIR], "left").withColumn("count_reference", F.coalesce("count_reference", F.lit(0)))
    return found.join(candidates, [POPULATION, GROUP, *PAIR])
