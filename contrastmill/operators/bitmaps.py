"""Counting pairs of items by vertical bitmaps.

Rows are taken in blocks of ``2 ** BLOCK_BITS`` neighbours. A block has one bitmap for each item its
rows hold and one for each group, a bit for every row. A pair of items is counted by the ones in
``bitmap & bitmap``, a pair in a group by those that the group's bitmap has too. So a row never lists
its pairs, and what is counted is what was asked for.

An item in few rows of a block travels as their places instead of bits; the counts are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrastmill.operators.groups import GROUP, POPULATION

PAIR = ["lo", "hi"]
BLOCK_BITS = 15
#: A place in a block fits in so many bits, and travels as 16.
BLOCK_BITS_MOST = 16
#: Occurrences a task holds before it writes what it has as bitmaps.
HELD = 1 << 20
#: An item in fewer rows of a block than this share of the rows travels as places.
SPARSE = 1 / 32
#: Items from ``2 ** LIST_BITS`` numbers in a row make a list of partners.
LIST_BITS = 10
#: Blocks of a group that get its candidates from one copy of them.
SPREAD = 64

BITMAPS = f"{POPULATION} string, block long, item_id long, is_group boolean, {GROUP} string, places binary, bits binary"


def _segments(columns: list[np.ndarray], places: np.ndarray):
    """Sorted by ``columns`` and place, each place once: columns of each segment, its begin, places."""
    low = [int(c.min()) for c in columns]
    bits = [(int(c.max()) - l).bit_length() for c, l in zip(columns, low)]
    if sum(bits) + BLOCK_BITS_MOST < 63:
        # all of an occurrence in one number, which sorts by itself
        key = np.zeros(len(places), np.int64)
        for c, l, b in zip(columns, low, bits):
            key = (key << b) | (c - l)
        key = np.sort((key << BLOCK_BITS_MOST) | places)
        key = key[np.append(True, key[1:] != key[:-1])]
        places, key = key & ((1 << BLOCK_BITS_MOST) - 1), key >> BLOCK_BITS_MOST
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, found = key[begin], []
        for l, b in zip(reversed(low), reversed(bits)):
            found.append((key & ((1 << b) - 1)) + l)
            key = key >> b
        return found[::-1], begin, places
    order = np.lexsort((places, *reversed(columns)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    again = ~new
    again[1:] &= places[order][1:] == places[order][:-1]
    again[:1] = False
    order, new = order[~again], new[~again]
    begin = np.flatnonzero(new)
    return [c[order[begin]] for c in columns], begin, places[order]


def _packed(begin: np.ndarray, places: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """Places of sparse segments and bits of the others."""
    count = np.diff(np.append(begin, len(places)))
    sparse = count < rows * SPARSE
    owner = np.repeat(np.arange(len(begin)), count)
    width = -(-rows // 64) * 8
    few = sparse[owner]
    ends = np.cumsum(np.where(sparse, 2 * count, 0))
    data = places[few].astype("<u2").tobytes()
    listed = pa.Array.from_buffers(
        pa.binary(), len(begin), [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(data)]
    )
    dense = np.flatnonzero(~sparse)
    rank = np.cumsum(~sparse) - 1
    packed = np.zeros((len(dense), width), np.uint8)
    step = max(1, (1 << 23) // max(1, width * 8))
    for first in range(0, len(dense), step):
        some = dense[first : first + step]
        table = np.zeros((len(some), width * 8), np.uint8)
        inside = ~few & (owner >= some[0]) & (owner <= some[-1])
        table[rank[owner[inside]] - first, places[inside]] = 1
        packed[first : first + step] = np.packbits(table, axis=1, bitorder="little")
    ends = np.cumsum(np.where(sparse, 0, width))
    bits = pa.Array.from_buffers(
        pa.binary(), len(begin), [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())]
    )
    return listed, bits


def row_bitmaps(occurrences: DataFrame) -> DataFrame:
    """Bitmaps of the items and groups of each block, out of ``population, g, row, item_id``, or out
    of ``population, g, row, items`` with all numbers of a row in a list.

    Made in the stage that makes the occurrences; a block may have an item in several pieces.
    """
    block_bits, most = BLOCK_BITS, HELD
    last = "items" if "items" in occurrences.columns else "item_id"

    def encode(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        population = table.column(POPULATION).combine_chunks().dictionary_encode(null_encoding="encode")
        group = table.column(GROUP).combine_chunks().dictionary_encode(null_encoding="encode")
        row = table.column("row").to_numpy()
        block, place = row >> block_bits, row & ((1 << block_bits) - 1)
        item = table.column("item_id").to_numpy()
        p, g = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (population, group))
        rows = int(place.max()) + 1
        parts = []
        for is_group, own in ((False, item), (True, g)):
            (of, blocks, owners), begin, places = _segments([p, block, own], place)
            listed, bits = _packed(begin, places, rows)
            n = len(begin)
            parts.append(
                pa.RecordBatch.from_arrays(
                    [population.dictionary.take(pa.array(of)).cast(pa.string()), pa.array(blocks),
                     pa.nulls(n, pa.int64()) if is_group else pa.array(owners), pa.array(np.full(n, is_group)),
                     group.dictionary.take(pa.array(owners)).cast(pa.string()) if is_group else pa.nulls(n, pa.string()), listed, bits],
                    [POPULATION, "block", "item_id", "is_group", GROUP, "places", "bits"],
                )
            )
        return parts

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """One row an occurrence, some rows at a time."""
        if last == "item_id":
            yield batch
            return
        sizes = pc.fill_null(pc.list_value_length(batch.column("items")), 0).to_numpy(zero_copy_only=False)
        total, first = np.append(0, np.cumsum(sizes)), 0
        while first < batch.num_rows:
            end = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
            part = batch.slice(first, end - first)
            at = pa.array(np.repeat(np.arange(end - first), sizes[first:end]))
            own = [part.column(c).take(at) for c in (POPULATION, GROUP, "row")]
            yield pa.RecordBatch.from_arrays([*own, part.column("items").flatten()], [POPULATION, GROUP, "row", "item_id"])
            first = end

    def run(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for batch in (b for whole in batches for b in each(whole) if b.num_rows):
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield from encode(held)
                held, n = [], 0
        if n:
            yield from encode(held)

    return occurrences.select(POPULATION, GROUP, "row", last).mapInArrow(run, BITMAPS)


class Block:
    """The bitmaps of a block: those of groups and of frequent items as bits, others as places."""

    def __init__(self, table: pa.Table):
        is_group = table.column("is_group").to_numpy(zero_copy_only=False)
        places, bits = table.column("places").to_pylist(), table.column("bits").to_pylist()
        longest = max([len(b) for b in bits] + [2], default=2)
        for p in places:
            if p:
                longest = max(longest, int(np.frombuffer(p, "<u2").max()) // 8 + 1)
        self.words = -(-longest // 8)
        self.whole = np.full(self.words, ~np.uint64(0))
        items = table.column("item_id").to_pylist()
        groups = table.column(GROUP).to_pylist()
        self.group: dict[str | None, np.ndarray] = {}
        self.dense: dict[int, np.ndarray] = {}
        few: dict[int, list[np.ndarray]] = {}
        for i, g in enumerate(is_group.tolist()):
            if g or bits[i]:
                owner, key = (self.group, groups[i]) if g else (self.dense, items[i])
                own = owner.get(key)
                if own is None:
                    own = owner[key] = np.zeros(self.words, np.uint64)
                own |= self._bits(places[i], bits[i])
            else:
                few.setdefault(items[i], []).append(np.frombuffer(places[i], "<u2"))
        for key in few.keys() & self.dense.keys():
            for p in few.pop(key):
                self.dense[key] |= self._bits(p.tobytes(), b"")
        self.ids = np.array(sorted(self.dense), np.int64)
        self.matrix = np.array([self.dense[i] for i in self.ids.tolist()], np.uint64).reshape(-1, self.words)
        self.few = {k: np.unique(np.concatenate(v)) for k, v in few.items()}
        self.few_ids = np.array(sorted(self.few), np.int64)
        sizes = np.array([len(self.few[i]) for i in self.few_ids.tolist()], np.int64)
        self.few_begin = np.cumsum(sizes) - sizes
        self.few_size = sizes
        self.few_places = np.concatenate([self.few[i] for i in self.few_ids.tolist()] or [np.zeros(0, np.uint16)]).astype(np.int64)

    def _bits(self, places: bytes, bits: bytes) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        if bits:
            out[: len(bits)] = np.frombuffer(bits, np.uint8)
        else:
            table = np.zeros(self.words * 64, np.uint8)
            table[np.frombuffer(places, "<u2")] = 1
            out = np.packbits(table, bitorder="little")
        return out.view(np.uint64)

    def counts(self, lo: int, mask: np.ndarray, partners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Partners that occur together with ``lo`` under the mask, and in how many rows."""
        own = self.dense.get(lo)
        if own is None:
            if lo not in self.few:
                return partners[:0], partners[:0]
            own = self._bits(self.few[lo].astype("<u2").tobytes(), b"")
        own = own & mask
        words = np.flatnonzero(own)
        if not len(words):
            return partners[:0], partners[:0]
        found, n = [], []
        at = np.searchsorted(self.ids, partners)
        here = at < len(self.ids)
        here[here] = self.ids[at[here]] == partners[here]
        step = max(1, (1 << 20) // len(words))
        dense = at[here]
        for first in range(0, len(dense), step):
            some = self.matrix[dense[first : first + step]]
            some = some if len(words) == self.words else some[:, words]
            n.append(np.bitwise_count(some & own[words]).sum(axis=1, dtype=np.int64))
        found.append(partners[here])
        if len(self.few_ids):
            at = np.searchsorted(self.few_ids, partners)
            here = at < len(self.few_ids)
            here[here] = self.few_ids[at[here]] == partners[here]
            at = at[here]
            size = self.few_size[at]
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            places = self.few_places[np.repeat(self.few_begin[at], size) + step]
            hit = (own[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
            n.append(np.bincount(np.repeat(np.arange(len(at)), size), hit, len(at)).astype(np.int64))
            found.append(partners[here])
        partner, count = np.concatenate(found), np.concatenate(n) if n else np.zeros(0, np.int64)
        return partner[count > 0], count[count > 0]


def _count_block(overlapping: bool):
    def run(bitmaps: pa.Table, tasks: pa.Table) -> pa.Table:
        out: dict[str, list] = {GROUP: [], "reference": [], "lo": [], "hi": [], "n": []}
        if len(bitmaps) and len(tasks):
            block = Block(bitmaps)
            lists: dict[tuple, list[np.ndarray]] = {}
            partners = tasks.column("partners").combine_chunks()
            flat, ends = partners.flatten().to_numpy(), partners.offsets.to_numpy()
            for i, key in enumerate(zip(*(tasks.column(c).to_pylist() for c in ("of", "reference", "lo")))):
                lists.setdefault(key, []).append(flat[ends[i] - ends[0] : ends[i + 1] - ends[0]])
            nothing = np.zeros(block.words, np.uint64)
            for (g, reference, lo), own in lists.items():
                mask = block.whole if reference and not overlapping else block.group.get(None if reference else g, nothing)
                hi, n = block.counts(lo, mask, np.concatenate(own))
                out[GROUP].append(pa.array([g] * len(hi), pa.string()))
                out["reference"].append(pa.array([reference] * len(hi), pa.bool_()))
                out["lo"].append(pa.array(np.full(len(hi), lo)))
                out["hi"].append(pa.array(hi))
                out["n"].append(pa.array(n))
        types = {GROUP: pa.string(), "reference": pa.bool_(), "lo": pa.int64(), "hi": pa.int64(), "n": pa.int64()}
        columns = {c: pa.concat_arrays(v) if v else pa.array([], types[c]) for c, v in out.items()}
        population = bitmaps.column(POPULATION)[0] if len(bitmaps) else None
        return pa.table({POPULATION: pa.array([population.as_py() if population else None] * len(columns["n"]), pa.string()), **columns})

    return run


def count_pairs(bitmaps: DataFrame, candidates: DataFrame, overlapping: bool = False) -> DataFrame:
    """``population, g, reference, lo, hi, n`` of the pairs that occur, out of the written bitmaps.

    ``candidates`` are ``population, g, lo, hi``. Each is counted in its group and, with a null
    ``g`` and ``reference`` true, in the reference: all rows, or with overlapping groups those
    without one. To a block go the candidates of the groups it has, and for the reference those of
    the items it has.
    """

    def listed(rows: DataFrame, *keys: str) -> DataFrame:
        part = F.shiftright("hi", LIST_BITS).alias("part")
        lists = rows.groupBy(*keys, "lo", part).agg(F.collect_list("hi").alias("partners"))
        return lists.drop("part")

    here = bitmaps.where("is_group").select(POPULATION, GROUP, "block").where(F.col(GROUP).isNotNull()).distinct()
    copies = here.groupBy(POPULATION, GROUP).agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("copies"))
    spread = here.join(copies, [POPULATION, GROUP]).withColumn("copy", F.pmod(F.xxhash64("block"), F.col("copies")).cast("int"))
    own = listed(candidates, POPULATION, GROUP).join(copies, [POPULATION, GROUP])
    own = own.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    in_groups = spread.drop("copies").join(own, [POPULATION, GROUP, "copy"]).select(
        POPULATION, "block", GROUP, F.lit(False).alias("reference"), "lo", "partners"
    )
    wanted = listed(candidates.select(POPULATION, *PAIR).distinct(), POPULATION)
    items = bitmaps.where(~F.col("is_group")).select(POPULATION, F.col("item_id").alias("lo"), "block").distinct()
    in_reference = items.join(wanted, [POPULATION, "lo"]).select(
        POPULATION, "block", F.lit(None).cast("string").alias(GROUP), F.lit(True).alias("reference"), "lo", "partners"
    )
    tasks = in_groups.unionByName(in_reference).select(
        F.col(POPULATION).alias("of_population"), F.col("block").alias("of_block"), F.col(GROUP).alias("of"), "reference", "lo", "partners"
    )
    held = bitmaps.groupBy(POPULATION, "block")
    counted = held.cogroup(tasks.groupBy("of_population", "of_block")).applyInArrow(
        _count_block(overlapping), f"{POPULATION} string, {GROUP} string, reference boolean, lo long, hi long, n long"
    )
    return counted.groupBy(POPULATION, GROUP, "reference", *PAIR).agg(F.sum("n").alias("n"))
