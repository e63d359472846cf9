"""Items of rows, made in Arrow batches out of the lists the rows hold.

All words of a column of a batch are numbered at once, and what is done for a word is done once for
each different one: a row has numbers only. Items of a batch are counted per group before they leave
the task, or, where the items asked for are known, each row leaves with their numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrastmill.operators.groups import GROUP, POPULATION

#: Buckets that counts are dealt to, and rows of lists, one for a bucket, that leave a task at once.
BUCKET_BITS, SENT = 11, 512
#: List elements whose items are made at once.
WORDS = 1 << 21
#: Counts that are merged at once, in whole buckets.
MERGED = 1 << 18
#: Bytes of a string that its bucket depends on, besides its end and length.
HASHED = 64
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], np.uint64)
#: What a slot may hold to be read here: a value, members, members that may repeat or be null, or
#: entries ``name:value`` of which the first of a name counts, as a version (``entries``) or as a
#: member (``entry-names``).
KINDS = ("scalar", "members", "listed", "entries", "entry-names")
LISTS = ["bucket", "kid", "many", "populations", "groups", "owner", "n", "size", "text"]


@dataclass(frozen=True)
class Piece:
    """Items of a slot in a batch: the row and item of each occurrence, and what the items are.

    ``text`` tells the items of the slot apart: the value, the name, or ``name:value``.
    """

    kid: int
    row: np.ndarray
    code: np.ndarray
    text: pa.Array


def _numbered(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each value, and the different values, null among them."""
    encoded = pc.dictionary_encode(column, null_encoding="encode")
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


def _listed(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element, and the elements; a null list has none."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column), dtype=np.int32), size), column.flatten()


def _first_of_each(row: np.ndarray, name: np.ndarray, many: int) -> np.ndarray:
    """Places of the first occurrence of every name in every row."""
    if not len(row):
        return np.zeros(0, np.int64)
    bits = len(row).bit_length()
    if (int(row[-1]) + 1) * many < 1 << (62 - bits):
        # one number for row, name and place sorts much faster than places by a key
        key = row.astype(np.int64)
        key *= many
        key += name
        key <<= bits
        key |= np.arange(len(row))
        key.sort()
        place = (key & ((1 << bits) - 1)).astype(np.int32 if bits < 32 else np.int64)
        key >>= bits
        return place[np.append(True, key[1:] != key[:-1])]
    order = np.lexsort((np.arange(len(row)), name, row))
    new = np.append(True, (np.diff(row[order]) != 0) | (np.diff(name[order]) != 0))
    return order[new]


def _entry_items(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """First entries of every name of a row: row, entry and name as numbers; the entries and names."""
    row, listed = _listed(column)
    code, entries = _numbered(listed)
    parts = pc.split_pattern(entries, ":", max_splits=1)
    parsable = pc.fill_null(pc.equal(pc.list_value_length(parts), 2), False)
    kept = parsable.to_numpy(zero_copy_only=False)
    entries, both = entries.filter(parsable), parts.filter(parsable).flatten()
    names = both.take(pa.array(np.arange(0, len(both), 2)))
    here = kept[code] if len(code) else np.zeros(0, bool)
    row, code = row[here], (np.cumsum(kept, dtype=np.int32) - np.int32(1))[code[here]] if len(code) else code
    name_of, different = _numbered(names)
    name = name_of[code]
    first = _first_of_each(row, name, len(different))
    return row[first], code[first], name[first], entries, different


def pieces(batch: pa.RecordBatch, slots: Sequence[tuple[int, str, str]]) -> Iterator[Piece]:
    """The items of all rows, slot by slot; ``slots`` are ``kid, kind, column``."""
    parsed: dict[str, tuple] = {}
    for kid, kind, name in slots:
        column = batch.column(name)
        if kind == "scalar":
            code, values = _numbered(column)
            yield Piece(kid, np.arange(len(column)), code, values)
            continue
        if kind in ("members", "listed"):
            row, listed = _listed(column)
            code, names = _numbered(listed)
            if kind == "listed":
                first = _first_of_each(row, code, len(names))
                first = first[names.is_valid().to_numpy(zero_copy_only=False)[code[first]]]
                row, code = row[first], code[first]
            yield Piece(kid, row, code, names)
            continue
        if name not in parsed:
            parsed[name] = _entry_items(column)
        row, code, member, entries, names = parsed[name]
        yield Piece(kid, row, code, entries) if kind == "entries" else Piece(kid, row, member, names)


def some_rows(batches: Iterator[pa.RecordBatch], slots: Sequence[tuple[int, str, str]]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``WORDS`` list elements, which bounds the work space of a task."""
    lists = sorted({name for _, kind, name in slots if kind != "scalar"})
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for name in lists:
            sizes += pc.fill_null(pc.list_value_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        total, first = np.append(0, np.cumsum(sizes)), 0
        while first < batch.num_rows:
            end = max(first + 1, int(np.searchsorted(total, total[first] + WORDS, "right")) - 1)
            yield batch.slice(first, end - first)
            first = end


def _owners(batch: pa.RecordBatch) -> tuple[np.ndarray, int, Callable[[np.ndarray], list[pa.Array]]]:
    """The number of each row's population and group, how many there may be, and what they are."""
    p, populations = _numbered(batch.column(POPULATION))
    g, groups = _numbered(batch.column(GROUP))
    n = len(groups)
    return p.astype(np.int64) * n + g, len(populations) * n, lambda at: [populations.take(pa.array(at // n)), groups.take(pa.array(at % n))]


def _hashes(column: pa.Array) -> np.ndarray:
    """A number for each string, the same in every task; a null counts as empty."""
    column = pc.fill_null(column.cast(pa.string()).cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = np.concatenate([raw[at[0] : at[-1]], np.zeros(8, np.uint8)])
    begin, size = at[:-1] - at[0], np.diff(at)
    eights = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h = size.astype(np.uint64) * ODD[0]
    for step in range(0, HASHED, 8):
        here = np.flatnonzero(size > step)
        if not len(here):
            return h
        rest = np.minimum(size[here] - step, 8).astype(np.uint64)
        part = eights[begin[here] + step] & (~np.uint64(0) >> (np.uint64(64) - rest * np.uint64(8)))
        mixed = (h[here] ^ part) * ODD[1]
        h[here] = mixed ^ (mixed >> np.uint64(32))
    long = np.flatnonzero(size > HASHED)
    h[long] = (h[long] ^ eights[begin[long] + size[long] - 8]) * ODD[1]
    return h


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def _blobs(ends: np.ndarray, data: bytes | np.ndarray) -> pa.Array:
    """``data`` cut at ``ends`` into one binary value each."""
    at = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)])


def _narrow(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers from 0 up, in as many bytes as the largest of all needs, cut at ``ends``."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return _blobs(ends * kind.itemsize, values.astype(kind).tobytes())


def _wide(blobs: list[bytes], many: list[int]) -> np.ndarray:
    """The numbers of all ``_narrow`` values, of which each holds so ``many``."""
    parts = [np.frombuffer(b, f"<u{len(b) // n}").astype(np.int64) for b, n in zip(blobs, many) if n]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, and the size of each plus one, zero for null."""
    binary = pc.fill_null(texts.cast(pa.string()).cast(pa.large_binary()), b"")
    _, offsets, data = binary.buffers()
    at = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(at) + 1, 0)


def _texts(sizes: np.ndarray, raw: bytes) -> pa.Array:
    """The strings again."""
    at = np.append(0, np.cumsum(np.maximum(sizes - 1, 0)))
    valid = pa.py_buffer(np.packbits(sizes > 0, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [valid, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw)])


def count_batches(slots: Sequence[tuple[int, str, str]]):
    """How often a batch has each item in each group, a row of lists for each slot and bucket of items.

    An item has the same bucket in every batch. ``owner`` is a place in the row's own lists of
    populations and groups; it, the counts, and sizes and bytes of the strings are one value each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, slots):
            owner, owners, described = _owners(batch)
            population, group = described(np.arange(owners))
            owner_hash = _hashes(population) * ODD[2] + _hashes(group)
            for piece in pieces(batch, slots):
                key = piece.code.astype(np.int64)
                key *= owners
                key += owner[piece.row]
                if len(piece.text) * owners <= 4 * len(key):
                    n = np.bincount(key, minlength=1)
                    at = np.flatnonzero(n)
                    n = n[at]
                else:
                    at, n = np.unique(key, return_counts=True)
                del key
                if not len(at):
                    continue
                item, own = at // owners, at % owners
                h = ((_hashes(piece.text)[item] ^ owner_hash[own]) + np.uint64(piece.kid)) * ODD[2]
                bucket = ((h ^ (h >> np.uint64(29))) * ODD[1]) >> np.uint64(64 - BUCKET_BITS)
                order = np.argsort(bucket.astype(np.uint16), kind="stable")
                bucket, own, item = bucket[order].astype(np.int64), own[order], item[order]
                begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                sizes = np.diff(np.append(begin, len(bucket)))
                line = np.repeat(np.arange(len(begin)), sizes)
                # the groups of each bucket, and which of them an item has
                there, place = np.unique(line * owners + own, return_inverse=True)
                first = np.searchsorted(there, np.arange(len(begin)) * owners)
                populations, groups = described(there % owners)
                many = np.diff(np.append(first, len(there)))
                ends = np.append(begin[1:], len(bucket))
                raw, size = _text_bytes(piece.text.take(pa.array(item)))
                bytes_to = np.append(0, np.cumsum(np.maximum(size - 1, 0)))[ends]
                table = pa.RecordBatch.from_arrays(
                    [pa.array(bucket[begin].astype(np.int32)), pa.array(np.full(len(begin), piece.kid, np.int32)),
                     pa.array(sizes.astype(np.int32)), _lists(many, populations), _lists(many, groups),
                     _narrow(place - first[line], ends), _narrow(n[order], ends), _narrow(size, ends), _blobs(bytes_to, raw.tobytes())],
                    LISTS,
                )
                for start in range(0, len(begin), SENT):
                    yield table.slice(start, SENT)

    return run


def _merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The sum of the counts of each item in each group, of whole buckets."""
    table = pa.Table.from_batches(held).combine_chunks()
    columns = {c: table.column(c).combine_chunks() for c in ("populations", "groups")}
    of = pc.list_value_length(columns["populations"]).to_numpy(zero_copy_only=False)
    sizes = table.column("many").to_numpy()
    whole = {c: table.column(c).to_pylist() for c in ("owner", "n", "size", "text")}
    numbers = {c: _wide(whole[c], sizes.tolist()) for c in ("owner", "n", "size")}
    p, populations = _numbered(columns["populations"].flatten())
    g, groups = _numbered(columns["groups"].flatten())
    n = len(groups)
    owner = (p.astype(np.int64) * n + g)[np.repeat(np.cumsum(of) - of, sizes) + numbers["owner"]]
    owners = len(populations) * n
    kid = np.repeat(table.column("kid").to_numpy(), sizes)
    slots = int(kid.max()) + 1
    text, texts = _numbered(_texts(numbers["size"], b"".join(whole["text"])))
    texts = texts.cast(pa.string())
    key = (text.astype(np.int64) * slots + kid) * owners + owner
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count, key = np.add.reduceat(numbers["n"][order], begin), key[begin]
    own, item = key % owners, key // owners
    return pa.RecordBatch.from_arrays(
        [populations.take(pa.array(own // n)), groups.take(pa.array(own % n)), pa.array((item % slots).astype(np.int32)),
         texts.take(pa.array(item // slots)), pa.array(count)],
        [POPULATION, GROUP, "kid", "text", "n"],
    )


def merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``population, g, kid, text, n`` out of the lists of ``count_batches``, sorted by bucket.

    Buckets are merged some at a time, but a bucket is never cut.
    """

    def sent() -> Iterator[pa.RecordBatch]:
        merged = _merged(held)
        for start in range(0, merged.num_rows, 1 << 16):
            yield merged.slice(start, 1 << 16)

    held: list[pa.RecordBatch] = []
    many, last = 0, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column("bucket").to_numpy()
        total = np.append(0, np.cumsum(batch.column("many").to_numpy(), dtype=np.int64))
        edges = np.append(0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1)
        begin = 0
        for edge in edges.tolist():
            if bucket[edge] != last and many + total[edge] - total[begin] >= MERGED:
                held.append(batch.slice(begin, edge - begin))
                yield from sent()
                held, many, begin = [], 0, edge
            last = int(bucket[edge])
        held.append(batch.slice(begin))
        many += int(total[-1] - total[begin])
    if held:
        yield from sent()


def find_batches(slots: Sequence[tuple[int, str, str]], known: pa.Table):
    """``population, g, items``: the numbers of the known items of every row, ascending.

    ``known`` is ``kid, text, item_id``, where ``text`` tells the items of a slot apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kid = known.column("kid").to_numpy()
        wanted = {}
        for k in np.unique(kid).tolist():
            own = known.filter(pa.array(kid == k))
            wanted[k] = own.column("text").combine_chunks(), np.append(own.column("item_id").to_numpy(), -1)
        for batch in some_rows(batches, slots):
            rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for piece in pieces(batch, slots):
                texts, ids = wanted[piece.kid]
                at = pc.fill_null(pc.index_in(piece.text.cast(texts.type), value_set=texts), -1).to_numpy(zero_copy_only=False)
                item = ids[at][piece.code]
                rows.append(piece.row[item >= 0])
                found.append(item[item >= 0])
            row, item = np.concatenate(rows), np.concatenate(found)
            order = np.lexsort((item, row))
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(item[order]))
            yield pa.RecordBatch.from_arrays([batch.column(POPULATION), batch.column(GROUP), lists], [POPULATION, GROUP, "items"])

    return run


def with_owner(schema: T.StructType, rest: str) -> T.StructType:
    """Population and group as they are in ``schema``, and the columns of ``rest``."""
    return T.StructType([schema[POPULATION], schema[GROUP], *T.StructType.fromDDL(rest).fields])


def counted(read: DataFrame, slots: Sequence[tuple[int, str, str]]) -> DataFrame:
    """``population, g, kid, name, value, count_group`` of all items of ``read``.

    A task counts each batch by itself. What is shuffled is a row of lists for each batch, slot and bucket,
    and the counts of a bucket are merged in one task.
    """
    lists = T.StructType.fromDDL("bucket int, kid int, many int, owner binary, n binary, size binary, text binary").fields
    owners = [T.StructField(f"{c}s", T.ArrayType(read.schema[n].dataType)) for c, n in (("population", POPULATION), ("group", GROUP))]
    schema = T.StructType([*lists[:3], *owners, *lists[3:]])
    dealt = read.mapInArrow(count_batches(slots), schema).repartition("bucket").sortWithinPartitions("bucket")
    merged = dealt.mapInArrow(merge_batches, with_owner(read.schema, "kid int, text string, n long"))
    kid, text = F.col("kid"), F.col("text")
    scalar, entry = (kid.isin([k for k, kind, _ in slots if kind == x]) for x in ("scalar", "entries"))
    name = F.when(entry, F.substring_index(text, ":", 1)).when(~scalar, text)
    value = F.when(entry, F.substr(text, F.instr(text, ":") + 1)).when(scalar, text).otherwise("true")
    return merged.select(POPULATION, GROUP, "kid", name.alias("name"), value.alias("value"), F.col("n").alias("count_group"))
