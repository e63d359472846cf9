"""Strings of a large dictionary found in texts, by their own bytes.

A string is looked for by its first ``KEY`` bytes. A task goes over its texts once for each length of
such keys and asks a Bloom filter which places may begin one; what it lets through is written once a
text, as the bytes found there, and joined to the dictionary. Strings that are no longer than ``KEY``
are equal to what was written, or they are not there. Longer ones are written with what follows, as
far as the longest string can reach, and compared.

The dictionary is a table and never comes to the driver, only the lengths of its strings and the
filter do, whose size is bounded. The work on a text grows with its length, not with the dictionary;
beyond some 2 ** ``MOST_BITS`` / ``BITS`` strings the filter lets more through, which the join drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrastmill.operators.groups import GROUP, POPULATION, col, with_reference_count
from contrastmill.operators.numbering import with_row_number
from contrastmill.runtime import materialize

#: Bytes that a string is looked for by: two numbers of 64 bits.
KEY = 16
#: Bytes of text a task takes at once, and places it asks the filter about at once.
SLICE = 1 << 20
BLOCK = 1 << 16
#: Lengths of beginnings that the filter knows too: longer keys are asked for where these pass.
STEMS = (4, 8)
#: Bits of the filter for each string, and its size at least and at most as a power of two.
BITS = 64
LEAST_BITS, MOST_BITS = 16, 25

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], np.uint64)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each begins and ends."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _eights(data: np.ndarray) -> np.ndarray:
    """From each byte on, eight bytes as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(KEY + 7, np.uint8)])
    return np.ndarray((len(data) + KEY,), "<u8", padded, strides=(1,))


def _keys_at(eights: np.ndarray, places: np.ndarray | slice, length: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The ``length`` bytes from each place on, as one number or two."""
    mask = np.uint64((1 << 8 * ((length - 1) % 8 + 1)) - 1)
    if length <= 8:
        return eights[places] & mask, None
    return eights[places] & ~np.uint64(0), eights[8:][places] & mask


def _hashes(key: tuple[np.ndarray, np.ndarray | None], salt: int) -> np.ndarray:
    low, high = key
    h = low * ODD[0]
    if high is not None:
        h ^= high * ODD[1]
    h ^= h >> np.uint64(32)
    h += np.uint64(salt)
    h *= ODD[2]
    return h


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that belong to each hash."""
    second = (h >> np.uint64(64 - 2 * bits)) & np.uint64((1 << bits) - 1)
    return (h >> np.uint64(64 - bits)).view(np.int64), second.view(np.int64)


def _passing(eights: np.ndarray, places: np.ndarray | slice, length: int, salt: int, table: np.ndarray) -> np.ndarray:
    """Those of ``places`` whose ``length`` bytes the filter lets through."""
    bits = len(table).bit_length() - 1
    h = _hashes(_keys_at(eights, places, length), salt)
    hit = np.flatnonzero(table[(h >> np.uint64(64 - bits)).view(np.int64)])
    hit = hit[table[_slots(h[hit], bits)[1]]]
    return places.start + hit if isinstance(places, slice) else places[hit]


def _places(eights: np.ndarray, lengths: list[int], table: np.ndarray) -> dict[int, np.ndarray]:
    """For each of some ascending lengths the places where the filter lets a key through."""
    n, found = len(eights) - KEY, {length: [np.zeros(0, np.int64)] for length in lengths}
    for first in range(0, n, BLOCK):
        near: np.ndarray | slice = slice(first, min(first + BLOCK, n))
        stems = list(STEMS)
        for length in lengths:
            while stems and length > stems[0]:
                stem = stems.pop(0)
                near = _passing(eights, near, stem, KEY + stem, table)
            found[length].append(_passing(eights, near, length, length, table))
    return {length: np.concatenate(x) for length, x in found.items()}


def _numbered(part: np.ndarray) -> tuple[int, np.ndarray]:
    """How many different numbers there are, and which of them each is."""
    if not len(part) or part.max() >= 1 << 16:
        values, inverse = np.unique(part, return_inverse=True)
        return len(values), inverse
    rank = np.cumsum(np.bincount(part.view(np.int64)) > 0) - 1
    return int(rank[-1]) + 1, rank[part.view(np.int64)]


def _once(key: tuple[np.ndarray, np.ndarray | None], row: np.ndarray, rows: int) -> np.ndarray:
    """One place for each different key of a row."""
    number = np.zeros(len(row), np.int64)
    many = 1
    for part in key:
        if part is not None:
            different, inverse = _numbered(part)
            number, many = number * different + inverse, many * different
    number += row * many
    if rows * many > 1 << 21:
        return np.unique(number, return_index=True)[1]
    place = np.full(rows * many, -1, np.int64)
    place[number] = np.arange(len(number))
    return place[place >= 0]


def _binary(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    at = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def _slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE`` bytes; a longer text is one by itself."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, "right")) - 1)
        yield first, last
        first = last


def _short_pieces(data: np.ndarray, at: np.ndarray, lengths: list[int], table: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """What may be a string of ``lengths`` bytes, each once a text: the text's number and the bytes."""
    eights, rows = _eights(data), len(at) - 1
    owner, end = np.repeat(np.arange(rows), np.diff(at)), at[1:]
    texts, sizes, pieces = [], [], []
    if lengths[0] == 0:
        texts.append(np.arange(rows))
        sizes.append(np.zeros(rows, np.int64))
        lengths = lengths[1:]
    for length, place in _places(eights, lengths, table).items():
        row = owner[place]
        inside = place + length <= end[row]
        place, row = place[inside], row[inside]
        some = _once(_keys_at(eights, place, length), row, rows)
        place = place[some]
        texts.append(row[some])
        sizes.append(np.full(len(place), length))
        pieces.append(data[place[:, None] + np.arange(length)].reshape(-1))
    return np.concatenate(texts), _binary(np.concatenate(sizes), np.concatenate([np.zeros(0, np.uint8), *pieces]))


def _short(lengths: list[int], table: np.ndarray):
    def run(batches):
        for batch in batches:
            data, at = _bytes_of(batch.column("text"))
            keys = batch.select([n for n in batch.schema.names if n != "text"])
            for first, last in _slices(at):
                if at[last] - at[first] <= SLICE:
                    row, pieces = _short_pieces(data[at[first] : at[last]], at[first : last + 1] - at[first], lengths, table)
                    yield _with_keys(keys, first + row, pieces)
                    continue
                seen: set[bytes] = set()
                for begin in range(at[first], at[last], SLICE):
                    part = data[begin : min(begin + SLICE + KEY - 1, at[last])]
                    _, pieces = _short_pieces(part, np.array([0, len(part)]), lengths, table)
                    new = [p for p in pieces.to_pylist() if p not in seen]
                    seen.update(new)
                    yield _with_keys(keys, np.full(len(new), first), pa.array(new, pa.binary()))

    return run


def _long(least: int, most: int, table: np.ndarray):
    """What follows each place that may begin a string of ``least`` to ``most`` bytes."""

    def run(batches):
        for batch in batches:
            data, at = _bytes_of(batch.column("text"))
            keys = batch.select([n for n in batch.schema.names if n != "text"])
            held: set[tuple[int, bytes]] = set()
            size = 0
            for first, last in _slices(at):
                for begin in range(at[first], at[last], SLICE):
                    part = data[begin : min(begin + SLICE + KEY - 1, at[last])]
                    place = begin + _places(_eights(part), [KEY], table)[KEY]
                    row = np.searchsorted(at, place, "right") - 1
                    inside = place + least <= at[row + 1]
                    for p, r in zip(place[inside].tolist(), row[inside].tolist()):
                        entry = (r, data[p : min(p + most, at[r + 1])].tobytes())
                        if entry not in held:
                            held.add(entry)
                            size += len(entry[1])
                        if size > SLICE * 4:
                            yield _with_keys(keys, np.array([r for r, _ in held]), pa.array([x for _, x in held], pa.binary()))
                            held, size = set(), 0
            if held:
                yield _with_keys(keys, np.array([r for r, _ in held]), pa.array([x for _, x in held], pa.binary()))

    return run


def _with_keys(keys: pa.RecordBatch, row: np.ndarray, pieces: pa.Array) -> pa.RecordBatch:
    taken = keys.take(pa.array(row, pa.int64()))
    return pa.RecordBatch.from_arrays([*taken.columns, pieces], [*keys.schema.names, "piece"])


def _marks(bits: int):
    """The filter's bits of some strings, as the words of 64 that hold them."""

    def run(batches):
        for batch in batches:
            data, at = _bytes_of(batch.column("pattern"))
            eights, begin, size = _eights(data), at[:-1], np.minimum(np.diff(at), KEY)
            slots = [np.zeros(0, np.int64)]
            for length in np.unique(size[size > 0]).tolist():
                own = begin[size == length]
                slots += _slots(_hashes(_keys_at(eights, own, length), length), bits)
                for stem in STEMS:
                    if length > stem:
                        slots += _slots(_hashes(_keys_at(eights, own, stem), KEY + stem), bits)
            slot = np.unique(np.concatenate(slots))
            mark = np.left_shift(np.int64(1), slot & 63)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(mark)], ["word", "mark"])

    return run


def pattern_filter(strings: DataFrame, many: int) -> np.ndarray:
    """A Bloom filter of the keys of ``many`` different strings, a boolean for each bit."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS * many).bit_length() - 1))
    marks = strings.select("pattern").mapInArrow(_marks(bits), "word long, mark long")
    words = marks.groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("mark").to_numpy()
    return np.unpackbits(table.astype("<i8").view(np.uint8), bitorder="little").astype(bool)


def _bytes(text: Column) -> Column:
    return text.cast("binary")


def pattern_hits(rows: DataFrame, text: str, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, pattern``: the strings that each text holds, once each.

    ``keys`` must name a row (``numbering.with_row_number``). A null text holds nothing.
    """
    strings = materialize(patterns.select("pattern").where(F.col("pattern").isNotNull()).distinct())
    size = F.octet_length("pattern")
    sizes = strings.groupBy(F.least(size, F.lit(KEY + 1)).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min(size), F.max(size))
    sizes = {n: rest for n, *rest in sizes.collect()}
    texts = rows.where(col(text).isNotNull()).select(*keys, col(text).alias("text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name in keys] + ["piece binary"])
    found = []
    longer = sizes.pop(KEY + 1, None)
    if sizes:
        short = strings.where(size <= KEY)
        run = _short(sorted(sizes), pattern_filter(short, sum(n for n, *_ in sizes.values())))
        pieces = texts.mapInArrow(run, schema).select(*keys, F.col("piece").cast("string").alias("pattern"))
        found.append(pieces.join(short, "pattern", "left_semi").select(*keys, "pattern"))
    if longer:
        many, least, most = longer
        head = F.substring(_bytes(F.col("pattern")), 1, KEY)
        long = strings.where(size > KEY)
        run = _long(least, most, pattern_filter(long, many))
        pieces = texts.mapInArrow(run, schema).withColumn("head", F.substring("piece", 1, KEY))
        both = pieces.join(long.withColumn("head", head), "head")
        held = both.where(F.startswith("piece", _bytes(F.col("pattern"))))
        found.append(held.select(*keys, "pattern").distinct())
    if not found:
        return rows.select(*keys, F.lit("").alias("pattern")).where("false")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def pattern_counts(tagged: DataFrame, text: str, patterns: DataFrame, overlapping: bool = False) -> DataFrame:
    """Rows whose text holds each string of a dictionary table, per group and in the reference."""
    rows = with_row_number(tagged.select(POPULATION, GROUP, col(text).alias("text")), "row")
    hits = pattern_hits(rows, "text", patterns, [POPULATION, GROUP, "row"])
    counts = hits.groupBy(POPULATION, F.col("pattern").alias("member"), GROUP).agg(F.count(F.lit(1)).alias("count_group"))
    return with_reference_count(counts, [POPULATION, "member"], overlapping, many_groups=True)


def with_pattern_members(df: DataFrame, text: str, patterns: DataFrame, name: str) -> DataFrame:
    """``df`` with the sorted array ``name`` of the strings that the text of a row holds.

    The array is what ``features.listed_family`` makes a family of. The rows are written with their
    numbers first, as both the search and the join need them.
    """
    rows = materialize(with_row_number(df, "__row"))
    hits = pattern_hits(rows, text, patterns, ["__row"])
    lists = hits.groupBy("__row").agg(F.sort_array(F.collect_list("pattern")).alias(name))
    nothing = F.when(col(text).isNotNull(), F.array().cast("array<string>"))
    return rows.join(lists, "__row", "left").withColumn(name, F.coalesce(name, nothing)).drop("__row")
