"""Groups of spelling variants: words one edit apart, and the far more frequent one they stand for.

*Reduced-alphabet generation.* Every letter is hashed to one of a few symbols, which makes of each
word a reduced word. Words one edit apart have reduced words at most one edit apart. So the one-edit
neighbourhood of each different reduced word is generated over the few symbols (instead of the
whole alphabet) and joined to the reduced vocabulary. Pairs of reduced words are opened to the words
behind them, which are compared in full. Of a neighbourhood, the half that another word's
neighbourhood holds too is not written: an insertion is a deletion of the longer word, and of two
replacements of the same length the word with the smaller key looks for the other.

Reduced words and neighbours are 64-bit keys made from prefix sums, so a neighbour costs a few bytes
however long the word. Equal keys of different reduced words only add pairs to compare.

Counts are aggregated in the stage of the scan, so a word that a third of all rows hold is one row
per task. The number of words within one edit of a word is bounded by its length and the alphabet;
no step collects a group. Nothing is broadcast by hand.

Null and empty texts have no words. A null ``doc_id`` counts as an empty string where the id is
hashed. Every row counts, so repeated rows raise the counts. An empty table gives an empty result.
Other columns of the input do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrastmill.llm.arrow_text import BASE, INVERSE, mix, powers, utf8
from contrastmill.runtime import materialize

SYMBOLS = 6
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form occurs at least so many times as often as the word it replaces.
RATIO = 10
#: One run in so many loses a letter.
EVERY = 31
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def thinned(run: Column, doc_id: Column) -> Column:
    """The run, or the run less one of its letters where the checksum of id and run says so."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % EVERY == 0, less).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words of all texts that are long and frequent enough."""
    # a run that is too short is too short with a letter less, so only long ones are made
    runs = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("run")).select(thinned(F.col("run"), F.col("doc_id")).alias("word"))
    counts = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_count)


def symbol_table(symbols: int) -> np.ndarray:
    """The symbol of the second of the two bytes that a letter has in UTF-8, or of its only one."""
    return (1 + mix(np.arange(256, dtype=np.uint64) + np.uint64(1)) % np.uint64(symbols)).astype(np.uint64)


class Reduced:
    """Symbols and keys of the words of an Arrow column."""

    def __init__(self, column: pa.Array, symbols: int):
        data, at = utf8(column)
        # letters beyond ASCII are a lead byte, of which there is only one kind, and another
        own = (data != 0xC3) if len(data) else np.zeros(0, bool)
        before = np.append(0, np.cumsum(own))
        self.at = before[at]
        table = symbol_table(symbols)
        self.symbol = table[data[own]]
        self.length = np.diff(self.at)
        n = len(self.symbol)
        self.row = np.repeat(np.arange(len(self.length)), self.length)
        # place within the word, and sums of symbol times power of place from the word's begin
        self.place = np.arange(n) - self.at[:-1][self.row] if n else np.zeros(0, np.int64)
        longest = int(self.length.max(initial=0)) + 2
        self.power, self.inverse = powers(BASE, longest), powers(INVERSE, 2)
        self.term = self.symbol * self.power[self.place]
        total = np.append(np.uint64(0), np.cumsum(self.term, dtype=np.uint64))
        self.sum = total[self.at[1:]] - total[self.at[:-1]]
        self.ahead = total[:-1] - total[self.at[:-1]][self.row] if n else np.zeros(0, np.uint64)
        self.n_symbols = symbols

    def keys(self) -> np.ndarray:
        return self._key(self.sum, self.length)

    @staticmethod
    def _key(total: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix(total + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)

    def neighbourhoods(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and key: the word itself, one symbol less, and one replaced by one of a larger key."""
        own = self.keys()
        rows, keys = [np.arange(len(own))], [own]
        whole, length = self.sum[self.row], self.length[self.row]
        behind = whole - self.ahead - self.term
        rows.append(self.row)
        keys.append(self._key(self.ahead + behind * np.uint64(INVERSE & ((1 << 64) - 1)), length - 1))
        for step in range(1, self.n_symbols):
            other = (self.symbol - np.uint64(1) + np.uint64(step)) % np.uint64(self.n_symbols) + np.uint64(1)
            key = self._key(whole + (other - self.symbol) * self.power[self.place], length)
            larger = key > own[self.row]
            rows.append(self.row[larger])
            keys.append(key[larger])
        row, key = np.concatenate(rows), np.concatenate(keys)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        return row[new], key[new]


def _slices(batch: pa.RecordBatch, column: str, most: int = 1 << 18):
    """Rows of a batch in slices of about ``most`` bytes of the column, at least one row."""
    _, at = utf8(batch.column(column))
    first, n = 0, batch.num_rows
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def with_keys(words: DataFrame, symbols: int) -> DataFrame:
    """``word, n, reduced`` with the key of the reduced word."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, "word"):
                key = Reduced(part.column("word"), symbols).keys()
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(key)], ["word", "n", "reduced"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, reduced long")


def neighbourhoods(reduced_words: DataFrame, symbols: int) -> DataFrame:
    """``reduced, neighbour`` over a table with one ``word`` for each reduced word."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, "word"):
                reduced = Reduced(part.column("word"), symbols)
                row, key = reduced.neighbourhoods()
                yield pa.RecordBatch.from_arrays([pa.array(reduced.keys()[row]), pa.array(key)], ["reduced", "neighbour"])

    return reduced_words.select("word").mapInArrow(run, "reduced long, neighbour long")


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``a, a_n, b, b_n``: every two words (``word, n``) one edit apart, once."""
    words = materialize(with_keys(words, symbols))
    # Different reduced words of one key are improbable, but each must have its neighbourhood: the
    # reduced word itself, spelled in symbols, tells them apart.
    spelled = F.translate("word", "".join(map(chr, LETTERS)), _spelling(symbols))
    different = words.groupBy("reduced", spelled.alias("spelled")).agg(F.min("word").alias("word"))
    generated = neighbourhoods(different, symbols)
    known = words.select(F.col("reduced").alias("neighbour")).distinct()
    met = generated.join(known, "neighbour").distinct()
    # long keys take their place before words are attached: this is the small side of both joins
    a = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "reduced")
    b = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("reduced").alias("neighbour"))
    opened = met.join(a, "reduced").join(b, "neighbour")
    once = (F.col("reduced") != F.col("neighbour")) | (F.col("a") < F.col("b"))
    near = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    return opened.where(once & near).select("a", "a_n", "b", "b_n")


def _spelling(symbols: int) -> str:
    table = symbol_table(symbols)
    return "".join(chr(0x40 + int(table[chr(c).encode()[-1]])) for c in LETTERS)


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n``: of the near words the most frequent, if frequent enough."""
    near = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), (-F.col("b_n")).alias("less"), F.col("b").alias("near")),
            F.struct(F.col("b").alias("word"), (-F.col("a_n")).alias("less"), F.col("a").alias("near")),
        )
    )
    best = pairs.select(near.alias("p")).groupBy(F.col("p.word").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct("p.less", "p.near")).alias("best")
    )
    joined = words.join(best, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )


def roots(table: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, root`` of the words with a form: where following forms ends.

    Each step multiplies the count by the ratio at least, which bounds the steps; each round
    doubles how many of them are behind a word.
    """
    links = materialize(table.where("form is not null").select("word", F.col("form").alias("root"), "n"))
    highest = table.agg(F.max("n").alias("most")).first()["most"] or 1
    steps = max(1, math.ceil(math.log(highest) / math.log(ratio)) + 1)
    links = links.select("word", "root")
    for _ in range(math.ceil(math.log2(steps))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialize(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return links


def spelling_variants(docs: DataFrame, symbols: int = SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (``doc_id``, ``text``)."""
    words = materialize(vocabulary(docs.select("doc_id", "text")))
    table = materialize(forms(words, near_pairs(words, symbols), ratio))
    ends = roots(table, ratio)
    return table.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
