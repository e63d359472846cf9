"""Ranked lexical search: exact sparse ball trees over the documents' term vectors.

A document is the sparse vector of its impacts on the terms of the queries, a query the vector of
its term weights, and the score their inner product in whole numbers. Documents that share their
strongest terms are brought together by a range sort and cut into blocks of bounded size. Each block
becomes a tree: a node is split between its two most distant documents until few are left.

A node has a centroid and radii. Vectors are scaled by the root of the term's weight, which leaves
inner products as they are, and a radius is taken in each band of terms (each of the most frequent
ones, then ever larger ranges of them). As no impact is negative, a term that the centroid lacks
occurs in no document of the node, so a query's bound is, summed over bands,

    <query, centroid> + |query on the centroid's terms| * radius.

Bounds are computed in doubles and raised by more than their rounding (``SLACK``). Each query visits
the node of the highest bound first and stops when that falls below its k-th score so far; equal
bounds are still visited, as ties go to the smaller id. Leaves are scored in 64-bit integers. A
first pass goes only to the best leaf of every block, and the k-th scores it finds anywhere are
where the whole pass begins.

Queries are taken in blocks of bounded size, and only such a block travels to the tasks. Each block
reads the texts once, keeps what its terms need as a written table, and never holds more than one
block of documents in a task.

Null texts and texts without terms take no part, on either side. Every row of documents counts and
is ranked on its own, repeated rows too; a null ``doc_id`` comes last among equal scores. Rows of
queries that agree in id and text are one query; those that share only the id have an answer each.
Empty tables on either side give an empty result. Other columns of the inputs do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrastmill.llm.arrow_text import LOWER, Runs, hash_words, utf8
from contrastmill.llm.vector_grid import best
from contrastmill.runtime import materialize

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes that belong to a term.
IN_TERM = np.ones(256, np.uint8)
for _first, _last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    IN_TERM[_first : _last + 1] = 0

#: Of a block of queries: rows, and different terms of each added up. One query alone may have more.
QUERY_ROWS = 1 << 10
QUERY_TERMS = 1 << 17
#: Of a block of documents.
BLOCK_ROWS = 1 << 10
BLOCK_TERMS = 1 << 18
LEAF_ROWS = 32
#: So many of the most frequent terms are a band each; further bands grow by this factor.
ALONE = 64
BAND = 1.15
#: Bytes of text that are cut into terms at once.
WINDOW = 1 << 20
#: More than the relative error of sums of four million doubles.
SLACK = 1e-9


def terms_of(text: str | None) -> list[str]:
    return [t.translate(ASCII_LOWER) for t in TERM.findall(text or "")]


# -- documents as rows of (term, occurrences) ---------------------------------------------------


class Vocabulary:
    """The terms of a block of queries, to be found among the terms of texts."""

    def __init__(self, terms: list[str]):
        hashes = hash_words(terms) if terms else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        raw = [terms[i].encode() for i in self.order]
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        same = np.searchsorted(self.hashes, self.hashes, "right") - np.searchsorted(self.hashes, self.hashes, "left")
        self.multiplicity = int(same.max(initial=0))

    def find(self, data: np.ndarray, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the runs that are terms, and the terms' numbers; compared byte by byte."""
        where, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        first = np.searchsorted(self.hashes, runs.hash)
        size = runs.end - runs.begin
        for shift in range(self.multiplicity):
            at = np.minimum(first + shift, len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[at] == runs.hash) & (self.lengths[at] == size))
            at, n = at[hit], size[hit]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            equal = LOWER[data[np.repeat(runs.begin[hit], n) + step]] == self.bytes[np.repeat(self.begins[at], n) + step]
            ok = np.add.reduceat(equal, np.cumsum(n) - n, dtype=np.int64) == n if len(n) else np.zeros(0, bool)
            where.append(hit[ok])
            number.append(self.order[at[ok]])
        return np.concatenate(where), np.concatenate(number)


def _windows(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, number of rows and edges of stretches of about ``WINDOW`` bytes; a longer row is
    cut between terms."""
    row, n = 0, len(at) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + WINDOW, "right")) - 1)
        if last > row + 1 or at[last] - at[row] <= WINDOW:
            yield row, last - row, at[row : last + 1]
        else:
            begin, end = int(at[row]), int(at[row + 1])
            while begin < end:
                cut = begin + WINDOW
                while cut < end and IN_TERM[data[cut]]:
                    ahead = np.flatnonzero(IN_TERM[data[cut : cut + WINDOW]] == 0)
                    cut = cut + int(ahead[0]) if len(ahead) else cut + WINDOW
                cut = min(cut, end)
                yield row, 1, np.array([begin, cut])
                begin = cut
        row = last


def count_terms(vocabulary: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each row, with repeats; and rows, terms and occurrences of the terms sought."""
    data, at = utf8(column)
    n = np.zeros(len(column), np.int64)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = max(1, len(vocabulary.hashes))
    for row, rows, edges in _windows(data, at):
        part = data[edges[0] : edges[-1]]
        runs = Runs(part, edges - edges[0], IN_TERM, LOWER)
        n[row : row + rows] += np.diff(runs.rows)
        where, number = vocabulary.find(part, runs)
        owner = row + np.searchsorted(runs.rows, where, "right") - 1
        key, count = np.unique(owner * size + number, return_counts=True)
        keys.append(key)
        counts.append(count)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
    return n, key // size, key % size, count


def _lists(values: np.ndarray, rows: np.ndarray, n_rows: int, kind: pa.DataType) -> pa.Array:
    offsets = np.searchsorted(rows, np.arange(n_rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def term_rows(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every row with a term (``terms``: numbers of those sought)."""

    def run(batches):
        for batch in batches:
            n, row, term, count = count_terms(vocabulary, batch.column("text"))
            table = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), _lists(term, row, len(n), pa.int32()), _lists(count, row, len(n), pa.int64())],
                ["doc_id", "n", "terms", "tfs"],
            )
            yield table.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


# -- a block of queries -------------------------------------------------------------------------


@dataclass
class Queries:
    """Queries in terms numbered by falling document frequency; bands are ranges of numbers."""

    ids: list
    weight: np.ndarray  # of each term
    begins: np.ndarray  # of each query in the next two
    terms: np.ndarray
    values: np.ndarray  # weight times occurrences, whole numbers
    scale: np.ndarray = field(init=False)
    scaled: np.ndarray = field(init=False)
    edges: np.ndarray = field(init=False)

    def __post_init__(self):
        n = len(self.weight)
        self.scale = np.sqrt(np.maximum(self.weight, 1).astype(np.float64))
        self.scaled = self.values / self.scale[self.terms]
        bands = [*range(ALONE), *(int(ALONE * BAND**i) for i in range(200))]
        self.edges = np.unique([*(b for b in bands if b < n), n])

    @classmethod
    def of(cls, rows: list[tuple[object, Counter]], names: list[str], frequency: np.ndarray, n_docs: int):
        """From each query's terms, with the documents that hold each of ``names``."""
        order = np.argsort(-frequency, kind="stable")
        number = {names[i]: place for place, i in enumerate(order.tolist())}
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in frequency[order]], np.int64)
        flat = [sorted((number[t], c) for t, c in counts.items()) for _, counts in rows]
        terms = np.array([t for q in flat for t, _ in q], np.int64)
        values = np.array([c for q in flat for _, c in q], np.int64) * (weight[terms] if len(terms) else 1)
        begins = np.cumsum([0, *map(len, flat)])
        renumber = np.empty(len(order), np.int64)
        renumber[order] = np.arange(len(order))
        return cls([i for i, _ in rows], weight, begins, terms, values), renumber

    def __len__(self) -> int:
        return len(self.ids)

    def of_some(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``terms`` of some queries, and where each of them begins among these."""
        n = self.begins[which + 1] - self.begins[which]
        starts = np.cumsum(n) - n
        return np.repeat(self.begins[which] - starts, n) + np.arange(int(n.sum())), starts


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of stretches along the last axis; a stretch may be empty."""
    total = np.zeros((*values.shape[:-1], len(starts)), values.dtype)
    ends = np.append(starts[1:], values.shape[-1])
    full = np.flatnonzero(ends > starts)
    if len(full):
        total[..., full] = np.add.reduceat(values, starts[full], axis=-1)
    return total


# -- trees --------------------------------------------------------------------------------------

TREE = {
    "docs": pa.int64(), "doc_begins": pa.int64(), "terms": pa.int32(), "impacts": pa.int64(),
    "first": pa.int32(), "last": pa.int32(), "child": pa.int32(),
    "node_begins": pa.int64(), "node_terms": pa.int32(), "centroids": pa.float64(), "radii": pa.float64(),
}
TREE_SCHEMA = ", ".join(f"{c} array<{ {pa.int64(): 'long', pa.int32(): 'int', pa.float64(): 'double'}[t] }>" for c, t in TREE.items())


def build_tree(ids: pa.Array, begins: np.ndarray, terms: np.ndarray, impacts: np.ndarray, scale: np.ndarray, edges: np.ndarray, leaf: int = LEAF_ROWS) -> dict:
    """The tree over documents given row by row (terms rising within a row).

    Nodes are numbered from the root; ``child`` is the first of the two children, 0 for a leaf.
    """
    n = len(begins) - 1
    row = np.repeat(np.arange(n), np.diff(begins))
    own, local = np.unique(terms, return_inverse=True)
    x = impacts * scale[terms]
    order = np.arange(n)
    first, last, child, node_terms, centroids, radii = [0], [n], [0], [], [], []
    node = 0
    while node < len(first):
        members = order[first[node] : last[node]]
        n_own = begins[members + 1] - begins[members]
        starts = np.cumsum(n_own) - n_own
        at = np.repeat(begins[members] - starts, n_own) + np.arange(int(n_own.sum()))
        t, v = local[at], x[at]
        centre = np.bincount(t, v, len(own)) / len(members)
        support = np.flatnonzero(np.bincount(t, minlength=len(own)))
        # squared distance in each band: the centre's square, corrected at the document's terms
        band = np.searchsorted(edges, own, "right") - 1
        n_bands = len(edges) - 1
        inner = np.repeat(np.arange(len(members)), n_own) * n_bands + band[t]
        square = np.bincount(band, centre**2, n_bands)
        held = np.bincount(inner, v**2, len(members) * n_bands).reshape(-1, n_bands)
        distance = np.bincount(inner, (v - centre[t]) ** 2 - centre[t] ** 2, len(members) * n_bands).reshape(-1, n_bands) + square
        # what cancels above is small against these squares
        radii.append(np.sqrt(np.maximum(distance, 0) + SLACK * SLACK * 1e6 * (square + held)).max(axis=0))
        node_terms.append(own[support])
        centroids.append(centre[support])
        if len(members) > leaf:
            far = int(np.argmax(distance.sum(axis=1)))
            one = np.zeros(len(own))
            one[t[starts[far] : starts[far] + n_own[far]]] = v[starts[far] : starts[far] + n_own[far]]
            whole = held.sum(axis=1)
            products = _sums(v * one[t], starts)
            other = int(np.argmax(whole - 2 * products))
            two = np.zeros(len(own))
            two[t[starts[other] : starts[other] + n_own[other]]] = v[starts[other] : starts[other] + n_own[other]]
            side = np.argsort(_sums(v * (two - one)[t], starts), kind="stable")
            order[first[node] : last[node]] = members[side]
            middle = first[node] + len(members) // 2
            child[node] = len(first)
            first += [first[node], middle]
            last += [middle, last[node]]
            child += [0, 0]
        node += 1
    n_own = begins[order + 1] - begins[order]
    starts = np.cumsum(n_own) - n_own
    at = np.repeat(begins[order] - starts, n_own) + np.arange(int(n_own.sum()))
    return {
        "docs": ids.take(pa.array(order)), "doc_begins": np.append(starts, len(at)), "terms": terms[at], "impacts": impacts[at],
        "first": first, "last": last, "child": child, "node_begins": np.cumsum([0, *map(len, node_terms)]),
        "node_terms": np.concatenate(node_terms), "centroids": np.concatenate(centroids), "radii": np.concatenate(radii),
    }


class Best:
    """The ``k`` best documents of every query so far, and the score that another must reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.reach = k, floor.copy()
        self.row = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, row, ids, null, score) -> None:
        row, ids = np.concatenate([self.row, row]), np.concatenate([self.id, ids])
        null, score = np.concatenate([self.null, null]), np.concatenate([self.score, score])
        top = best(row, ids, score, self.k)
        self.row, self.id, self.null, self.score = row[top], ids[top], null[top], score[top]
        have = np.bincount(self.row, minlength=len(self.reach))
        full = np.flatnonzero(have >= self.k)
        self.reach[full] = np.maximum(self.reach[full], self.score[np.cumsum(have)[full] - 1])


class Tree:
    """A block of documents to search."""

    def __init__(self, row: dict[str, np.ndarray], n_terms: int, n_bands: int):
        self.__dict__.update(row)
        self.n_terms = n_terms
        self.radius = self.radii.reshape(-1, n_bands)
        self.bounds_made = self.leaves_scored = 0

    @property
    def n_leaves(self) -> int:
        return int((self.child == 0).sum())

    def bounds(self, node: int, queries: Queries, which: np.ndarray) -> np.ndarray:
        a, b = self.node_begins[node : node + 2]
        centre = np.zeros(self.n_terms)
        held = np.zeros(self.n_terms, bool)
        centre[self.node_terms[a:b]] = self.centroids[a:b]
        held[self.node_terms[a:b]] = True
        at, starts = queries.of_some(which)
        t, q = queries.terms[at], queries.scaled[at]
        inner = _sums(q * centre[t], starts)
        band = np.searchsorted(queries.edges, t, "right") - 1
        n_bands = self.radius.shape[1]
        owner = np.repeat(np.arange(len(which)), np.diff(np.append(starts, len(at))))
        square = np.bincount(owner * n_bands + band, q * q * held[t], len(which) * n_bands).reshape(-1, n_bands)
        self.bounds_made += len(which)
        return (inner + np.sqrt(square) @ self.radius[node]) * (1 + SLACK) + 1

    def scores(self, node: int, queries: Queries, which: np.ndarray) -> np.ndarray:
        """Exact scores, a row for each document of the leaf."""
        a, b = int(self.first[node]), int(self.last[node])
        low, high = self.doc_begins[a], self.doc_begins[b]
        n = np.diff(self.doc_begins[a : b + 1])
        own, place = np.unique(self.terms[low:high], return_inverse=True)
        table = np.zeros((b - a, len(own) + 1), np.int64)
        table[np.repeat(np.arange(b - a), n), place] = self.impacts[low:high]
        column = np.full(self.n_terms, len(own))
        column[own] = np.arange(len(own))
        at, starts = queries.of_some(which)
        self.leaves_scored += len(which)
        return _sums(table[:, column[queries.terms[at]]] * queries.values[at], starts)

    def search(self, queries: Queries, found: Best, first_leaf_only: bool = False) -> None:
        """Best-first for every query at once: queries at the same node are worked on together."""
        everyone = np.arange(len(queries))
        open_nodes = np.full((len(queries), len(self.first)), -1.0)
        open_nodes[:, 0] = self.bounds(0, queries, everyone)
        ids = self.docs.fill_null(np.iinfo(np.int64).max).to_numpy()
        null = self.docs.is_null().to_numpy(zero_copy_only=False)
        while True:
            node = open_nodes.argmax(axis=1)
            active = np.flatnonzero(open_nodes[everyone, node] >= found.reach)
            if not len(active):
                return
            order = active[np.argsort(node[active], kind="stable")]
            for which in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                at = int(node[which[0]])
                open_nodes[which, at] = -1
                if self.child[at]:
                    for child in (self.child[at], self.child[at] + 1):
                        open_nodes[which, child] = self.bounds(child, queries, which)
                    continue
                scores = self.scores(at, queries, which)
                d, q = np.nonzero(scores >= found.reach[which])
                doc = self.first[at] + d
                found.add(which[q], ids[doc], null[doc], scores[d, q])
                if first_leaf_only:
                    open_nodes[which] = -1


# -- jobs ---------------------------------------------------------------------------------------


def _impacts(batch: pa.RecordBatch, queries: Queries, renumber: np.ndarray, n_docs: int, n_terms: int):
    """Rows, terms (rising within a row) and impacts of a batch of term rows."""
    column = batch.column("terms")
    count = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), count)
    term = renumber[column.flatten().to_numpy()] if len(row) else np.zeros(0, np.int64)
    tf = batch.column("tfs").flatten().to_numpy()
    m = 75 + (25 * batch.column("n").to_numpy() * n_docs) // n_terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
    keep = (queries.weight[term] > 0) & (impact > 0)
    row, term, impact = row[keep], term[keep], impact[keep]
    order = np.lexsort((term, row))
    return row[order], term[order], impact[order]


def tree_rows(rows: DataFrame, queries: Queries, renumber: np.ndarray, n_docs: int, n_terms: int, leaf: int = LEAF_ROWS) -> DataFrame:
    """One row for each block of documents, with its tree."""

    def weigh(batches):
        for batch in batches:
            row, term, impact = _impacts(batch, queries, renumber, n_docs, n_terms)
            strength = impact * queries.weight[term]
            order = np.lexsort((term, -strength, row))
            begin = np.searchsorted(row, np.arange(batch.num_rows))
            n = np.diff(np.append(begin, len(row)))
            lead = np.full((2, batch.num_rows), -1, np.int64)
            for place in range(2):
                has = n > place
                lead[place, has] = term[order][begin[has] + place]
            table = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _lists(term, row, batch.num_rows, pa.int32()), _lists(impact, row, batch.num_rows, pa.int64()),
                 pa.array(lead[0]), pa.array(lead[1])],
                ["doc_id", "terms", "impacts", "lead", "second"],
            )
            yield table.filter(pa.array(n > 0))

    def build(batches):
        held, size, count = [], 0, 0

        def flush():
            table = pa.concat_arrays([h[1] for h in held])
            offsets = np.cumsum([0, *np.concatenate([np.diff(h[1].offsets.to_numpy()) for h in held])])
            terms, impacts = table.flatten().to_numpy(), pa.concat_arrays([h[2] for h in held]).flatten().to_numpy()
            tree = build_tree(pa.concat_arrays([h[0] for h in held]), offsets, terms, impacts, queries.scale, queries.edges, leaf)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.list_(TREE[c])) if c != "docs" else _one(v) for c, v in tree.items()], list(tree))

        for batch in batches:
            sizes = np.diff(batch.column("terms").offsets.to_numpy())
            begin = 0
            while begin < batch.num_rows:
                room = int(np.searchsorted(np.cumsum(sizes[begin:]), BLOCK_TERMS - size, "right"))
                take = min(max(room, 0 if held else 1), BLOCK_ROWS - count, batch.num_rows - begin)
                if take:
                    part = batch.slice(begin, take)
                    held.append((part.column("doc_id"), *(_compact(part.column(c)) for c in ("terms", "impacts"))))
                    size += int(sizes[begin : begin + take].sum())
                    count += take
                    begin += take
                if held and (count >= BLOCK_ROWS or begin < batch.num_rows):
                    yield flush()
                    held, size, count = [], 0, 0
        if held:
            yield flush()

    weighed = rows.mapInArrow(weigh, "doc_id long, terms array<int>, impacts array<long>, lead long, second long")
    near = weighed.repartitionByRange("lead", "second", F.xxhash64("doc_id", "terms")).sortWithinPartitions("lead", "second")
    return near.select("doc_id", "terms", "impacts").mapInArrow(build, TREE_SCHEMA)


def _compact(lists: pa.Array) -> pa.Array:
    """A list column whose offsets begin at 0."""
    offsets = lists.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), lists.flatten())


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def search_trees(trees: DataFrame, queries: Queries, floor: np.ndarray, k: int, first_leaf_only: bool = False) -> DataFrame:
    """``query, doc_id, score``: the best ``k`` of each task."""

    def run(batches):
        found = Best(floor, k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in TREE}
                row = {c: v if c == "docs" else v.to_numpy() for c, v in row.items()}
                Tree(row, len(queries.weight), len(queries.edges) - 1).search(queries, found, first_leaf_only)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.row, pa.int32()), pa.array(found.id, pa.int64(), mask=found.null), pa.array(found.score, pa.int64())],
            ["query", "doc_id", "score"],
        )

    return trees.mapInArrow(run, "query int, doc_id long, score long")


def _search_block(docs: DataFrame, rows: list[tuple[object, Counter]], k: int) -> tuple[DataFrame, list]:
    names = sorted({t for _, counts in rows for t in counts})
    counted = materialize(term_rows(docs, Vocabulary(names)))
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(names), np.int64)
    for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        frequency[term] = n
    queries, renumber = Queries.of(rows, names, frequency, n_docs)
    trees = materialize(tree_rows(counted, queries, renumber, n_docs, max(1, n_terms)))
    floor = np.ones(len(queries), np.int64)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    seen = search_trees(trees, queries, floor, k, first_leaf_only=True).withColumn("rank", F.row_number().over(order))
    for query, score in seen.where(F.col("rank") == k).select("query", "score").collect():
        floor[query] = score
    found = search_trees(trees, queries, floor, k).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query", "rank", "doc_id", "score"), queries.ids


def query_blocks(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """Queries with terms, in blocks of bounded size."""
    held, size = [], 0
    for item_id, text in items.select("item_id", "text").where("text is not null").distinct().toLocalIterator():
        counts = Counter(terms_of(text))
        if not counts:
            continue
        if held and (len(held) >= QUERY_ROWS or size + len(counts) > QUERY_TERMS):
            yield held
            held, size = [], 0
        held.append((item_id, counts))
        size += len(counts)
    if held:
        yield held


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best rows of ``docs`` (``doc_id``, ``text``) for
    each of ``items`` (``item_id``, ``text``), by falling score, then by rising id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    item_type = items.schema["item_id"].dataType.simpleString()
    answers = []
    for rows in query_blocks(items):
        found, ids = _search_block(docs, rows, k)
        named = spark.createDataFrame(list(enumerate(ids)), f"query int, item_id {item_type}")
        answers.append(found.join(named, "query").select("item_id", "rank", "doc_id", "score"))
    if not answers:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    whole = answers[0]
    for other in answers[1:]:
        whole = whole.unionByName(other)
    return whole
