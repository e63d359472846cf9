"""Documents with similar sets of word n-grams, by a token-group matrix.

A document's set holds 64-bit hashes of its shingles. Documents with the same set are one *node*.
Two nodes link when ``9 * |A and B| >= 4 * (|A| + |B|)``, the same as a Jaccard similarity of 0.8.

1. Tokens are ordered: frequent ones last, others by hash. Linked nodes share a token among the
   first ``n - ceil(0.8 n) + 1`` of each (the prefix). Frequency only serves to keep prefixes
   selective; the result does not depend on which tokens count as frequent.
2. Prefix tokens of two nodes or more are the rows of the matrix. Every node with such a token
   first tries one link, to the node that most of its tokens point to (that with most copies).
   Large groups of near copies become one component by a number of comparisons linear in their size.
3. Nodes are partitioned into groups of similar nodes, at most about ``GROUP``: those of one component,
   others by their first shared token, and of similar size. The matrix has, for a token and a group,
   whether a member could link by it, and the range of sizes and components. Groups are held against
   groups first: the tokens in the unions of both groups' prefixes bound what any two of their nodes
   share. Only for pairs that this leaves do nodes query groups: the number of a node's tokens in the
   union of a group's prefixes must reach the least that linked nodes have in both prefixes. Groups
   all of the node's own component are left out, so what is connected is not compared again.
4. Where the bound leaves a group, it is opened in a task, with others of the same component or token:
   the union of the members' tokens bounds the overlap of the query with each of them, and only a query that reaches the least overlap
   needed meets the members. One link per query and component met is kept.

Queries of a bundle of groups are dealt to chunks, so no task holds more than a bundle and a chunk. Null and
empty texts have no shingles and link with nothing; with fewer words than ``n`` the whole sequence
is the only shingle. Repeated rows share their node and keep their result rows. A row without
``doc_id`` is in its own component, which has no id unless it is linked. Other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrastmill.llm.arrow_text import LOWER, WORD, Runs, mix, slices, utf8
from contrastmill.llm.components import components
from contrastmill.runtime import materialize

SHINGLE = 5
FREQUENT_IN_BATCH = 16
FREQUENT_TOKENS = 1 << 18
GROUP = 64
BUNDLE = 256
SIZE_STEP = 1.05
FILTER_BITS = 1 << 23
CHUNK = 512
SALT = 32
SLICE_BYTES = 1 << 18


def shingles(data: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle, repeated ones too."""
    words = Runs(data, at, WORD, LOWER)
    rows, h = words.rows, words.hash
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    factor = np.uint64(0xD6E8FEB86659FD93)
    if len(h) >= n:
        total = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            total = total * factor + h[j : len(h) - n + 1 + j]
        whole = row[: len(total)] == row[n - 1 :]
        hashes, of = mix(total[whole]), row[: len(total)][whole]
    else:
        hashes, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((np.diff(rows) > 0) & (np.diff(rows) < n))
    if len(short):
        few = np.zeros(len(short), np.uint64)
        for i, r in enumerate(short):
            for v in h[rows[r] : rows[r + 1]].tolist():
                few[i] = np.uint64((int(few[i]) * int(factor) + v + 1) & 0xFFFFFFFFFFFFFFFF)
        hashes, of = np.concatenate([hashes, mix(few ^ np.uint64(0xA5A5A5A5A5A5A5A5))]), np.concatenate([of, short])
    return hashes, of


def token_sets(data: np.ndarray, at: np.ndarray, n: int, frequent: np.ndarray | None = None, rank: np.ndarray | None = None):
    """Distinct tokens of each row in the common order, and where each row's begin."""
    hashes, of = shingles(data, at, n)
    order = np.argsort(hashes)
    if frequent is not None and len(frequent):
        h = hashes[order]
        where = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        late = np.where(frequent[where] == h, rank[where], 0)
        order = order[np.argsort(late, kind="stable")]
    of_sorted = of[order]
    order = order[np.argsort(of_sorted.astype(np.uint16) if len(at) < 1 << 16 else of_sorted, kind="stable")]
    hashes, of = hashes[order], of[order]
    if len(hashes):
        new = np.empty(len(hashes), bool)
        new[0] = True
        new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
        hashes, of = hashes[new], of[new]
    return hashes, np.searchsorted(of, np.arange(len(at)))


def nodes_of(tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One number for each set, from sums that do not depend on the order of tokens."""
    sums = []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mix(tokens ^ np.uint64(salt)), out=total[1:])
        sums.append(total[begin[1:]] - total[begin[:-1]])
    return mix(sums[0] ^ mix(sums[1] + np.diff(begin).astype(np.uint64))).view(np.int64)


def _frequent(n: int):
    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            found = [np.zeros(0, np.uint64)]
            for first, last in slices(at, SLICE_BYTES):
                found.append(token_sets(data[at[first] : at[last]], at[first : last + 1] - at[first], n)[0])
            tokens = np.concatenate(found)
            del found
            tokens.sort()
            # a token that is there often enough equals the one so many places later
            k = FREQUENT_IN_BATCH - 1
            often = np.unique(tokens[k:][tokens[k:] == tokens[:-k]]) if len(tokens) > k else tokens[:0]
            count = np.searchsorted(tokens, often, "right") - np.searchsorted(tokens, often, "left")
            yield pa.RecordBatch.from_arrays([pa.array(often.view(np.int64)), pa.array(count, pa.int64())], ["token", "n"])

    return run


def frequent_tokens(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``FREQUENT_TOKENS`` tokens that are frequent in some batch, sorted, and their rank by count."""
    counts = docs.select("text").mapInArrow(_frequent(n), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    table = counts.orderBy(F.desc("n"), "token").limit(FREQUENT_TOKENS).toArrow()
    tokens, many = table.column("token").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.lexsort((tokens, many))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    by_token = np.argsort(tokens)
    return tokens[by_token], rank[by_token]


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-4 * n // 5) + 1


def _prefixes(n: int, frequent: np.ndarray, rank: np.ndarray):
    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for first, last in slices(at, SLICE_BYTES):
                tokens, begin = token_sets(data[at[first] : at[last]], at[first : last + 1] - at[first], n, frequent, rank)
                size = np.diff(begin)
                take = np.where(size > 0, prefix_length(size), 0)
                offsets = np.concatenate([[0], np.cumsum(take)])
                at_token = np.repeat(begin[:-1] - offsets[:-1], take) + np.arange(offsets[-1])
                lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(tokens[at_token].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[first:last], pa.array(nodes_of(tokens, begin)), pa.array(size, pa.int64()), lists],
                    ["doc_id", "node", "n", "prefix"],
                )

    return run


def _whole_sets(n: int):
    def run(batches):
        seen: set[int] = set()  # repeated rows; a set that comes twice does no harm
        for batch in batches:
            data, at = utf8(batch.column("text"))
            wanted = batch.column("node").to_numpy()
            for first, last in slices(at, SLICE_BYTES):
                tokens, begin = token_sets(data[at[first] : at[last]], at[first : last + 1] - at[first], n)
                node = nodes_of(tokens, begin)
                right = [i for i in np.flatnonzero(node == wanted[first:last]) if node[i] not in seen]
                seen.update(node[right].tolist())
                sets = [tokens[begin[i] : begin[i + 1]].tobytes() for i in right]
                yield pa.RecordBatch.from_arrays([pa.array(node[right]), pa.array(sets, pa.binary())], ["node", "tokens"])

    return run


def _listed(bits: np.ndarray):
    def run(batches):
        for batch in batches:
            h = batch.column("h").to_numpy()
            there = (bits[h >> 6] >> (h & 63)) & 1
            yield batch.select(["doc_id", "text"]).filter(pa.array(there.astype(bool)))

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``node, tokens`` of the wanted nodes, computed anew from one document of each.

    Texts that are surely not wanted stay out of the shuffle: a bit map of fixed size tells them.
    """
    wanted = materialize(wanted.join(ids, "node"))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("h")
    words = wanted.select(slot).groupBy(F.expr("h div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("bits"))
    table, bits = words.toArrow(), np.zeros(FILTER_BITS // 64, np.int64)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    kind = docs.schema["doc_id"].dataType.simpleString()
    near = docs.where("doc_id is not null").select("doc_id", "text", slot).mapInArrow(_listed(bits), f"doc_id {kind}, text string")
    # a shuffle on both sides: a broadcast would put both Python steps, and so two workers, in one task
    return materialize(near.join(wanted.hint("merge"), "doc_id").select("node", "text").mapInArrow(_whole_sets(n), "node long, tokens binary"))


def _verify(batches):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("a"), batch.column("b")):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            shared = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
            keep.append(9 * shared >= 4 * (len(a) + len(b)))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _open(frame: pd.DataFrame) -> pd.DataFrame:
    queries, members = frame[frame["asks"]], frame[~frame["asks"]]
    sets = [np.frombuffer(t, np.uint64) for t in members["tokens"]]
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, of = tokens[order], of[order]
    node, component = members["node"].to_numpy(), members["component"].to_numpy()
    u, v = [], []
    if not sets:
        queries = queries[:0]
    for q, c, raw in zip(queries["node"], queries["component"], queries["tokens"]):
        own = np.frombuffer(raw, np.uint64)
        least = max(int(sizes.min()), -(-4 * len(own) // 5))
        left, right = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        if 9 * np.count_nonzero(right > left) < 4 * (len(own) + least):
            continue
        n = right - left
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shared = np.bincount(of[np.repeat(left, n) + inner], minlength=len(sets))
        linked = np.flatnonzero((9 * shared >= 4 * (len(own) + sizes)) & (component != c))
        _, first = np.unique(component[linked], return_index=True)
        u += [q] * len(first)
        v += node[linked[first]].tolist()
    return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def _with_parts(rows: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """``rows`` with the number of parts of at most about ``most`` rows that their key has.

    Only keys of more than one part are joined, and these by salted keys, so that a key that many
    rows share is not met in one task.
    """
    large = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias(name)).where(F.col(name) > 1)
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))
    large = large.withColumn("salt", F.explode(salts))
    return rows.join(large, [*keys, "salt"], "left").withColumn(name, F.coalesce(name, F.lit(1)))


def jaccard_components(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id``, ``text``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    frequent, rank = frequent_tokens(docs, n)
    sets = materialize(docs.mapInArrow(_prefixes(n, frequent, rank), f"doc_id {kind}, node long, n long, prefix array<long>"))

    # 1: shared tokens of the prefixes; place: position of the token in the node's order
    nodes = sets.where("n > 0 and doc_id is not null").groupBy("node").agg(
        F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"), F.count(F.lit(1)).alias("copies"),
        F.min("doc_id").alias("doc_id"),
    )
    nodes = materialize(nodes)
    rows = nodes.select("node", "n", "copies", F.posexplode("prefix").alias("place", "token"))
    common = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # tokens grow with the corpus: hints keep them from being broadcast, so the plan is one for all sizes
    posts = materialize(rows.join(common.select("token").hint("merge"), "token"))

    candidates = posts.groupBy("node").agg(
        F.any_value("n").alias("n"), F.min(F.struct("place", "token"))["token"].alias("first"), F.count(F.lit(1)).alias("shared")
    )
    candidates = materialize(candidates)
    ids = nodes.select("node", "doc_id")

    # 2: one link for each node
    pivots = posts.groupBy("token").agg(F.max(F.struct("copies", "node", "n")).alias("pivot"))
    votes = (
        posts.join(pivots.hint("merge"), "token").where("node <> pivot.node and 5 * n >= 4 * pivot.n and 5 * pivot.n >= 4 * n")
        .groupBy("node", F.col("pivot.node").alias("pivot")).agg(F.count(F.lit(1)).alias("votes"), F.any_value("n").alias("n"))
        .groupBy("node").agg(F.max(F.struct("votes", "pivot")).alias("best"), F.any_value("n").alias("n"))
        .where("25 * best.votes >= n")
    )
    pairs = votes.select(F.col("node").alias("u"), F.col("best.pivot").alias("v"))
    pairs = materialize(pairs)
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    tokens = _sets_of(docs, ends, ids, n)
    a = tokens.select(F.col("node").alias("u"), F.col("tokens").alias("a"))
    b = tokens.select(F.col("node").alias("v"), F.col("tokens").alias("b"))
    checked = pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_verify, "u long, v long")
    linked = materialize(checked)
    first_labels = materialize(components(linked))

    # 3: groups and their matrix
    label = F.coalesce("label", "node").alias("component")
    # Nodes of a component are similar and stand together, others by their first token.
    place = candidates.join(first_labels, "node", "left").select(
        "node", "n", "shared", label, F.coalesce("label", "first").alias("first"),
        F.floor(F.log("n") / float(np.log(SIZE_STEP))).alias("scale"), F.pmod(F.xxhash64("node"), F.lit(SALT)).alias("salt"),
    )
    place = materialize(place)
    placed = _with_parts(_with_parts(place, ["first", "scale"], GROUP, "blocks"), ["first"], BUNDLE, "bundles")
    group = F.xxhash64("first", "scale", F.pmod(F.xxhash64("node"), "blocks")).alias("group")
    # groups with the same key that are opened together
    placed = placed.select("node", "first", "shared", "bundles", "component", group)
    bundle = F.xxhash64("first", F.pmod("group", "bundles")).alias("bundle")
    member = materialize(placed.select("node", "group", bundle, "component", "shared"))
    known = posts.select("token", "node", "n", "place").join(member, "node")
    matrix = known.groupBy("token", "group").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"),
        F.max(F.expr("5 * n - 9 * place")).alias("reach"), F.max("shared").alias("shared1"), F.any_value("bundle").alias("to"),
        F.count(F.lit(1)).alias("members"),
    )
    queries = known.select("token", "node", "component", "n", "place", "shared", F.col("group").alias("own"))
    # of two linked nodes the smaller has at least size m, and so many tokens of both prefixes are common
    smaller = "greatest(n0, ceil(4 * n / 5))"
    needed = f"ceil(4 * (n + {smaller}) / 9) - ceil(4 * n / 5) + 1"
    # Groups against groups: what two groups' prefixes have in common bounds it for their nodes.
    matrix = materialize(matrix)
    asking = matrix.select("token", F.col("group").alias("own"), *[F.col(c).alias(f"q_{c}") for c in ("c0", "c1", "n0", "n1", "shared1")])
    # the least of ``needed`` over queries of n from q_n0 to q_n1, rounded down
    least_needed = "greatest(1, ceil(4 * n0 / 9 - 16 * least(q_n1, 1.25 * n0) / 45 + 0.199))"
    both = materialize(asking.join(matrix, "token").where(
        "n0 <= q_n1 and 5 * n1 >= 4 * q_n0 and (c0 <> c1 or q_c0 <> q_c1 or c0 <> q_c0) and (group <> own or members > 1) "
        f"and least(q_shared1, shared1) >= {least_needed}"
    ))
    close = both.groupBy("own", "group").agg(F.count(F.lit(1)).alias("hits"), F.min(F.expr(least_needed)).alias("needed"))
    opened = both.join(close.where("hits >= needed").select("own", "group"), ["own", "group"], "left_semi")
    met = queries.join(opened, ["token", "own"]).where(
        f"n0 <= n and 5 * n1 >= 4 * n and least(shared, shared1) >= {needed} and (c0 <> c1 or c0 <> component)"
    )
    # the first token that they share comes early in both
    early = F.expr(f"reach >= 4 * n and 5 * n - 9 * place >= 4 * {smaller}")
    bound = met.groupBy("node", "component", "group", F.col("to").alias("bundle")).agg(
        F.count(F.lit(1)).alias("hits"), F.min(F.expr(needed)).alias("needed"), F.max(early).alias("early")
    )
    asked = materialize(bound.where("early and hits >= needed").select("node", "component", "group", "bundle"))
    members = materialize(member.join(asked.select("group").distinct(), "group", "left_semi").select("node", "component", "bundle"))
    asked = materialize(asked.select("node", "component", "bundle").distinct())
    tokens = _sets_of(docs, asked.select("node").union(members.select("node")).distinct(), ids, n)

    # 4: open what is left
    width = materialize(asked.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))
    chunk = F.pmod(F.xxhash64("node"), "chunks").cast("int")
    roles = asked.join(width, "bundle").select("node", "component", "bundle", chunk.alias("chunk"), F.lit(True).alias("asks"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    roles = roles.unionByName(members.join(width, "bundle").select("node", "component", "bundle", every, F.lit(False).alias("asks")))
    found = roles.join(tokens, "node").groupBy("bundle", "chunk").applyInPandas(_open, "u long, v long")
    labels = components(materialize(linked.unionByName(found)))

    # back to documents
    label = F.coalesce("label", "node")
    of_node = ids.join(labels, "node", "left").select("node", label.alias("label"), "doc_id")
    smallest = of_node.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    answer = of_node.select("node", "label").join(smallest, "label").select("node", "component_id")
    answer = materialize(answer)
    alone = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return sets.select("doc_id", "node", "n").join(answer, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id")
    )
