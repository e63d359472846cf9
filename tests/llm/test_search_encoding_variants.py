"""Lexical search, byte-level BPE and spelling variants against plain versions."""

import collections
import hashlib
import math
import re
import struct
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from contrastmill.llm import byte_bpe, lexical_search, spelling_variants  # noqa: E402

BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
rng = np.random.default_rng(11)
WORDS = ["".join(rng.choice(list("abcdeéЖ"), rng.integers(1, 6))) for _ in range(200)]


def prose(n, of=WORDS):
    return " ".join(of[i] for i in rng.integers(0, len(of), n))


# -- lexical search -----------------------------------------------------------------------------


def plain_search(docs, items, k=20):
    counts = [(i, collections.Counter(t.translate(LOWER) for t in TERM.findall(x or ""))) for i, x in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        query = collections.Counter(t.translate(LOWER) for t in TERM.findall(text or ""))
        scores = []
        for i, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                for t, r in query.items() if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("terms", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash")).withColumn("query", F.lit(0))
    found = lexical_search.lexical_search(d, i, **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_lexical_search(spark):
    docs = [(i, prose(int(rng.integers(1, 60)))) for i in range(1500)]
    copy = prose(30)
    docs += [(i, copy) for i in range(2000, 2060)] + [(7, "Twice over"), (7, "Twice over"), (None, copy), (None, "twice"), (1, None), (2, ""), (3, " \n ,.")]
    docs += [(4000, prose(20000)), (4001, "x" * 5000 + " " + copy.upper())]
    items = [(i, prose(int(rng.integers(1, 40)))) for i in range(25)] + [(100, copy), (100, copy), (100, "twice OVER"), (None, "twice twice twice")]
    items += [(101, None), (102, ""), (103, "unheard of"), (104, "éé Ж"), (105, prose(3000))]
    assert searched(spark, docs, items) == plain_search(docs, items)
    assert searched(spark, docs, items[:4], k=3) == plain_search(docs, items[:4], 3)
    assert searched(spark, docs, [(1, None)]) == searched(spark, [(1, None)], items) == searched(spark, [], items) == searched(spark, docs, []) == []


def test_small_blocks_give_the_same(spark, monkeypatch):
    docs = [(i, prose(int(rng.integers(1, 40)))) for i in range(300)]
    items = [(i, prose(10)) for i in range(8)]
    expected = plain_search(docs, items)
    monkeypatch.setattr(lexical_search, "QUERY_ROWS", 3)
    monkeypatch.setattr(lexical_search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(lexical_search, "WINDOW", 16)
    assert searched(spark, docs, items) == expected


def test_bounds_hold_and_prune():
    """No bound is below the best score under its node, and far leaves are never scored."""
    names = [f"t{i}" for i in range(400)]
    frequency = np.array([500 // (1 + i % 50) + 1 for i in range(400)])
    rows = [(i, collections.Counter(names[t] for t in rng.integers(100 * (i % 4), 100 * (i % 4) + 100, 12))) for i in range(40)]
    queries, renumber = lexical_search.Queries.of(rows, names, frequency, 1000)
    begins, terms, impacts = [0], [], []
    for d in range(600):
        own = np.unique(renumber[rng.integers(100 * (d % 4), 100 * (d % 4) + 100, 15)])
        terms.append(own)
        impacts.append(rng.integers(1, 10**6, len(own)))
        begins.append(begins[-1] + len(own))
    terms, impacts = np.concatenate(terms), np.concatenate(impacts)
    import pyarrow as pa

    made = lexical_search.build_tree(pa.array(range(600), pa.int64()), np.array(begins), terms, impacts, queries.scale, queries.edges, 16)
    tree = lexical_search.Tree({k: v if k == "docs" else np.asarray(v) for k, v in made.items()}, 400, len(queries.edges) - 1)
    everyone = np.arange(len(queries))
    dense = np.zeros((600, 400), np.int64)
    dense[np.repeat(np.arange(600), np.diff(begins)), terms] = impacts
    weights = np.zeros((40, 400), np.int64)
    weights[np.repeat(np.arange(40), np.diff(queries.begins)), queries.terms] = queries.values
    scores = dense @ weights.T
    for node in range(len(tree.first)):
        members = tree.docs.to_numpy()[tree.first[node] : tree.last[node]]
        assert (tree.bounds(node, queries, everyone) >= scores[members].max(axis=0)).all()
    found = lexical_search.Best(np.ones(40, np.int64), 5)
    tree.search(queries, found)
    assert tree.leaves_scored < 0.6 * tree.n_leaves * len(queries)
    for q in range(40):
        expected = sorted((-s, d) for d, s in enumerate(scores[:, q].tolist()) if s > 0)[:5]
        mine = [(-s, d) for r, d, s in zip(found.row, found.id, found.score) if r == q]
        assert mine == expected


# -- byte-level BPE -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_MODEL)


@pytest.fixture(scope="module")
def model():
    return byte_bpe.ByteBpe(BYTE_MODEL)


def ids_of(model, text, window=byte_bpe.WINDOW):
    return [int(i) for _, part in model.encoded([text], window) for i in part]


PIECES = ["'s", "'ll", "'re", "'", " '", "  ", "\n", "\t", " ", "the", "Over", "ing", "12", "²", "é", "Ж", "中文", "😀", "՘", "!", "?!", "<|endoftext|>", "\x85", "\x1c", "aaaa"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4))), st.sampled_from([5, 40, byte_bpe.WINDOW]))
def test_ids_are_the_librarys(model, library, parts, window):
    text = "".join(parts)
    ids = ids_of(model, text, window)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert model.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False) == text


def test_pair_check_is_exact_merging(model):
    """A pair crosses if and only if merging the two spellings gives something else."""
    valid = np.flatnonzero(model.valid)
    a, b = rng.choice(valid, 4000), rng.choice(valid, 4000)
    common = np.array([model.token[w] for w in (b"a", b"aa", b"aaa", b" t", b"he", b"e", b"in", b"n", b"g", b" ", b"  ")if w in model.token])
    a, b = np.concatenate([a, np.repeat(common, len(common))]), np.concatenate([b, np.tile(common, len(common))])
    crosses = model.crossing(a, b)
    for x, y, bad in zip(a.tolist(), b.tolist(), crosses.tolist()):
        both = model.decode_bytes(np.array([x])) + model.decode_bytes(np.array([y]))
        assert (model.merge(both) != [x, y]) == bad
        assert model._merge_long(both) == model.merge(both)


def test_long_runs(model, library):
    for text in ("a" * 30000, "ab" * 20000, "\n" * 3000 + " x", "'" * 2000, prose(30000), "!'s" * 500):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids_of(model, text) == ids_of(model, text, 1000) == expected


def test_byte_bpe_tables(spark, library, model):
    texts = [(1, "Hello there, it's 12 o'clock"), (1, "Hello there, it's 12 o'clock"), (2, None), (3, ""), (None, "no id"), (4, prose(20000)), (5, "<|endoftext|>x")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(0.5))
    columns = ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")
    got = sorted((tuple(r) for r in byte_bpe.encode(df, BYTE_MODEL, columns).collect()), key=repr)
    expected = []
    for i, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        expected.append((i, len(ids), ids, digest, text or "", hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(expected, key=repr)
    both = byte_bpe.decode(byte_bpe.encode(df, BYTE_MODEL), BYTE_MODEL)
    assert sorted(both.collect(), key=repr) == sorted((spark.createDataFrame([(i, t or "") for i, t in texts], "doc_id long, text string").collect()), key=repr)
    assert byte_bpe.encode(df.limit(0), BYTE_MODEL).count() == 0
    # a character cut in two, an id that is not there
    half = [model.single["é".encode()[0]], 10**6, -1, model.token[b"a"]]
    row = spark.createDataFrame([(1, half), (2, None)], "doc_id long, ids array<int>")
    assert [r["text"] for r in byte_bpe.decode(row, BYTE_MODEL).orderBy("doc_id").collect()] == ["�a", ""]
    with pytest.raises(ValueError):
        byte_bpe.encode(df, BYTE_MODEL, ("n_words",))


# -- spelling variants --------------------------------------------------------------------------


def plain_variants(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    by_length = collections.defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    neighbours = {w: [x for d in (-1, 0, 1) for x in by_length[len(w) + d] if near(w, x)] for w in n}
    form = {}
    for w, others in neighbours.items():
        first = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = first if first is not None and n[first] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(neighbours[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out)


def variants(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("word", F.lit(1)).withColumn("run", F.lit(1))
    found = spelling_variants.spelling_variants(df, **more)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in found.collect())


def edited(word):
    at, letter = int(rng.integers(0, len(word))), str(rng.choice(list("abzéÿ×")))
    return [word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :], word[:at] + letter + word[at:]][int(rng.integers(0, 3))]


def test_spelling_variants(spark):
    stems = ["".join(rng.choice(list("abcdeéÿ÷"), rng.integers(6, 11))) for _ in range(60)]
    docs = [(i, prose(40, stems)) for i in range(40)]
    once = [edited(s) for s in stems for _ in range(4)]
    twice = [edited(s) for s in once]
    docs += [(100 + i, prose(150, once)) for i in range(8)] + [(200 + i, prose(60, twice)) for i in range(12)]
    giant, rest = "a" * 30000, "b" * 9 + "é" * 3000
    docs += [(300, f"{giant} {giant} {giant}a {giant}a {rest} {rest} {rest[1:]} {rest[1:]}"), (301, "Mixed MIXED ÉCLAIRS éclairs éclairs ÉCLAIRS")]
    # a chain of three forms, by counts of 2, 20, 200 and 2000
    docs += [(400, "gradient1 gradiant " * 2000), (401, "gradiont " * 200 + "gradionts " * 20 + "gradiontsz " * 2)]
    docs += [(None, "nobodyid nobodyid"), (None, "nobodyid"), (7, None), (8, ""), (9, "short 123"), (10, prose(20, stems)), (10, prose(20, stems))]
    expected = plain_variants(docs)
    assert any(w != r and f != r for w, f, r, *_ in expected if f)
    assert variants(spark, docs) == expected
    assert variants(spark, docs, symbols=2) == expected
    assert variants(spark, []) == variants(spark, [(1, None), (2, "few words here")]) == []
