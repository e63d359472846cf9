"""Every operator of the subpackage against a plain version on small tables with the awkward cases."""

import collections
import hashlib
import os
import re
import sys
import time
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

public_tokenizers = pytest.importorskip("public_tokenizers")

from contrastmill.llm.arrow_text import utf8  # noqa: E402
from contrastmill.llm.components import components  # noqa: E402
from contrastmill.llm.license_scan import TEMPLATES, license_matches  # noqa: E402
from contrastmill.llm.main_text import Tree, article_nodes, density, main_text, main_texts  # noqa: E402
from contrastmill.llm.mixing import mix, mixed_documents, targets  # noqa: E402
from contrastmill.llm.nearest_neighbours import nearest_neighbours  # noqa: E402
from contrastmill.llm.ngram_jaccard import jaccard_components  # noqa: E402
from contrastmill.llm.quality import quality_scores  # noqa: E402
from contrastmill.llm.sentencepiece_scan import Known, Pieces, decode, encode, encode_rows  # noqa: E402
from contrastmill.llm.token_counts import token_counts  # noqa: E402
from contrastmill.llm.top_k_search import top_k_search  # noqa: E402
from contrastmill.llm.toxicity import isotonic, toxicity_scores  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = np.random.default_rng(3)
VOCABULARY = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 6))) for _ in range(300)]


def prose(n):
    return " ".join(VOCABULARY[i] for i in rng.integers(0, len(VOCABULARY), n))


AWKWARD = [(900, None), (901, ""), (902, " \n "), (903, "x"), (904, "two words"), (904, "two words"), (905, prose(4000)), (None, "no id here at all")]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_main_text(spark):
    pages = [
        (1, "u", "<html><body><nav><a href=1>Home</a></nav><article><h1>A &amp; b</h1><p>First <b>bold</b>\n text<p>Second&nbsp;one"
                 "<div class='comments'><p>reader says</p></div></article><footer>f</footer></body></html>"),
        (2, "u", None), (3, None, ""), (4, "u", "plain words only"), (5, "u", "<script>var a = '<p>no</p>'</script><p>yes"),
        (6, "u", "<article><p>" + "long " * 20000 + "</p><aside>x</aside>"), (6, "u", "<p>again</p>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = rows(main_texts(df), "page_id", "text", "n_chars")
    texts = [(1, "A & b First bold text Second one"), (2, ""), (3, ""), (4, "plain words only"), (5, "yes"), (6, ("long " * 20000).strip()), (6, "again")]
    assert got == sorted(((i, t, len(t)) for i, t in texts), key=repr)
    assert main_texts(df.limit(0)).count() == 0


LONG = "<p>" + "An article has sentences that go on for a while and hold no links at all. " * 3 + "</p>"
LINE = ("An article has sentences that go on for a while and hold no links at all. " * 3).strip()


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div class='content has-sidebar'><article>{LONG}</article></div>", LINE),
        (f"<div class='page-sidebar'><main>{LONG}</main></div><div class='sidebar'>{LONG}</div>", LINE),
        (f"<article>{LONG}<section id='discussion'><h2>Discussion</h2>{LONG}</section></article>", f"{LINE} Discussion {LINE}"),
        (f"<article>{LONG}<p>So <math><mi>x</mi></math>.</p></article>", f"{LINE} So x."),
        (f"<article>{LONG}<p class='alert'>Beware.</p><div class='share'><a>a</a><a>b</a></div></article>", LINE),
        (f"<div><a>home</a><a>more</a></div><div><h1>T</h1>{LONG}{LONG}</div><div>Small print</div>", f"T {LINE} {LINE}"),
        (f"<article>{LONG}</article><section class='comments'>{LONG * 5}</section>", LINE),
        (f"<article>{LONG}</article><article class='comment'>{LONG}{LONG}</article>", LINE),
        (f"<div class='sidebar'>{LONG}</div>", LINE),
        (f"<div class='entry social-science'>{LONG}{LONG}</div>", f"{LINE} {LINE}"),
        (f"<main><div>{LONG}{LONG}</div><div><a>x</a> <a>y</a></div></main>", f"{LINE} {LINE}"),
    ],
)
def test_main_text_by_density(page, want):
    assert main_text(f"<html><body>{page}</body></html>") == want


def test_density_against_recursion():
    """Sums of a random tree, and the core that they choose, by plain recursion."""
    draw = np.random.default_rng(8)

    def page(depth):
        inner = "".join(page(depth - 1) for _ in range(draw.integers(0, 4))) if depth else ""
        text = "word " * int(draw.integers(0, 40))
        kind = draw.choice(["div", "section", "span", "a", "td"])
        return f"<{kind}>{text}{inner}</{kind}>"

    for _ in range(60):
        tree = Tree(f"<body>{page(4)}{page(4)}</body>")
        n = len(tree.tag)
        children = [[c for c in range(n) if tree.parent[c] == i] for i in range(n)]

        def measure(i, linked=False):
            linked = linked or tree.tag[i] == "a"
            c = sum(len(v.strip()) for j, v in tree.pieces if j == i and v)
            parts = [measure(k, linked) for k in children[i]]
            links = sum(p[3] + (tree.tag[k] == "a") for p, k in zip(parts, children[i]))
            return c + sum(p[0] for p in parts), 1 + sum(p[1] for p in parts), c * linked + sum(p[2] for p in parts), links

        parts = {}

        def linked(i):
            return i > 0 and (tree.tag[i] == "a" or linked(tree.parent[i]))

        for i in range(n):
            parts[i] = measure(i, linked(i))
        body = parts[tree.tag.index("body")]
        share = body[2] / max(1, body[0])
        dense = [density(*parts[i], share) for i in range(n)]
        sums = [sum(dense[c] for c in children[i]) for i in range(n)]
        best = max(range(n), key=lambda i: (sums[i], dense[i]))
        assert article_nodes(tree)[best]


@pytest.mark.parametrize("page", ["<div>" * 100_000, "</b>" * 100_000, "<p>" + "<b>" * 100_000 + "</i>" * 100_000, "<li>" * 100_000, "<p title=\"x>y" * 20_000])
def test_broken_pages_take_linear_time(page):
    begin = time.process_time()
    main_text(page)
    assert time.process_time() - begin < 5


def test_mixing(spark):
    data = [(i, prose(int(rng.integers(1, 60))), f"s{i % 7}") for i in range(200)] + [(i, t, None) for i, t in AWKWARD]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mix(df).collect()
    assert len(out) == len(data)
    sizes = collections.Counter()
    for _, t, s in data:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            break
        full.update({s: 3 * sizes[s] for s in over})
    want = {**full, **share}
    taken = collections.Counter()
    for r in out:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in names)
    positions = [r.position for r in out if r.position is not None]
    assert positions == sorted(positions)
    assert rows(mix(df), "doc_id", "taken", "position") == rows(mix(df), "doc_id", "taken", "position")
    many = mixed_documents(df)
    assert many.columns == df.columns and many.count() == sum(-(-r.taken // r.size) for r in out if r.taken)
    assert mix(df.limit(0)).count() == 0
    one = targets(spark.createDataFrame([("a", 10)], "source string, source_size long")).first()
    assert one.target == 10.0


def test_mixed_documents_repeats_have_positions(spark):
    """Each time that a document is taken stands after all words of its source's earlier epochs."""
    data = [(i, "w " * (1 + i % 5), "small" if i < 12 else "whole") for i in range(150)]
    names = ("size", "source_size", "target", "taken", "position")
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in names})
    got = mixed_documents(df, weights=(5, 1), schedules=((1.0, 1.0), (1.0, 1.0)))
    assert got.columns == df.columns
    got = got.collect()
    total = {s: sum(1 + i % 5 for i, _, t in data if t == s) for s in ("small", "whole")}
    want = {"small": 3 * total["small"], "whole": total["whole"] - 2 * total["small"]}
    expected = []
    for source in total:
        ids = sorted((i for i, _, s in data if s == source), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        before = 0
        for epoch in range(3):
            for i in ids:
                if before < want[source]:
                    expected.append((before / want[source], i, epoch))
                before += 1 + i % 5
    assert [r.doc_id for r in got] == [i for _, i, _ in sorted(expected)]
    assert all(r[c] == c for r in got for c in names)


def plain_sum(values):
    """Left to right, without the correction that ``sum`` makes."""
    total = 0
    for v in values:
        total += v
    return total


def vectors(spark):
    data = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(300)]
    data += [(400 + i, data[0][1]) for i in range(60)]  # ties
    data += [(500, None), (520, []), (540, [0.0] * 8), (560, [None] + [1.0] * 7), (580, [float("nan")] * 8), (600, [float("inf")] + [1.0] * 7)]
    data += [(0, data[0][1]), (620, [1.0, 2.0])]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))


@pytest.mark.parametrize("blocks", [{}, {"block": 50, "query_block": 3}])
def test_searches(spark, blocks):
    data, df = vectors(spark)
    good = {i: v for i, v in data if v and None not in v and np.isfinite(v).all()}

    def brute(every, k, change, nonzero):
        taken = {i: change(np.array(v, np.float64)) for i, v in good.items() if any(v) or not nonzero}
        out = []
        for q, a in taken.items():
            if q % every == 0:
                scores = sorted((-plain_sum(x * y for x, y in zip(a.tolist(), b.tolist())), i) for i, b in taken.items() if i != q and len(a) == len(b))
                out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
        return sorted(out, key=repr)

    columns = ("query_id", "rank", "vec_id", "score")
    assert rows(nearest_neighbours(df, F.col("vec_id") % 20 == 0, 7, **blocks), *columns) == brute(20, 7, lambda v: v, True)
    whole = brute(50, 5, lambda v: np.floor(256 * v).astype(np.int64), False)
    assert rows(top_k_search(df, F.col("vec_id") % 50 == 0, 5, **blocks), *columns) == whole
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0, 7).count() == 0


@pytest.mark.parametrize("huge, overlap", [(1 << 16, 1024), (300, 20)])
def test_token_counts(spark, huge, overlap):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    data = [*AWKWARD, (1, "ab " * 400), (2, "é" * 900), (3, "  a  b " * 200), (4, ("x" * 150 + " ") * 9)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("key", F.lit("clash"))
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in data), key=repr)
    assert rows(token_counts(df, PATH, huge, overlap), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts(df.limit(0), PATH).count() == 0


def test_sentencepiece_scan(spark):
    import sentencepiece

    model, pieces = sentencepiece.SentencePieceProcessor(model_file=PATH), Pieces(PATH)
    data = [*AWKWARD, (1, "日本語 text\n\tand 😀 ṻ"), (2, "  a   b "), (3, "thethethe" * 400), (4, prose(300)), (5, " " * 47 + "é"), (6, "\x00<s>▁x")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit("clash"))

    def cost(ids):
        unknown = [i for i in ids if model.is_byte(i)]
        return None if unknown else sum(pieces.scores[i] for i in ids)

    want = sorted(((i, (t or "").replace("▁", " "), model.encode(t or "")) for i, t in data), key=repr)
    for options in ({}, {"giant": 20, "chunk": 17}, {"giant": 100, "chunk": 64}):
        out = decode(encode(df, PATH, **options), PATH)
        got = out.collect()
        assert sorted(((r.doc_id, r.text.replace("▁", " "), r.ids) for r in got), key=repr) == want
        assert all(r.score == cost(r.ids) for r in got if cost(r.ids) is not None)
    assert encode(df.limit(0), PATH).count() == 0


def test_giant_texts_are_told_apart_by_their_length_as_it_is(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [None, "", "a" * 29, "a" * 30, "▁" * 10, "▁" * 11, "é" * 14, "é" * 15, "a▁b" * 9, "a�b"]
    raw = [None if t is None else t.encode() for t in texts[:-1]] + [b"a\xffb"]
    df = spark.createDataFrame(list(enumerate(raw)), "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    found = encode(df, PATH, giant=30)
    assert {r.doc_id: r.ids for r in found.collect()} == {i: model.encode(t or "") for i, t in enumerate(texts)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length(cast(raw" in plan and "translate(" not in plan


def test_compatible_pairs_give_the_merged_pieces():
    """Whole and cut into chunks: equal to the library on words made of pieces, whatever they are."""
    import sentencepiece

    model, pieces = sentencepiece.SentencePieceProcessor(model_file=PATH), Pieces(PATH)
    draw = np.random.default_rng(6)
    spelled = [t.decode() for t in pieces.text.values()]
    texts = ["".join(spelled[i] for i in draw.integers(0, len(spelled), draw.integers(1, 20))) for _ in range(3000)]
    texts += ["".join(draw.choice(list("abc  é日\n"), draw.integers(1, 50))) for _ in range(1000)]
    data, at = utf8(pa.array([" " + t for t in texts]))
    ids, begin, _ = encode_rows(data, at, pieces, Known())
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == model.encode(texts)


def test_giant_text_of_a_megabyte(spark):
    import sentencepiece

    text = "thequick" * 20_000 + prose(150_000) + " " * 1000 + "日" * 5000
    assert len(text) > 700_000
    got = encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).collect()
    assert got[0].ids == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)


def brute_components(data):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for i, t in data:
        w = WORD.findall((t or "").translate(low))
        sets.append((i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    return [(i, len(s), smallest.get(find(k))) for k, (i, s) in enumerate(sets)]


def test_ngram_jaccard(spark):
    data = list(AWKWARD)
    for base in range(12):
        words = prose(80).split()
        data.append((base * 100 + 5, " ".join(words)))
        for v in range(9):
            changed = list(words)
            for _ in range(v):
                changed[int(rng.integers(0, len(changed)))] = VOCABULARY[int(rng.integers(0, 300))]
            data.append((base * 100 + 10 + v, " ".join(changed).upper() if v % 4 == 1 else " ".join(changed)))
    passage = prose(60)
    data += [(3000 + i, prose(int(rng.integers(5, 90))) + " " + passage) for i in range(20)]
    data += [(4000 + i, data[8][1]) for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(3)
    want = [r for r in brute_components(data) if r[0] is not None]
    got = rows(jaccard_components(df), "doc_id", "n_shingles", "component_id")
    assert [r for r in got if r[0] is not None] == sorted(want, key=repr)
    assert len(got) == len(data)
    assert jaccard_components(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    out = rows(components(spark.createDataFrame(edges, "u long, v long")), "node", "label")
    assert out == sorted([(i, 0) for i in range(51)] + [(i, 100) for i in (100, 101, 102)], key=repr)


def labelled(spark, spoil):
    data, labels = list(AWKWARD), []
    for i in range(400):
        bad = i % 4 == 0
        data.append((i, spoil(prose(40)) if bad else prose(40)))
        labels.append((i, int(not bad), int(bad)))
    labels += [(None, 1, 1), (5000, None, None), (7, None, None), (8, 0, 1), (8, 0, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("score", F.lit("clash"))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), data


@pytest.mark.parametrize(
    "scores, column, threshold, spoil",
    [
        (quality_scores, "quality", 0.7, lambda t: t.replace(" ", "%%% ").upper()),
        (toxicity_scores, "toxic", 0.3, lambda t: t + " you idiot " + t + " worthless moron"),
    ],
)
def test_classifiers(spark, scores, column, threshold, spoil):
    docs, labels, data = labelled(spark, spoil)
    out = scores(docs, labels).collect()
    assert len(out) == len(data)
    right = []
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 400 and r.held_out:
            right.append(r.predicted == int((r.doc_id % 4 == 0) == (column == "toxic")))
    assert np.mean(right) >= 0.95
    # what held-out rows are labelled changes nothing
    flipped = labels.withColumn(column, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col(column)).otherwise(F.col(column)))
    assert rows(scores(docs, flipped), "doc_id", "score") == sorted(((r.doc_id, r.score) for r in out), key=repr)
    nothing = scores(docs, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {1.0 if column == "quality" else 0.0}
    assert scores(docs.limit(0), labels).count() == 0


def test_isotonic_is_monotone():
    f, y = np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1.0])
    x, s = isotonic(f, y)
    assert (np.diff(x) > 0).all() and (np.diff(s) >= 0).all() and 0 <= s[0] and s[-1] <= 1


def test_license_scan(spark):
    mit = TEMPLATES["MIT"]
    data = [
        (1, "Some prose first.\nReleased under the MIT License.\nmore prose"), (2, mit.replace(". ", ".\n", 3) + "\n\nThe end"),
        (3, mit.replace("sublicense", "resell").upper()), (4, prose(3000) + " license"), *AWKWARD,
        (5, "Licensed under CC BY-NC 4.0."), (5, "Licensed under CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("unit", F.lit("clash"))
    out = license_matches(df)
    got = rows(out, "doc_id", "unit", "license")
    assert got == sorted(
        [(1, "line", "MIT (notice)"), (2, "paragraph", "MIT"), (2, "document", "MIT"), (3, "line", "MIT"),
         (5, "line", "CC-BY-NC-4.0 (notice)"), (5, "line", "CC-BY-NC-4.0 (notice)")], key=repr,
    )
    assert all(0.8 <= r.dice <= 1 for r in out.collect())
    assert license_matches(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    quality, toxic, join, mixing, last = (f for _, f in corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality(spark, docs, sf)
    assert kept.columns == columns
    assert rows(kept, "doc_id") == rows(quality_scores(docs, labels).where("predicted = 1"), "doc_id")
    clean = toxic(spark, docs, sf)
    assert rows(clean, "doc_id") == rows(toxicity_scores(docs, labels).where("predicted = 0"), "doc_id")
    single = join(spark, docs, sf)
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(single, "doc_id") == sorted({(c,) for _, _, c in brute_components(pairs)}, key=repr)
    mixed = mixing(spark, single, sf)
    assert mixed.columns == columns and 0 < mixed.select("doc_id").distinct().count() <= before
    assert last(spark, mixed, sf).count() == mixed.count()
    assert last(spark, mixing(spark, docs.limit(0), sf), sf).count() == 0


def test_pipeline_stages_take_any_columns(spark):
    """Columns that are named like the stages' own come through; nulls and repeats too."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    odd = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    quality, toxic, join, mixing, last = (f for _, f in corpus_pipeline.STAGES)
    more = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("score", "score_", "_pipeline_score", "predicted", "position", "size", "words")})
    for stage in (quality, toxic, join, mixing):
        kept = stage(spark, more, sf)
        assert kept.columns == more.columns
        assert rows(kept.drop("text"), "doc_id", "score", "position") == rows(stage(spark, docs, sf).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("score", "position")}), "doc_id", "score", "position")
    assert last(spark, more, sf).columns == ["doc_id", "ids", "n_pieces", "score"]
    for stage in (quality, toxic, join, mixing):
        assert stage(spark, more.limit(0), sf).count() == 0
