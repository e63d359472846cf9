import collections
import itertools
import json
import random

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from catalog import queries
from catalog.oracle import SQL, STOP_WORDS
from contrastmill.operators import bitmaps, discovery, groups, items, numbering, pairs, patterns, priors, reports, words
from contrastmill.operators.features import FeatureSet, addon_family, derive_features, listed_family, module_family
from contrastmill.operators.items import Layout
from contrastmill.sinks import results
from contrastmill.sources import dictionaries, records, versions


def test_item_types_stay_apart(spark):
    tables = [spark.createDataFrame([(v, "a")], f"k {t}, g string") for v, t in ((None, "string"), ("null", "string"), (True, "boolean"), ("true", "string"))]
    seen = set()
    for df in tables:
        tagged = groups.with_population(df)
        seen |= {(r.key, r.value, r.vtype) for r in items.item_counts(tagged, Layout.of(tagged)).collect()}
    assert len(seen) == 4


def random_table(spark, seed=1, n=200):
    rng = random.Random(seed)
    rows = [(rng.choice("xyz") if rng.random() < 0.9 else None, rng.choice(["a", "b", None]), rng.random() < 0.5, rng.randrange(3)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g string, a string, `b.c` boolean, d int")


@pytest.mark.parametrize("many", [False, True])
def test_item_counts_against_enumeration(spark, many):
    rows, df = random_table(spark)
    tagged = groups.with_population(df)
    got = {(r.g, r.key, r.value): (r.count_group, r.count_reference) for r in items.item_counts(tagged, Layout.of(tagged), many_groups=many).collect()}
    want = {}
    for g in "xyz":
        for i, k in enumerate(("a", "b.c", "d"), 1):
            for v in {r[i] for r in rows}:
                own = sum(r[0] == g and r[i] == v for r in rows)
                text = None if v is None else str(v).lower()
                if own:
                    want[(g, k, text)] = (own, sum(r[i] == v for r in rows))
    assert got == want


def test_equality_groups_from_a_table(spark):
    rows, df = random_table(spark)
    names = spark.createDataFrame([("all", "x"), ("all", "q"), ("other", "y")], "population string, g string")
    by_table = groups.group_by_equality(df.withColumnRenamed("g", "s"), "s", names)
    by_list = groups.group_by_equality(df.withColumnRenamed("g", "s"), "s", ["x", "q"])
    totals = [sorted(map(tuple, groups.group_totals(t).collect())) for t in (by_table, by_list)]
    assert totals[0] == totals[1] == [("all", "x", sum(r[0] == "x" for r in rows), len(rows))]


def test_zero_fill(spark):
    ref = spark.createDataFrame([("a", None, 9), ("a", "1", 5)], "key string, value string, count_reference bigint")
    own = spark.createDataFrame([("a", None, "x", 4), ("b", "2", "y", 7)], "key string, value string, g string, count_group bigint")
    got = {tuple(r) for r in items.zero_fill(ref, own, ["key", "value"], ["x", "y"]).collect()}
    assert got == {("a", None, "x", 4, 9), ("a", None, "y", 0, 9), ("a", "1", "x", 0, 5), ("a", "1", "y", 0, 5), ("b", "2", "y", 7, 0)}


def test_members_count_once_per_row_and_record(spark):
    rows = [("r1", "x", ["a:1", "a:2", "b"]), ("r1", "x", ["a:1"]), ("r2", "y", None), ("r3", None, ["a:9", "c:1"])]
    df = groups.with_population(spark.createDataFrame(rows, "uuid string, g string, addons array<string>"))
    got = {(r.member, r.g): (r.count_group, r.count_reference) for r in discovery.addon_counts(df, addon_family()).collect()}
    assert got == {("a", "x"): (2, 3)}
    family = module_family(F.transform("addons", lambda a: F.left(a, F.lit(1))), ("addons",))
    by_record = discovery.module_counts(df, family, record_id="uuid")
    assert {(r.member, r.g): r.count_group for r in by_record.collect()} == {("a", "x"): 1, ("b", "x"): 1}


def test_pair_constraint_is_symmetric(spark):
    rows = [("all", "x", i, k, "true", "bool", f, k, n, 9, 9, 10, 20) for i, (k, f, n) in enumerate([("m1", "module", 7), ("m2", "module", 7), ("platform", None, 1), ("cpu", None, 2)])]
    df = spark.createDataFrame(rows, "population string, g string, item_id bigint, key string, value string, vtype string, family string, name string, kid int, count_group bigint, count_reference bigint, total_group bigint, total_reference bigint")
    for order in (df, df.withColumn("item_id", 10 - F.col("item_id"))):
        found = pairs.pair_candidates(order, {7: ("platform",)})
        assert {frozenset((r.lo_key, r.hi_key)) for r in found.collect()} == {frozenset(p) for p in (("m1", "platform"), ("m2", "platform"), ("platform", "cpu"))}


def test_closure_with_a_cycle(spark):
    edges = priors.prior_edges(spark, [("p", "s"), ("s", "p"), ("s", "t"), ("t", "u"), ("u", "v"), ("v", "w")])
    got = {tuple(r) for r in priors.prior_closure(edges).collect()}
    assert {d for s, d in got if s == "p"} == {"s", "t", "u", "v", "w"}
    assert ("s", "p") in got and ("t", "p") not in got
    assert priors.prior_closure(priors.prior_edges(spark, [])).count() == 0


def test_percentage(spark):
    df = spark.createDataFrame([(1.0,), (0.0005,), (0.5,), (0.05,), (0.0,)], "x double")
    assert [r[0] for r in df.select(reports.percentage(F.col("x"))).collect()] == ["100.0", "00.05", "50.00", "05.00", "00.00"]


def test_tokens(spark):
    df = spark.createDataFrame([(" Hello  World. ",), ("",), ("  ",), ("a\u000bb\t",), (None,)], "t string")
    got = [r[0] for r in df.select(words.tokenize(F.col("t"))).collect()]
    assert got == [["", "hello", "", "world."], [""], [], ["a", "b"], None]


def test_top_words(spark):
    rows = [("A", "The crash crashes. CRASHED again", "en-US"), ("A", "browser crashing", None), ("B", "browser slow", "en"), ("B", "nope", "de"), ("C", "  ", "en"), (None, "slow", "en")]
    df = spark.createDataFrame(rows, "signature string, user_comments string, useragent_locale string")
    got = [(r.g, r.rank, r.word, r.tf) for r in words.top_words(df, "signature", ["A", "B"]).orderBy("g", "rank").collect()]
    # crash 3 times plus crashes. with its ending kept from the stemmer by the full stop
    assert got[0] == ("A", 1, "crash", 3)
    assert ("A", 2, "crashes", 1) in got and ("B", 1, "browser", 1) in got
    assert not [w for w in got if w[2] in ("the", "again", "nope", "")]
    scores = {(r.g, r.word): r.tfidf for r in words.top_words(df, "signature", ["A", "B"]).collect()}
    assert scores[("A", "crash")] == pytest.approx(3 * 0.916291, abs=1e-5)
    assert words.top_words(df.limit(0), "signature", ["A"]).count() == 0




def test_stop_word_list(spark):
    assert sorted(STOP_WORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))


def test_versions(spark):
    current = spark.createDataFrame([("P", "55.0.3", "56.0b9", "57.0a1", "52.3.0esr", ""), ("Q", "1.0", "2.0b1", "3.0a1", "9.0esr", "10.1.0esr")], "product string, release string, beta string, nightly string, esr string, esr_next string")
    history = spark.createDataFrame([("P", "stability", "55.0.1"), ("P", "stability", "5.5"), ("P", "stability", "52.0.1"), ("P", "development", "56.0b1"), ("P", "development", "55.0b1"), ("Q", "stability", "10.0.1")], "product string, category string, version string")
    got = {}
    for r in versions.release_versions(current, history).collect():
        got.setdefault((r.product, r.channel), set()).add(r.version)
    assert got == {
        ("P", "release"): {"55.0", "55.0.1"}, ("P", "esr"): {"52.0", "52.0.1"}, ("P", "beta"): {"56.0b1"}, ("P", "nightly"): {"57.0a1"},
        ("Q", "release"): {"1.0"}, ("Q", "esr"): {"10.0", "10.0.1"}, ("Q", "nightly"): {"3.0a1"},
    }


def test_dictionaries(spark):
    lines = [("ScopedGfxFeatureReporter ", 'reporter("D3D11 Layers");'), ("ScopedGfxFeatureReporter ", '#include "gfxCrashReporterUtils.h"'), ("ScopedGfxFeatureReporter ", "no string"), ("gfxCriticalError(", 'x(", " << "later")'), ("gfxCriticalNote <<", 'note << "Failed: " << "b"')]
    df = spark.createDataFrame(lines, "query string, line string")
    assert dictionaries.pattern_list(dictionaries.pattern_dictionary(df)) == ["D3D11 Layers+", "D3D11 Layers-", "D3D11 Layers?"]
    assert dictionaries.pattern_list(dictionaries.error_dictionary(df)) == ["Failed: "]


def test_load_population(spark):
    rows = [("2024-01-05", "P", "1.0", 1), ("2024-01-04", "P", "1.0", 2), ("2024-01-10", "Q", "1.0", 3), ("2024-01-10", "P", "2.0", 4)]
    df = spark.createDataFrame(rows, "d string, product string, version string, android_board int").withColumn("crash_date", F.to_date("d")).withColumn("addons", F.struct(F.array(F.lit("a:1")).alias("list")))
    got = records.load_population(spark, df, "P", ["1.0"], 5, "2024-01-10", mobile_products=["Q"])
    assert "android_board" not in got.columns and [r.d for r in got.collect()] == ["2024-01-05"]
    assert dict(got.dtypes)["addons"] == "array<string>"
    mobile = records.load_population(spark, df, "Q", ["1.0"], 5, "2024-01-10", mobile_products=["Q"])
    assert [r.android_board for r in mobile.collect()] == [3]


def test_documents_are_typed_json(spark, tmp_path):
    import json

    schema = "population string, g string, items array<struct<key:string,value:string,vtype:string,family:string,name:string>>, count_reference bigint, count_group bigint, total_reference bigint, total_group bigint, chi2 double, phi double, prior struct<item:struct<key:string,value:string,vtype:string,family:string,name:string>,count_reference:bigint,count_group:bigint,total_reference:bigint,total_group:bigint>"
    rows = [
        ("c", "x", [("evil.x", "true", "bool", "addon", "evil.x")], 3, 9, 20, 10, 1.0, 1.0, (("k", None, "null", None, None), 1, 2, 3, 4)),
        ("c", "x", [("n", "12", "num", None, None), ('q"', "12", "str", None, None)], 3, 9, 20, 10, 1.0, 1.0, None),
    ]
    names = spark.createDataFrame([("evil.x", "Evil")], "id string, name string")
    labelled = reports.label_items(spark.createDataFrame(rows, schema), [addon_family()], names)
    totals = spark.createDataFrame([("c", "x", 10, 20), ("c", "empty", 5, 20)], "population string, g string, total_group bigint, total_reference bigint")
    lists = spark.createDataFrame([("c", "x", ["w1", "w2"])], "population string, g string, top_words array<string>")
    results.write_group_results(labelled, totals, str(tmp_path / "out"), lists)
    docs = {d["g"]: d for d in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect())}
    found = {json.dumps(r["item"], sort_keys=True): r for r in docs["x"]["results"]}
    assert found['{"Addon \\"Evil\\"": true}']["prior"] == {"item": {"k": None}, "count_reference": 1, "count_group": 2, "total_reference": 3, "total_group": 4}
    assert '{"n": 12, "q\\"": "12"}' in found
    assert docs["x"]["top_words"] == ["w1", "w2"] and docs["empty"]["results"] == []
    assert docs["x"]["key"] == "11f6ad8ec52a2984abaafd7c3b516503785c2072"
    report = reports.deviation_report(labelled).orderBy("line_no").collect()
    assert report[0].line == '(90.00% in x vs 15.00% overall) Addon "Evil"="True" [50.00% vs 33.33% given k="None"]'
    assert report[1].line == '(90.00% in x vs 15.00% overall) n="12" ∧ q"="12"'
    chart = reports.support_chart_table(labelled).orderBy("position").collect()
    assert chart[0].label == 'n="12" ∧ q"="12"'
    related = reports.addon_related_groups(labelled).collect()
    assert len(related) == 1 and related[0].total_group == 10 and len(related[0].addons) == 1


def test_word_queries_keep_differences_of_the_default(spark):
    """Items and pairs that differ by 0.15 to 0.4 are rules too, as in the SQL."""
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    columns = ["g", "item1", "item2", *queries.COUNTS, *queries.TOTALS]
    found = queries.find_deviations_families(spark, sf).select(columns).collect()
    assert any(0.15 < abs(r.count_group / r.total_group - r.count_reference / r.total_reference) < 0.4 for r in found)
    con = duckdb.connect()
    for name in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL['find_deviations_families']})").fetchall()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_pattern_index_of_a_large_dictionary(spark):
    rng = random.Random(9)
    letters = "abcdeé \n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 80, 900]))) for _ in range(160)] + [None, "", "ab", "a" * 2000]
    strings = {"".join(rng.choice(letters) for _ in range(rng.choice([3, 4, 5, 6, 9, 12]))) for _ in range(50_000)}
    strings |= {"a", "é", "ab", " \n", "zz", "a" * 700, texts[5][:300] or "x", "(.*)", "\\d+"} | {t[i : i + 20] for t in texts if t for i in range(0, len(t), 300)}
    rows = [(rng.choice("xy"), t) for t in texts]
    df = spark.createDataFrame([(i, g, t, "clash", 0) for i, (g, t) in enumerate(rows)], "id int, g string, text string, pattern string, `row` int")
    dictionary = spark.createDataFrame([(s,) for s in sorted(strings)] + [("ab",), (None,)], "pattern string")
    hits = [(g, s) for g, t in rows if t is not None for s in strings if s in t]
    counts = patterns.pattern_counts(groups.with_population(df), "text", dictionary)
    own, total = collections.Counter(hits), collections.Counter(s for _, s in hits)
    assert {(r.g, r.member): (r.count_group, r.count_reference) for r in counts.collect()} == {k: (n, total[k[1]]) for k, n in own.items()}
    few = spark.createDataFrame([("",), ("ab",), ("a" * 700,)], "pattern string")
    found = patterns.with_pattern_members(df, "text", few, "members")
    assert found.columns == [*df.columns, "members"]
    want = {i: None if t is None else sorted(s for s in ("", "ab", "a" * 700) if s in t) for i, (_, t) in enumerate(rows)}
    assert {r.id: r.members for r in found.collect()} == want
    none = patterns.with_pattern_members(df, "text", few.limit(0), "members").where("size(members) > 0")
    assert none.count() == 0
    family = listed_family("members", "note", '"%s"')
    tagged, families = derive_features(groups.with_population(found).drop("id", "row", "pattern"), FeatureSet(families=(family,), drop=("text", "members")))
    counted = items.item_counts(tagged, Layout.of(tagged, families))
    expected = collections.Counter((g, s) for g, t in rows if t is not None for s in ("", "ab", "a" * 700) if s in t)
    assert {(r.g, r.name): r.count_group for r in counted.collect()} == dict(expected)


def test_patterns_of_all_lengths_are_found_by_their_own_bytes(spark, monkeypatch):
    monkeypatch.setattr(patterns, "SLICE", 64)
    monkeypatch.setattr(patterns, "BLOCK", 16)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé\0€𝄞") for _ in range(n)) for n in (0, 1, 7, 20, 40, 300, 300)] * 2 + ["a" * 500, None, ""]
    strings = {t[i : i + n] for t in texts if t for n in (1, 2, 3, 4, 5, 8, 9, 12, 15, 16, 17, 18, 40, 200) for i in range(0, len(t), 37)}
    strings |= {"", "a" * 16, "a" * 17, "a" * 400, "a" * 501, "b" * 16, "b" * 17, "ab\0", "€" * 6}
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    dictionary = spark.createDataFrame([(x,) for x in sorted(strings)] * 2, "pattern string")
    hits = patterns.pattern_hits(rows, "text", dictionary, ["row"])
    want = sorted((i, x) for i, t in enumerate(texts) if t is not None for x in strings if x in t)
    assert sorted(map(tuple, hits.collect())) == want
    # a text is not repeated for each of its parts
    assert "Generate" not in hits._jdf.queryExecution().toString()


def test_ranks_and_row_numbers(spark):
    rng = random.Random(4)
    pairs_ = {(rng.choice(["a", "b", None]), rng.choice([None, *map(str, range(400))])) for _ in range(900)}
    df = spark.createDataFrame(sorted(pairs_, key=repr), "scope string, value string").repartition(7)
    want = {}
    for scope in ("a", "b", None):
        own = sorted((v for s, v in pairs_ if s == scope), key=lambda v: (v is not None, v or ""))
        want |= {(scope, v): i for i, v in enumerate(own, 1)}
    for n in ("2", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert {(r.scope, r.value): r.rank for r in numbering.rank_within(df, ["scope"], ["value"], "rank").collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert numbering.rank_within(df.limit(0), ["scope"], ["value"], "rank").count() == 0
    one, other = (numbering.with_row_number(x, "n") for x in (df, df.orderBy("value").repartition(7, "scope", "value")))
    assert one.select("n").distinct().count() == other.select("n").distinct().count() == len(pairs_)


def test_records_count_once_in_the_job(spark):
    rng = random.Random(6)
    rows = [(rng.choice("xy"), rng.choice(["u1", "u2", "u3", None]), [m for m in "abc" if rng.random() < 0.5] * 2, rng.choice("pq")) for _ in range(60)]
    df = groups.with_population(spark.createDataFrame(rows, "g string, id string, modules array<string>, kind string"))
    features = FeatureSet(families=(module_family(F.col("modules"), ("modules",), record_id="id"),), drop=("modules", "id"))
    tagged, families = derive_features(df, features)
    got = {(r.g, r.key, r.value): r.count_group for r in items.item_counts(tagged, Layout.of(tagged, families)).collect()}
    want = collections.Counter((g, "kind", k) for g, _, _, k in rows)
    seen = {(g, i, m) for g, i, ms, _ in rows for m in ms if i is not None}
    want += collections.Counter((g, m, "true") for g, _, m in seen)
    want += collections.Counter((g, m, "true") for g, i, ms, _ in rows for m in set(ms) if i is None)
    assert got == dict(want)
    alone = discovery.module_counts(df.where("id is not null"), features.families[0], record_id="id").collect()
    assert {(r.g, r.member): r.count_group for r in alone} == dict(collections.Counter((g, m) for g, _, m in seen))


def test_only_records_of_different_rows_are_told_apart(spark):
    rows = [("x", "u1", ["a", "b"]), ("x", "u1", ["a", "b"]), ("x", "u2", ["a"]), ("x", "u2", ["a", "c"]), ("y", "u2", ["a"])]
    rows += [(None, "u3", ["a"]), ("x", "u4", []), ("x", None, ["a"]), ("x", None, ["a"]), (None, None, None)]
    df = spark.createDataFrame([("all", *r) for r in rows], "population string, g string, id string, `@module` array<string>")
    slot = items.Slot(3, "members", "@module", "bool", "module", None, "id")
    alone, told = ([(r.g, r.record, r.m3) for r in x.collect()] for x in items._record_rows(df, [slot], "id"))
    assert sorted(told, key=repr) == [("x", "u2", ["a", "c"]), ("x", "u2", ["a"])]
    want = [("x", "u1", ["a", "b"]), ("y", "u2", ["a"]), (None, "u3", ["a"]), ("x", "u4", []), ("x", None, ["a"]), ("x", None, ["a"]), (None, None, None)]
    assert sorted(alone, key=repr) == sorted(want, key=repr)
    counts = {(r.g, r.name): r.count_group for r in items.item_counts(df, items.Layout((slot,), ())).collect()}
    assert counts == {("x", "a"): 4, ("x", "b"): 1, ("x", "c"): 1, ("y", "a"): 1}


@pytest.mark.parametrize("overlapping", [False, True])
def test_bitmaps_against_enumeration(spark, monkeypatch, overlapping):
    rng = random.Random(12)
    rows = [(rng.choice(["p", "q"]), rng.choice(["x", "y", None]), sorted({rng.randrange(40) for _ in range(rng.randrange(12))} | ({99} if i % 50 else set()))) for i in range(700)]
    wanted = {(p, g, lo, hi) for p in "pq" for g in "xy" for lo in (0, 3, 7, 99) for hi in range(40) if rng.random() < 0.6}
    wanted = {(p, g, min(a, b), max(a, b)) for p, g, a, b in wanted if a != b} | {("p", "x", 500, 501), ("none", "x", 1, 2)}
    own, total = collections.Counter(), collections.Counter()
    for p, g, ids in rows:
        for lo, hi in itertools.combinations(ids, 2):
            if (p, g, lo, hi) in wanted:
                own[p, g, lo, hi] += 1
            if g is None or not overlapping:
                total[p, lo, hi] += 1
    total = {k: n for k, n in total.items() if k in {(p, lo, hi) for p, _, lo, hi in wanted}}
    occurrences = [(p, g, 1000 * (i // 300) + i, item) for i, (p, g, ids) in enumerate(rows) for item in ids]
    rng.shuffle(occurrences)
    df = spark.createDataFrame(occurrences, "population string, g string, `row` long, item_id long")
    candidates = spark.createDataFrame(sorted(wanted), "population string, g string, lo long, hi long")
    for held, bits in ((1 << 20, 15), (150, 7)):
        monkeypatch.setattr(bitmaps, "HELD", held)
        monkeypatch.setattr(bitmaps, "BLOCK_BITS", bits)
        got = bitmaps.count_pairs(bitmaps.row_bitmaps(df), candidates, overlapping).collect()
        assert {(r.population, r.g, r.lo, r.hi): r.n for r in got if not r.reference} == dict(own)
        assert {(r.population, r.lo, r.hi): r.n for r in got if r.reference} == total


def test_sparse_zero_fill(spark):
    ref = spark.createDataFrame([("a", None, 9), ("a", "1", 2), ("b", "2", 7)], "key string, value string, count_reference bigint")
    own = spark.createDataFrame([("a", None, "x", 4), ("b", "2", "y", 7)], "key string, value string, g string, count_group bigint")
    totals = spark.createDataFrame([("x", 5, 20), ("y", 8, 20)], "g string, total_group bigint, total_reference bigint")
    got = {tuple(r) for r in items.sparse_zero_fill(ref, own, ["key", "value"], totals, 0.4).collect()}
    assert got == {("a", None, "x", 4, 9), ("a", None, "y", 0, 9), ("b", "2", "y", 7, 7)}


def test_stems_of_expression_and_sql_agree(spark):
    """The column expression and the layers of SQL read the same tables but are written apart."""
    import duckdb

    from catalog.oracle import stems
    from contrastmill.functions.stemming import STEP2, STEP3, STEP4, WHOLE_WORDS, stem

    rng = random.Random(8)
    heads = ["relat", "hop", "hopp", "gener", "commun", "arsen", "y", "say", "boy", "cr", "tr", "e", "'a", "bee", "controll", "fluent", "éc", "ye", "skat"]
    tails = ["", "s", "'s", "'s'", "ies", "ied", "sses", "us", "ed", "eed", "eedly", "ingly", "ing", "y", "ly", "e", "ll", "ative", "ion", "sion", *STEP2, *STEP3, *STEP4]
    listed = {h + m + t for h in heads for m in ("", "iz", "at", "tt") for t in tails} | set(WHOLE_WORDS) | {"innings", "proceeds", "Exceed", "of", "I"}
    listed |= {"".join(rng.choice("aeiouybdlst'") for _ in range(rng.randrange(1, 9))) for _ in range(3000)}
    mine = {r.word: r.stem for r in spark.createDataFrame([(w,) for w in sorted(listed)], "word string").withColumn("stem", stem(F.col("word"))).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE vocabulary (word VARCHAR)")
    con.executemany("INSERT INTO vocabulary VALUES (?)", [(w,) for w in sorted(listed)])
    theirs = dict(con.execute(f"WITH {stems('vocabulary')} SELECT word, stem FROM stems").fetchall())
    assert {w: (mine[w], theirs[w]) for w in listed if mine[w] != theirs[w]} == {}


def test_result_files_are_stated_whole(spark, tmp_path):
    """The same text from differently dealt rows, a null prior included."""
    item = "struct<key:string,value:string,vtype:string,family:string,name:string,label:string>"
    figures = "count_group bigint, count_reference bigint, total_group bigint, total_reference bigint"
    prior = f"struct<item:{item},count_reference:bigint,count_group:bigint,total_reference:bigint,total_group:bigint>"
    def make(key, value, kind):
        return (key, value, kind, None, None, f"the {key}")
    a, b, c = make("a", "1", "num"), make("b", None, "null"), make("c", "x\"y", "str")
    found = [
        ("p", "g1", [a, b], 5, 6, 10, 100, None), ("p", "g1", [c], 5, 60, 10, 100, (a, 50, 4, 70, 9)), ("p", "g1", [a], 9, 10, 10, 100, None),
        ("p", "g1", [b], 5, 60, 10, 100, None), ("p", "g2", [make("b", "true", "bool")], 1, 2, 3, 4, None),
    ]
    schema = f"population string, g string, items array<{item}>, {figures}, prior {prior}"
    totals = spark.createDataFrame([("p", "g1", 10, 100), ("p", "g2", 3, 100), ("p", "g3", 8, 100)], "population string, g string, total_group bigint, total_reference bigint")
    texts = set()
    for turn in range(3):
        rules = spark.createDataFrame(found[turn:] + found[:turn], schema).repartition(turn + 1)
        path = str(tmp_path / f"out{turn}")
        results.write_group_results(rules, totals, path)
        texts.add(tuple(sorted(r.value for r in spark.read.text(path + "/population=p").collect())))
    (lines,) = texts
    docs = {d["g"]: d for d in map(json.loads, lines)}
    one = lambda i, **more: {"item": i, **more}
    assert docs["g1"]["results"] == [
        one({"the a": 1}, count_reference=10, count_group=9, prior=None),
        one({"the b": None}, count_reference=60, count_group=5, prior=None),
        one({"the c": 'x"y'}, count_reference=60, count_group=5,
            prior={"item": {"the a": 1}, "count_reference": 50, "count_group": 4, "total_reference": 70, "total_group": 9}),
        one({"the a": 1, "the b": None}, count_reference=6, count_group=5, prior=None),
    ]
    assert docs["g2"]["results"] == [one({"the b": True}, count_reference=2, count_group=1, prior=None)]
    assert docs["g3"]["results"] == [] and docs["g3"]["total"] == 8
