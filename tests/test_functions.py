import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from contrastmill.functions import scalars, stats
from contrastmill.functions.stemming import stem
from contrastmill.operators import reports


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_chi2_pvalue_phi(spark):
    rows = [(40, 60, 50, 200), (10, 60, 50, 200), (15, 60, 50, 200), (0, 0, 50, 200)]
    df = table(spark, rows, "a long, b long, g long, r long")
    chi2 = stats.rule_chi2(F.col("a"), F.col("b"), F.col("g"), F.col("r"))
    out = df.select(
        chi2.alias("x"), stats.chi2_pvalue(chi2).alias("p"), stats.phi_coefficient(chi2, F.col("g"), F.col("r")).alias("phi")
    ).collect()
    assert out[0].x == pytest.approx(39.609375)
    assert out[0].p == pytest.approx(3.1019064e-10, rel=1e-6)
    assert out[0].phi == pytest.approx(0.398042, abs=1e-6)
    assert (round(out[1].x, 6), round(out[1].p, 6), round(out[1].phi, 6)) == (1.519097, 0.217756, 0.077951)
    assert (out[2].x, out[2].p, out[2].phi) == (0, 1, 0)
    assert out[3].x is None and out[3].p is None


def test_erfc_everywhere(spark):
    values = [i / 50 for i in range(0, 500)] + [1.999999, 2.0, 2.000001, 20.0, 40.0]
    out = table(spark, [(v,) for v in values], "z double").select("z", stats.erfc(F.col("z")).alias("p")).collect()
    for row in out:
        assert row.p == pytest.approx(math.erfc(row.z), rel=1e-10, abs=1e-300)


def brute_fisher(a, b, c, d):
    r, k, n = a + b, a + c, a + b + c + d
    weight = {x: math.comb(r, x) * math.comb(n - r, k - x) for x in range(max(0, r + k - n), min(r, k) + 1)}
    return float(Fraction(sum(w for w in weight.values() if w <= weight[a]), math.comb(n, k)))


def test_fisher_against_fractions(spark):
    import random

    rng = random.Random(5)
    cells = [tuple(rng.randrange(0, 40) for _ in range(4)) for _ in range(300)]
    cells += [(0, 0, 0, 0), (5, 0, 0, 5), (1, 0, 0, 0), (300, 250, 200, 330)]
    df = table(spark, cells, "a long, b long, c long, d long")
    cols = [F.col(x) for x in "abcd"]
    levels = [0.9, 0.05, 1e-3, 1e-6]
    tests = [stats.fisher_at_most(*cols, F.lit(x)).alias(f"at_{i}") for i, x in enumerate(levels)]
    for row in df.select(*cols, stats.fisher_exact(*cols).alias("p"), *tests).collect():
        want = brute_fisher(row.a, row.b, row.c, row.d)
        assert row.p == pytest.approx(want, rel=1e-7), row
        assert [row[f"at_{i}"] for i in range(len(levels))] == [want <= x for x in levels], row


def test_fisher_tables_and_large_margins(spark):
    df = table(spark, [(20, 30, 25, 50), (200_000_000, 450_000_000, 430_000_000, 1_000_000_000)], "ab long, a long, b long, n long")
    cols = [F.col(x) for x in ("ab", "a", "b", "n")]
    out = df.select(
        stats.fisher_exact(*stats.interaction_cells(*cols)).alias("s"),
        stats.fisher_exact(*stats.interaction_cells(*cols, table="contingency")).alias("c"),
    ).collect()
    assert out[0].s == pytest.approx(0.682652, abs=1e-6)
    assert out[0].c == pytest.approx(0.008579, abs=1e-6)
    assert 0 <= out[1].c < 1e-6


def ratio_fisher(a, b, c, d, spread=45.0):
    """Chances relative to the mode by ratios of neighbours, as far as they count."""
    r, k, n = a + b, a + c, a + b + c + d
    low, high = max(0, r + k - n), min(r, k)
    mode = min(max((r + 1) * (k + 1) // (n + 2), low), high)
    weight, all_ = {mode: 1.0}, 1.0
    for step in (1, -1):
        x, w = mode, 1.0
        while low <= x + step <= high and w > 1e-40:
            w *= (r - x) * (k - x) / ((x + 1) * (n - r - k + x + 1)) if step > 0 else x * (n - r - k + x) / ((r - x + 1) * (k - x + 1))
            x += step
            weight[x] = w
            all_ += w
    seen = weight.get(a)
    return 0.0 if seen is None else sum(sorted(w for w in weight.values() if w <= seen * (1 + 1e-7))) / math.fsum(weight.values())


def test_fisher_of_a_thousand_million(spark):
    """Margins up to 1e9: rare cells against exact fractions, broad distributions against ratios."""
    rare = [(a, 20 - a, c, 10**9 - 20 - c) for a in (0, 1, 3, 9) for c in (0, 5, 40)]
    rare += [(2, 10**9 - 300, 7, 12), (5, 3, 10**9 - 400, 30)]
    broad = [(250_010_000 + i, 249_990_000, 249_990_000, 250_010_000) for i in (-9_000, 0, 3_000, -20_000)]
    broad += [(1_000, 999_000, 998_400, 997_001_600), (30_500, 469_500, 60_000_000, 939_470_000), (7, 1_000_000, 6_999_000, 992_000_993)]
    df = table(spark, rare + broad, "a long, b long, c long, d long")
    got = {tuple(r)[:4]: r.p for r in df.withColumn("p", stats.fisher_exact(*(F.col(x) for x in "abcd"))).collect()}
    for cells in rare:
        a, b, c, d = cells
        small = min(a + b, a + c, c + d, b + d)
        rows = [a, b, c, d] if small == a + b else [a, c, b, d] if small == a + c else [c, d, a, b] if small == c + d else [b, d, a, c]
        assert got[cells] == pytest.approx(brute_fisher(*rows), rel=1e-9), cells
    for cells in broad:
        assert got[cells] == pytest.approx(ratio_fisher(*cells), rel=1e-6, abs=1e-15), cells
    nulls = table(spark, [(None, 1, 2, 3), (1, -1, 2, 3)], "a long, b long, c long, d long")
    assert [r.p for r in nulls.select(stats.fisher_exact(*(F.col(x) for x in "abcd")).alias("p")).collect()] == [None, None]


def test_driver_version(spark):
    rows = [
        ("0x8086", "8.15.10.2712", "2712"), ("0x10de", "8.15.11.8593", "185.93"), ("0x10de", "93", ".93"),
        ("8086", "nodots", "nodots"), ("0x1002", "8.17.10.1404", "8.17.10.1404"), ("0x10de", None, None),
        ("10de", "", ""), ("0x10de", "12345", "23.45"), ("0x10de", "123", "1.23"), (None, "1.2", "1.2"),
    ]
    df = table(spark, rows, "v string, d string, want string")
    for row in df.withColumn("got", scalars.driver_version_clean(F.col("v"), F.col("d"))).collect():
        assert row.got == row.want, row


def test_os_arch(spark):
    rows = [
        ("2684354559", "Linux", "", "x86"), ("2684354560", "Linux", "", "amd64"), ("abc", "Linux", "", "unknown"),
        ("1.5", "Linux", "", "unknown"), ("0", "Linux", "", "x86"), ("99999999999999999999999", "x", "", "amd64"),
        (None, "Mac OS X", None, "amd64"), (None, "Linux", "5.1 i686 GNU", "x86"),
        ("", "Linux", "5.1 x86_64 GNU", "amd64"), (None, "Linux", None, None), (None, "Windows", "10", None),
    ]
    df = table(spark, rows, "m string, p string, v string, want string")
    for row in df.withColumn("got", scalars.os_arch(F.col("m"), F.col("p"), F.col("v"))).collect():
        assert row.got == row.want, row
    numbers = table(spark, [(0, "x86_64"), (5, "x86_64")], "m long, v string")
    got = numbers.select(scalars.os_arch(F.col("m"), F.lit("Linux"), F.col("v"), memory_is_text=False).alias("a")).collect()
    assert [r.a for r in got] == ["amd64", "x86"]


def test_cpu_and_flags(spark):
    df = table(spark, [("fam 6 | 4", 3), ("fam 6 | 1", 0), (None, None)], "c string, n int")
    out = df.select(
        scalars.cpu_info(F.col("c")).alias("i"), scalars.is_multicore(F.col("c")).alias("m"),
        scalars.positive_flag(F.col("n")).alias("p"), scalars.not_null_flag(F.col("c")).alias("k"),
        scalars.contains_text(F.col("c"), "| 4").alias("t"),
    ).collect()
    assert [tuple(r) for r in out] == [
        ("fam 6", True, True, True, True), ("fam 6", False, False, True, False), (None, None, None, False, None),
    ]


def test_addons(spark):
    df = table(spark, [(["a.b:1:2"],), (["x:1"],), (["a.b"],), (None,), (["a.b:2", "a.b:1"],)], "a array<string>")
    out = df.select(scalars.addon_presence(F.col("a"), "a.b").alias("p"), scalars.addon_version(F.col("a"), "a.b").alias("v")).collect()
    assert [tuple(r) for r in out] == [
        (True, "1:2"), (False, "Not installed"), (False, "Not installed"), (False, None), (True, "2"),
    ]


def test_build_cut(spark):
    df = table(spark, [("20160712001",), ("20160713",), ("20160801",)], "b string")
    out = df.select(
        scalars.build_before(F.col("b"), "20160713").alias("x"),
        scalars.build_before(F.col("b"), "20160713", componentwise=True).alias("y"),
    ).collect()
    assert [tuple(r) for r in out] == [(True, True), (False, False), (False, True)]


STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign",
    "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist",
    "consistently": "consist", "consolation": "consol", "consolations": "consol", "console": "consol",
    "knack": "knack", "knackeries": "knackeri", "knavery": "knaveri", "knaves": "knave",
    "kneeled": "kneel", "knightly": "knight", "knitting": "knit", "knives": "knive",
    "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi",
    "hopping": "hop", "hoped": "hope", "luxuriated": "luxuri", "by": "by", "say": "say", "cry": "cri",
    "crying": "cri", "generate": "generat", "generous": "generous", "communism": "communism",
    "skies": "sky", "dying": "die", "news": "news", "inning": "inning", "innings": "inning",
    "succeed": "succeed", "agreed": "agre", "feed": "feed", "sensational": "sensat", "relational": "relat",
    "conditional": "condit", "hopefulness": "hope", "geology": "geolog", "national": "nation",
    "adoption": "adopt", "controlling": "control", "controller": "control", "yellow": "yellow",
    "youth": "youth", "boy's": "boy", "word.": "word.", "running.": "running.", "crashes": "crash",
    "crashing": "crash", "happily": "happili", "easily": "easili", "bed": "bed", "shed": "shed",
    "replacement": "replac", "probate": "probat", "rate": "rate", "cease": "ceas", "fall": "fall",
    "is": "is", "the": "the", "was": "was", "this": "this", "": "", "s": "s", "'": "'",
}


def test_stems(spark):
    df = table(spark, [(w, s) for w, s in STEMS.items()], "w string, want string")
    wrong = [(r.w, r.got, r.want) for r in df.withColumn("got", stem(F.col("w"))).where("got is not null").collect() if r.got != r.want]
    assert not wrong


def test_percentages_round_by_the_exact_value(spark):
    shares = [k / 4000 for k in range(4001)] + [k / 97 for k in range(98)] + [0.00005, 0.0000499999]
    out = table(spark, [(v,) for v in shares], "x double").select(
        "x", reports.percentage(F.col("x")).alias("text"), reports.hundredths(F.col("x")).alias("n")
    )
    for row in out.collect():
        text = f"{row.x * 100:.2f}"
        assert row.text == ("100.0" if text == "100.00" else text.rjust(5, "0"))
        assert row.n == round(round(row.x, 2) * 100)


def test_stems_of_batches_equal_those_of_the_expression(spark):
    import random

    from contrastmill.functions.stemming import _ENDS2, _ENDS3, _ENDS4, _PAST, WHOLE_WORDS, stem_expression

    draw = random.Random(8)
    ends = (*_PAST, *_ENDS2, *_ENDS3, *_ENDS4, "s", "'s", "'s'", "'", "ies", "ied", "sses", "us", "ss", "y", "e", "ll", "")
    starts = ("gener", "commun", "arsen", "y", "'", "inn", "")
    made = {
        draw.choice(starts) + "".join(draw.choice("aeiouybdlstY'") for _ in range(draw.randint(0, 5))) + draw.choice(ends) + draw.choice(ends)
        for _ in range(6000)
    }
    made |= {*WHOLE_WORDS, "", "é", "ÉTÉS", "running ", "hops\n", "\U0001d4b6ying", "日本語ing", "proceeds", "inning's", "a.b", "''"}
    df = spark.createDataFrame([(w,) for w in sorted(made)] + [(None,)], "w string")
    both = df.select("w", stem(F.col("w")).alias("got"), stem_expression(F.col("w")).alias("want")).collect()
    assert [r for r in both if r.got != r.want] == []


def test_words_are_stemmed_once_and_in_batches(spark):
    from contrastmill.operators.words import clean_words

    counts = spark.createDataFrame([("p", "g", "running.", 2), ("p", "g", "runs", 1), ("p", "g", "...", 4)], "population string, g string, word string, tf long")
    found = clean_words(counts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "transform(" not in plan.split("ArrowEvalPython")[0].split("HashAggregate")[0]
    assert {(r.word, r.tf) for r in found.collect()} == {("running", 2), ("run", 1)}


def test_versions_of_addons_are_sorted_without_a_function(spark):
    from contrastmill.operators.features import addon_family

    listed = ["b:2", "a:1", "x", "a:1", "b:1", "a:0:5", ":", "b:2", None]
    df = spark.createDataFrame([(1, listed), (2, []), (3, None)], "i int, addons array<string>")
    found = df.select("i", addon_family("addons").versions().alias("v"))
    assert "array_sort(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.i: None if r.v is None else [tuple(x) for x in r.v] for r in found.collect()}
    assert got == {1: [("", ""), ("a", "1"), ("b", "2")], 2: [], 3: None}
