import random

import pytest
from brute import collected, deviations
from pyspark.sql import functions as F

from contrastmill import FeatureSet, Settings, find_deviations
from contrastmill.operators import bitmaps
from contrastmill.plans.crash_reports import MODULE_PARTNERS, PRIORS, crash_features

SCHEMA = """uuid string, signature string, product string, platform string, platform_version string,
platform_pretty_version string, adapter_vendor_id string, adapter_driver_version string, cpu_info string,
startup_crash boolean, submitted_from_infobar boolean, total_virtual_memory string, process_type string,
memory_ghost_windows bigint, flag string, addons array<string>, app_notes string, user_comments string,
json_dump struct<modules:struct<list:array<struct<element:struct<filename:string>>>>>"""

NOTES = ("D3D?", "D3D-", "D3D+", "WebGL+", "a.b?")
MODULES = ("kernel.dll", "nv.d.dll", "evil.dll", "gtk.so", "x.dll")
ADDONS = ("good@a.b", "evil.x", "{guid}")


def make_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        sig = rng.choices(["A", "B.c", "C", "tiny", "other", None], [3, 3, 2, 0.03, 4, 1])[0]
        win = rng.random() < (0.9 if sig == "A" else 0.5)
        platform = "Windows" if win else rng.choice(["Linux", "Mac OS X"])
        version = rng.choice(["6.1", "10.0"]) if win else rng.choice(["5.1 i686", "5.2 x86_64"])
        vendor = rng.choice(["0x8086", "0x10de", None]) if sig != "B.c" else rng.choice(["0x10de", "0x10de", "0x8086"])
        driver = {"0x8086": "8.15.10.2712", "0x10de": rng.choice(["8.15.11.8593", "8.17.11.9999"]), None: None}[vendor]
        startup = rng.choice([True, False, None]) if sig != "C" else rng.random() < 0.9
        addons = None
        if rng.random() < 0.9:
            addons = ["good@a.b:1.0"] if rng.random() < 0.6 else []
            if rng.random() < (0.8 if sig == "A" else 0.1):
                addons += [f"evil.x:{rng.choice(['1', '1', '1', '2:3'])}"]
            if rng.random() < 0.2:
                addons += ["{guid}:9", "broken"]
            if addons and rng.random() < 0.1:
                addons += [addons[0]]
        mods = None
        if rng.random() < 0.95:
            mods = [m for m in MODULES if rng.random() < (0.9 if m == "kernel.dll" else 0.85 if (m == "evil.dll" and sig == "B.c" and win) else 0.15)]
            mods = mods + mods[:1]
        text = None
        if rng.random() < 0.9:
            text = " ".join(x for x in ("D3D?", "D3D+", "WebGL+", "a.b?", "Has dual GPUs") if rng.random() < (0.8 if sig == "A" and x != "WebGL+" else 0.3))
        rows.append((
            f"u{i}", sig, "P", platform, version, version + "!", vendor, driver, rng.choice(["fam 6 | 4", "fam 6 | 1", "fam 7 | 2"]),
            startup, rng.choice([True, False, None]), rng.choice(["1000", "9999999999", None, "zz"]) if sig != "C" else "1000",
            rng.choice(["content", None]), rng.choice([0, 3, None]) if sig != "A" else rng.choice([3, 3, 0]),
            rng.choice(["1", None]), addons, text, "hm", None if mods is None else {"modules": {"list": [{"element": {"filename": m}} for m in mods]}},
        ))
    return rows


def vt(v):
    return "null" if v is None else "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "str"


def tx(v):
    return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def row_items(r, known_addons=None):
    d = dict(zip([p.split()[0] for p in SCHEMA.split(",")], r))
    flat = {k: d[k] for k in ("platform", "platform_version", "platform_pretty_version", "adapter_vendor_id", "adapter_driver_version", "startup_crash", "submitted_from_infobar", "process_type", "flag")}
    text = d["app_notes"]
    flat["has dual GPUs"] = None if text is None else "Has dual GPUs" in text
    m, pv = d["total_virtual_memory"], d["platform_version"]
    if m:
        flat["os_arch"] = ("x86" if int(m) < 2684354560 else "amd64") if m.isdigit() else "unknown"
    else:
        flat["os_arch"] = "amd64" if d["platform"] == "Mac OS X" or "x86_64" in pv else "x86" if "i686" in pv else None
    v = d["adapter_driver_version"]
    flat["adapter_driver_version_clean"] = None if v is None else v.split(".")[-1] if d["adapter_vendor_id"] == "0x8086" else v[-6:-5] + v[-4:-2] + "." + v[-2:]
    flat["CPU Info"], cores = d["cpu_info"].split(" | ")
    flat["Is Multicore"] = cores != "1"
    w = d["memory_ghost_windows"]
    flat["ghost_windows > 0"] = None if w is None else w > 0
    items = {(k, tx(x), vt(x), None) for k, x in flat.items()}
    listed = {}
    for a in d["addons"] or []:
        if ":" in a:
            listed.setdefault(a.split(":")[0], a.split(":", 1)[1])
    if known_addons is None:
        for a, ver in listed.items():
            items |= {(a, "true", "bool", "addon"), (a + "-version", ver, "str", "addon-version")}
    else:
        for a in known_addons:
            items.add((a, tx(a in listed), "bool", "addon"))
            ver = None if d["addons"] is None else listed.get(a, "Not installed")
            items.add((a + "-version", ver, vt(ver), "addon-version"))
    if d["json_dump"]:
        items |= {(e["element"]["filename"], "true", "bool", "module") for e in d["json_dump"]["modules"]["list"]}
    items |= {(p, "true", "bool", "app_note") for p in NOTES if text is not None and p in text}
    return items


EDGES = [(a, b) for a, bs in PRIORS.items() for b in bs]
RULES = dict(
    edges=EDGES, discovered=("addon", "module", "app_note"), own_only=("module",), versions=("addon-version",),
    restricted={"module": MODULE_PARTNERS}, only_true=("submitted_from_infobar",),
)


def same(got, want):
    want = {g: r for g, r in want.items() if r}
    assert set(got) == set(want)
    for g in want:
        assert set(got[g]) == set(want[g]), (g, set(got[g]) ^ set(want[g]))
        for k in want[g]:
            assert got[g][k] == want[g][k], (g, k)


@pytest.fixture(scope="module")
def crashes(spark):
    rows = make_rows(3, 900)
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_equality_groups(crashes):
    rows, df = crashes
    names = ["A", "B.c", "C", "tiny", "absent"]
    found = find_deviations(df, group_column="signature", names=names, features=crash_features(NOTES))
    brute_rows = [((r[1],) if r[1] in names else (), 1, row_items(r)) for r in rows]
    want = deviations(brute_rows, **RULES)
    got = collected(found.rules)
    same(got, want)
    assert sum(len(k) == 2 for g in got.values() for k in g) > 0
    assert any(v[2] for g in got.values() for v in g.values())
    assert {i[3] for g in got.values() for k in g for i in k} >= {"addon", "module", "app_note", None}
    sizes = {r["g"]: (r["total_group"], r["total_reference"]) for r in found.totals.collect()}
    assert sizes == {n: (sum(r[1] == n for r in rows), len(rows)) for n in ("A", "B.c", "C")}
    assert [r["g"] for r in found.skipped.collect()] == ["tiny"]


def test_result_does_not_depend_on_blocks_or_partitioning(crashes, monkeypatch):
    rows, df = crashes
    names = ["A", "B.c", "C", "tiny"]
    plain = collected(find_deviations(df, group_column="signature", names=names, features=crash_features(NOTES)).rules)
    monkeypatch.setattr(bitmaps, "HELD", 100)
    monkeypatch.setattr(bitmaps, "BLOCK_BITS", 6)
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shuffled = df.orderBy(F.rand(7)).repartition(5)
    other = find_deviations(shuffled, group_column="signature", names=list(reversed(names)), features=crash_features(NOTES))
    try:
        assert collected(other.rules) == plain
    finally:
        df.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lower_threshold_and_known_addons(crashes):
    rows, df = crashes
    names = ["A", "B.c", "C"]
    features = crash_features(NOTES, known_addons=ADDONS)
    found = find_deviations(df, group_column="signature", names=names, features=features, settings=Settings(min_support_diff=0.05))
    brute_rows = [((r[1],) if r[1] in names else (), 1, row_items(r, ADDONS)) for r in rows]
    want = deviations(brute_rows, s=0.05, **{**RULES, "discovered": ("module", "app_note")})
    same(collected(found.rules), want)


def test_constant_column_adds_no_rule(crashes):
    _, df = crashes
    few = df.select("signature", "platform", "flag", "startup_crash")
    names = ["A", "B.c", "C"]
    plain = collected(find_deviations(few, group_column="signature", names=names).rules)
    more = collected(find_deviations(few.withColumn("same", F.lit("x")), group_column="signature", names=names).rules)
    assert plain and {(g, k) for g in more for k in more[g]} <= {(g, k) for g in plain for k in plain[g]}


def test_all_values_as_groups(crashes):
    rows, df = crashes
    few = df.select("signature", "platform", "flag", "startup_crash")
    found = find_deviations(few, group_column="signature")
    brute_rows = [
        ((r[1],) if r[1] else (), 1, {("platform", r[3], "str", None), ("flag", r[14], vt(r[14]), None), ("startup_crash", tx(r[9]), vt(r[9]), None)})
        for r in rows
    ]
    same(collected(found.rules), deviations(brute_rows))


def test_overlapping_predicate_groups(crashes):
    rows, df = crashes
    tests = {"a or b": F.col("signature").isin("A", "B.c"), "b": F.col("signature").startswith("B"), "none": F.lit(False)}
    found = find_deviations(df, predicates=tests, features=crash_features(NOTES))
    brute_rows = [(tuple(n for n, hit in (("a or b", r[1] in ("A", "B.c")), ("b", r[1] == "B.c")) if hit), 1, row_items(r)) for r in rows]
    same(collected(found.rules), deviations(brute_rows, **RULES))


def test_foreign_populations(spark, crashes):
    rows, df = crashes
    more = make_rows(11, 400)
    other = spark.createDataFrame(more, SCHEMA).where("signature = 'A' or signature = 'C'")
    reference = df.where("signature is null or signature <> 'A'")
    found = find_deviations(reference, others={"later": other}, features=crash_features(NOTES))
    brute_rows = [((), 1, row_items(r)) for r in rows if r[1] != "A"]
    brute_rows += [(("later",), 0, row_items(r)) for r in more if r[1] in ("A", "C")]
    same(collected(found.rules), deviations(brute_rows, **RULES))


def test_empty_and_unusable_input(spark, crashes):
    _, df = crashes
    none = find_deviations(df, group_column="signature", names=["absent"], features=crash_features(NOTES))
    assert none.rules.count() == 0 and none.totals.count() == 0
    with pytest.raises(TypeError, match="addons"):
        find_deviations(df.select("signature", "addons"), group_column="signature", features=FeatureSet())
    with pytest.raises(ValueError):
        find_deviations(df)
