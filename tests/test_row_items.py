import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contrastmill.operators import bitmaps, groups, items, pairs, pruning, row_items
from contrastmill.operators.features import FeatureSet, addon_family, derive_features, module_family
from contrastmill.operators.items import Layout

WORDS = ["a:1", "a:2", "a:", "a", ":", ":x", "b:1:2", "é:ß", "é:𝄞", "", None, "b:1", "long name:" + "v" * 40]


def odd_rows(n=150, seed=3):
    rng = random.Random(seed)
    rows = [
        (rng.choice("pq"), rng.choice(["x", "y", "z", None]), rng.choice(["1", "2", None]),
         None if rng.random() < 0.1 else [rng.choice(WORDS) for _ in range(rng.randrange(9))],
         None if rng.random() < 0.1 else [rng.choice(["m", "n", "", "é", None]) for _ in range(rng.randrange(5))])
        for _ in range(n)
    ]
    return rows + [("p", "x", None, None, None), ("p", None, "1", [], [])]


def prepared(spark, rows):
    df = spark.createDataFrame(rows, "population string, g string, kind string, addons array<string>, modules array<string>")
    features = FeatureSet(families=(addon_family(), module_family(F.col("modules"), ("modules",))), drop=("addons", "modules"))
    tagged, families = derive_features(df.repartition(3), features)
    return tagged, Layout.of(tagged, families)


def row_of(kind, addons, modules):
    """The items of a row, as ``key, value, family``."""
    first = {}
    for e in addons or []:
        if e is not None and ":" in e:
            name, value = e.split(":", 1)
            first.setdefault(name, value)
    found = {("kind", kind, None)} | {(m, "true", "module") for m in modules or [] if m is not None}
    found |= {(a, "true", "addon") for a in first} | {(f"{a}-version", v, "addon-version") for a, v in first.items()}
    return found


@pytest.mark.parametrize("many", [False, True])
def test_items_of_lists_are_counted_in_batches(spark, many):
    rows = odd_rows()
    tagged, layout = prepared(spark, rows)
    plan = items._row_counts(tagged, layout)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "sort_array(" not in plan
    own, total = collections.Counter(), collections.Counter()
    for p, g, *rest in rows:
        for item in row_of(*rest):
            total[p, item] += 1
            own[p, item, g] += g is not None
    got = items.item_counts(tagged, layout, many_groups=many).collect()
    assert len(got) == len({(r.population, r.g, r.kid, r.name, r.value) for r in got})
    want = {(p, g, *item): (n, total[p, item]) for (p, item, g), n in own.items() if n}
    assert {(r.population, r.g, r.key, r.value, r.family): (r.count_group, r.count_reference) for r in got} == want


@pytest.mark.parametrize("most", [1 << 17, 0])
def test_known_items_find_their_rows(spark, monkeypatch, most):
    monkeypatch.setattr(pairs, "SENT_ITEMS", most)
    rows = odd_rows(seed=8)
    tagged, layout = prepared(spark, rows)
    counts = items.item_counts(tagged, layout, many_groups=True).where("count_reference % 3 <> 1 or value is null")
    level1 = items.with_item_ids(counts).cache()
    found = pairs.occurrences(tagged, layout, level1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("MapInArrow" in plan) == (most > 0) == ("inline(" not in plan)
    assert ("items" in found.columns) == (most > 0)
    ids = {(r.key, r.value, r.family): r.item_id for r in level1.collect()}
    of_row = collections.defaultdict(list)
    for r in found.collect():
        of_row[r.population, r.g, r.row] += r.items if most else [r.item_id]
    got = collections.Counter((p, g, tuple(sorted(own))) for (p, g, _), own in of_row.items())
    listed = [(p, g, tuple(sorted(ids[i] for i in row_of(*rest) if i in ids))) for p, g, *rest in rows]
    assert got == collections.Counter(x for x in listed if x[2])


def test_first_of_each_name_without_room_in_a_number():
    rng = np.random.default_rng(1)
    row, name = np.sort(rng.integers(0, 50, 400)), rng.integers(0, 30, 400)
    small, large = (row_items._first_of_each(row * f, name, 30) for f in (1, 1 << 50))
    first = {}
    for i, key in enumerate(zip(row.tolist(), name.tolist())):
        first.setdefault(key, i)
    assert sorted(small.tolist()) == sorted(large.tolist()) == sorted(first.values())


def test_only_items_that_can_pass_get_a_reference_count(spark):
    rng = random.Random(2)
    rows = [("p", rng.choice(["x", "x", "y", "z", None]), rng.choice("ab"), [f"w{int(rng.random() ** 3 * 60)}:1" for _ in range(6)], []) for _ in range(300)]
    rows += [("p", "tiny", "a", ["rare:1"], []), ("q", None, "a", ["w0:1"], []), ("q", "x", "b", ["w1:1"], [])]
    tagged, layout = prepared(spark, rows)
    totals = groups.group_totals(tagged)
    counts = {s: items.item_counts(tagged, layout, many_groups=True, least=s and groups.support_bounds(totals, s)) for s in (None, 0.2)}
    passed = {}
    for s, c in counts.items():
        kept = pruning.prune_support(items.grouped_support(c, totals), 0.2, 2)
        passed[s] = {tuple(r) for r in kept.select("population", "g", "key", "value", "count_group", "count_reference").collect()}
    assert passed[None] == passed[0.2] and len(passed[None]) > 5
    assert counts[0.2].count() < counts[None].count()
    bound = {(r.population, r.g): r.least for r in groups.support_bounds(totals, 0.2).collect()}
    assert bound["q", None] == pytest.approx(0.2) and bound["p", "tiny"] == pytest.approx(0.2)


def test_bitmaps_of_lists_and_of_single_occurrences_agree(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(rng.choice("pq"), rng.choice(["x", None]), i, sorted({(rng.randrange(5) << 32) + rng.randrange(9) for _ in range(rng.randrange(7))})) for i in range(300)]
    lists = spark.createDataFrame(rows, "population string, g string, `row` long, items array<long>").repartition(2)
    single = lists.select("population", "g", "row", F.explode("items").alias("item_id"))
    monkeypatch.setattr(bitmaps, "BLOCK_BITS", 6)
    found = []
    for df, held in ((single, 1 << 20), (lists, 1 << 20), (lists, 10)):
        monkeypatch.setattr(bitmaps, "HELD", held)
        held_by = collections.defaultdict(set)
        for r in bitmaps.row_bitmaps(df).collect():
            places = np.frombuffer(r.places, "<u2").tolist() + np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")).tolist()
            held_by[r.population, r.block, r.item_id, r.is_group, r.g] |= set(places)
        found.append(dict(held_by))
    want = collections.defaultdict(set)
    for p, g, i, own in rows:
        for item in own:
            want[p, i >> 6, item, False, None].add(i & 63)
            want[p, i >> 6, None, True, g].add(i & 63)
    assert found == [dict(want)] * 3


def test_segments_of_any_range():
    rng = np.random.default_rng(4)
    near, place = rng.integers(0, 6, 500), rng.integers(0, 40, 500)
    far = np.array([-(1 << 60), 0, 5, 1 << 61, 7, 8])[near]
    (a,), begin, places = bitmaps._segments([far], place)
    (b,), begins, same = bitmaps._segments([near * 1000 - 5], place)
    ends = np.append(begin[1:], len(places))
    got = {(int(c), int(x)) for c, i, j in zip(a, begin, ends) for x in places[i:j]}
    assert got == set(zip(far.tolist(), place.tolist())) and len(places) == len(got)
    got = {(int(c), int(x)) for c, i, j in zip(b, begins, np.append(begins[1:], len(same))) for x in same[i:j]}
    assert got == set(zip((near * 1000 - 5).tolist(), place.tolist())) and len(same) == len(got)


def test_work_space_does_not_change_counts(spark, monkeypatch):
    found = []
    for words, merged in ((1 << 22, 1 << 18), (7, 5)):
        monkeypatch.setattr(row_items, "WORDS", words)
        monkeypatch.setattr(row_items, "MERGED", merged)
        tagged, layout = prepared(spark, odd_rows(seed=5))
        found.append(sorted(map(str, items.item_counts(tagged, layout).collect())))
    assert found[0] == found[1] and len(found[0]) > 20


def test_a_task_takes_its_rows_in_parts(monkeypatch):
    monkeypatch.setattr(row_items, "WORDS", 4)
    lists = [["a"] * 3, None, ["b"] * 2, ["c"] * 9, [], ["d"]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["c0"])
    parts = list(row_items.some_rows(iter([batch, batch.slice(0, 0)]), [(1, "listed", "c0")]))
    assert [x for p in parts for x in p.column("c0").to_pylist()] == lists
    assert len(parts) > 2 and all(p.num_rows == 1 or len(p.column("c0").flatten()) <= 4 for p in parts)
