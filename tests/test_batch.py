import json

from brute import collected, deviations
from pyspark.sql import functions as F
from test_deviations import NOTES, RULES, SCHEMA, make_rows, row_items, same

from contrastmill import batch_by_channel
from contrastmill.plans.crash_reports import crash_features


def test_channels_in_one_job(spark, tmp_path):
    rows = make_rows(21, 900)
    names = [f"v{i % 3}" for i in range(len(rows))]
    days = [f"2024-01-{10 + i % 7:02d}" for i in range(len(rows))]
    df = spark.createDataFrame([(*r, v, d) for r, v, d in zip(rows, names, days)], f"{SCHEMA}, version string, day string")
    df = df.withColumn("crash_date", F.to_date("day")).drop("day").withColumn("useragent_locale", F.lit("en"))
    df = df.withColumn("user_comments", F.concat(F.lit("crash on "), F.coalesce("signature", F.lit("nothing"))))
    channels = spark.createDataFrame([("release", "v0"), ("release", "v1"), ("nightly", "v2"), ("both", "v1"), ("both", "v2")], "population string, version string")
    batch = batch_by_channel(
        df, channels, group_column="signature", as_of="2024-01-16", product="P", days=5, word_days=30, number=3, features=crash_features(NOTES)
    )
    got = {}
    labelled = batch.rules.withColumn("g", F.concat("population", F.lit("|"), "g"))
    labelled = labelled.withColumn("items", F.transform("items", lambda i: i.dropFields("label")))
    for g, found in collected(labelled).items():
        population, name = g.split("|")
        got.setdefault(population, {})[name] = found
    sizes = {r.population: r.total_reference for r in batch.sizes.collect()}
    for population, members in {"release": "v0 v1", "nightly": "v2", "both": "v1 v2"}.items():
        chosen = [(r, d) for r, v, d in zip(rows, names, days) if v in members.split()]
        recent = [r for r, d in chosen if d >= "2024-01-12"]
        counted = {}
        for r in recent:
            if r[1] is not None:
                counted[r[1]] = counted.get(r[1], 0) + 1
        top = sorted(counted, key=lambda s: (-counted[s], s))[:3]
        window = [r for r, d in chosen if d >= "2024-01-11"]
        assert sizes[population] == len(window)
        brute = []
        dates = [d for _, d in chosen if d >= "2024-01-11"]
        for r, d in zip(window, dates):
            extra = {("crash_date", d, "date", None), ("useragent_locale", "en", "str", None)}
            brute.append(((r[1],) if r[1] in top else (), 1, row_items(r) | extra))
        same(got[population], deviations(brute, **RULES))

    path = str(tmp_path / "published")
    batch.write(path, "2024-01-16")
    batch.write(path, "2024-01-16")
    docs = [json.loads(r.value) for r in spark.read.text(f"{path}/groups").collect()]
    assert len(docs) == 9 and all(d["top_words"] for d in docs)
    totals = json.loads(spark.read.text(f"{path}/all").first().value)
    assert totals == {"date": "2024-01-16", "totals": sizes}
    related = {(r.population, r.g) for r in spark.read.json(f"{path}/addon_related").select("population", "g").collect()}
    assert related == {(r.population, r.g) for r in batch.related.collect()}
    assert any(g == "A" for _, g in related)
