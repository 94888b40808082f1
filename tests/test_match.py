import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldpanel.operators import match
from fieldpanel.schemas import INDEX_COLS

SEEN = [
    ("2009-12-15", 0.1), ("2009-12-16", 0.2), ("2010-01-17", 0.3), ("2010-01-18", 0.4),
    ("2014-11-28", 0.85), ("2014-12-31", 0.84), ("2015-01-16", 0.74), ("2015-02-15", 0.34),
]
ASKED = [(2, "2010-01-01"), (4, "2012-07-01"), (6, "2014-12-31"), (7, "2015-12-31")]
PIXELS = [(1, "1_1"), (2, "2_1"), (2, "2_2")]


def day(text):
    return dt.date.fromisoformat(text)


def tables(spark):
    seen = {"1_1": SEEN, "2_1": SEEN[:4], "2_2": SEEN[4:]}
    schema = "ID long, PixelID string, ImgDate date, " + ", ".join(f"{c} double" for c in INDEX_COLS)
    obs = spark.createDataFrame([(i, p, day(d), *[v] * 10) for i, p in PIXELS for d, v in seen[p]], schema)
    surveys = spark.createDataFrame(
        [(i, p, a, day(d), 90.0) for i, p in PIXELS for a, d in ASKED],
        "ID long, PixelID string, Age int, SrvvR_Date date, target double",
    )
    return surveys, obs


def test_window_means(spark):
    rows = match.match_window(*tables(spark), 16).collect()
    assert len(rows) == 12
    found = {(r.PixelID, r.Age): r for r in rows if r.NDVI is not None}
    assert set(found) == {("1_1", 2), ("1_1", 6), ("2_1", 2), ("2_2", 6)}
    for (_, age), r in found.items():
        assert all(r[c] == pytest.approx(0.25 if age == 2 else 0.79) for c in INDEX_COLS)


def test_days_are_checked(spark):
    for days in (-1, 183):
        with pytest.raises(ValueError):
            match.match_window(*tables(spark), days)


def random_tables(spark, seed):
    """One pixel owns most observations; some surveys and observations repeat."""
    rng = random.Random(seed)
    start = dt.date(2010, 1, 1)
    seen = []
    for _ in range(400):
        pixel = 0 if rng.random() < 0.6 else rng.randrange(1, 6)
        value = None if rng.random() < 0.1 else round(rng.random(), 3)
        seen.append((pixel, f"p{pixel}", start + dt.timedelta(rng.randrange(120)), value))
    asked = [
        (p, f"p{p}", rng.randrange(1, 4), start + dt.timedelta(rng.randrange(120)), float(rng.randrange(3)))
        for p in (rng.randrange(6) for _ in range(40))
    ]
    obs = spark.createDataFrame(seen, "ID long, PixelID string, ImgDate date, NDVI double")
    surveys = spark.createDataFrame(asked, "ID long, PixelID string, Age int, SrvvR_Date date, target double")
    return surveys, obs, asked, seen


@pytest.mark.parametrize("days", [0, 1, 7, 16])
def test_against_brute_force(spark, days):
    surveys, obs, asked, seen = random_tables(spark, days)
    got = {(r.ID, r.Age): r.NDVI for r in match.match_window(surveys, obs, days, ["NDVI"]).collect()}
    want = {}
    for i, _, age, _, _ in asked:
        values = [
            o[3] for a in asked if (a[0], a[2]) == (i, age) for o in seen
            if o[0] == i and abs((o[2] - a[3]).days) <= days and o[3] is not None
        ]
        want[(i, age)] = sum(values) / len(values) if values else None
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == (pytest.approx(value) if value is not None else None)


def test_wider_window_keeps_matches(spark):
    surveys, obs, _, _ = random_tables(spark, 5)
    pairs = [match.window_join(surveys, obs, d).count() for d in (0, 3, 10, 30)]
    assert pairs == sorted(pairs)
    assert match.match_window(surveys, obs, 3, ["NDVI"]).count() == surveys.count()


def test_labels_fan_out_in_one_projection(spark):
    surveys, _, _, _ = random_tables(spark, 1)
    out = match.label_thresholds(surveys.withColumn("target", F.lit(65.0)))
    assert {(r.threshold, r.target) for r in out.collect()} == {(50, 1), (60, 1), (70, 0), (80, 0)}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_other_key_names(spark):
    """Sites are kept apart whatever the key columns are called, and a match without keys is refused."""
    date = dt.date(2010, 1, 1)
    surveys = spark.createDataFrame([("s1", 1, 2, date), ("s2", 1, 2, date)], "site string, pix long, Age int, SrvvR_Date date")
    seen = spark.createDataFrame([("s1", 1, date, 1.0), ("s2", 1, date, 3.0)], "site string, pix long, ImgDate date, v double")
    out = match.match_window(surveys, seen, 5, ["v"], keys=["site", "pix", "Age"], join_keys=["site", "pix"])
    assert {(r.site, r.v) for r in out.collect()} == {("s1", 1.0), ("s2", 3.0)}
    for join_keys in (None, [], ["other"]):
        with pytest.raises(ValueError):
            match.match_window(surveys, seen, 5, ["v"], keys=["site", "pix", "Age"], join_keys=join_keys)


def test_thresholds_are_whole_percents(spark):
    surveys = tables(spark)[0]
    assert {r.threshold for r in match.label_thresholds(surveys, [0.66, 0.29]).collect()} == {66, 29}
    with pytest.raises(ValueError):
        match.label_thresholds(surveys, [0.66, 0.665])
