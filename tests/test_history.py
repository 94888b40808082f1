import datetime as dt
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from fieldpanel.operators import batching, history
from fieldpanel.operators.ordering import explode_range
from fieldpanel.schemas import INDEX_COLS, RECORD_KEY
from fieldpanel.sources import io

OBS_SCHEMA = "ID long, PixelID string, ImgDate date, DOY int, " + ", ".join(f"{c} double" for c in INDEX_COLS)


def day(text):
    return dt.date.fromisoformat(text)


def observation(i, pixel, date, doy, tcb, tcg, tcw):
    return (i, pixel, day(date), doy, *[0.3] * 7, float(tcb), float(tcg), float(tcw))


def fixture(spark):
    lookup = spark.createDataFrame(
        [
            (1, "1_101", day("2020-06-01"), 5, 1200.0, "Mixed", 70.0),
            (2, "2_102", day("2020-06-01"), 6, 1500.0, "Conifer", 80.0),
            (3, "3_103", day("2020-06-01"), 7, 1800.0, "Decidous", 90.0),
            (3, "3_103", day("2021-07-01"), 7, 1800.0, "Conifer", 80.0),
        ],
        "ID long, PixelID string, SrvvR_Date date, Age int, Density double, Type string, target double",
    )
    obs = spark.createDataFrame(
        [
            observation(1, "1_102", "2019-01-01", 1, 33, 16, 14),
            observation(1, "1_101", "2020-05-01", 122, 39, 18, 16),
            observation(1, "1_101", "2020-06-01", 153, 45, 20, 18),
            observation(1, "1_101", "2020-06-02", 154, 51, 22, 20),
            observation(2, "2_102", "2024-01-01", 1, 57, 24, 22),
            observation(3, "3_103", "2019-01-01", 1, 63, 26, 24),
        ],
        OBS_SCHEMA,
    )
    stats = spark.createDataFrame(
        [
            (
                {"TCW": 10.0, "TCG": 20.0, "TCB": 30.0, "Density": 1000.0},
                {"TCW": 2.0, "TCG": 2.0, "TCB": 3.0, "Density": 100.0},
            )
        ],
        "mean map<string,double>, std map<string,double>",
    )
    return lookup, obs, stats


def test_statistics(spark):
    density = spark.createDataFrame([(x,) for x in (1000.0, 2000.0, 6000.0, 600.0, 400.0)], "Density double")
    columns = zip((10, 20, 30, -10, -20, -30), (10, 30, -5, 25, 0, 0), [5] * 6)
    seen = spark.createDataFrame([tuple(map(float, r)) for r in columns], "TCB double, TCG double, TCW double")
    row = history.normalisation_stats(seen, density).first()
    assert row["mean"] == {"TCB": 0.0, "TCG": 10.0, "TCW": 5.0, "Density": 2000.0}
    want = {"TCB": 23.664, "TCG": 14.491, "TCW": 0.0, "Density": 2319.483}
    assert row["std"] == pytest.approx(want, abs=1e-3)


def test_statistics_files(spark, tmp_path):
    _, _, stats = fixture(spark)
    path = str(tmp_path / "stats")
    with pytest.raises(FileNotFoundError):
        io.stats_for(spark, path, None)
    io.stats_for(spark, path, lambda: stats)
    assert io.stats_for(spark, path, None).first() == stats.first()


@pytest.mark.parametrize("slice_days", [365, 1])
def test_sequences(spark, slice_days):
    lookup, steps = history.sequence_tables(*fixture(spark), slice_days=slice_days)
    assert lookup.columns == [
        "ID", "PixelID", "SrvvR_Date", "Age", "Density", "Type_Conifer", "Type_Decidous", "filename", "target",
    ]
    rows = lookup.orderBy("ID", "SrvvR_Date").collect()
    assert [(r.ID, r.Density) for r in rows] == [(1, 2.0), (3, 8.0), (3, 8.0)]
    assert [(r.Type_Conifer, r.Type_Decidous) for r in rows] == [(0, 0), (0, 1), (1, 0)]
    assert rows[0].filename == "1_1_101_2020-06-01.parquet"
    first = steps.filter("ID = 1").orderBy("pos").collect()
    assert [r.pos for r in first] == [1, 2]
    assert [r.log_dt for r in first] == pytest.approx([math.log(32), 0.0])
    assert [r.neg_cos_DOY for r in first] == pytest.approx([-math.cos(2 * math.pi * d / 365) for d in (122, 153)])
    assert [(r.TCW, r.TCG, r.TCB) for r in first] == [(3.0, -1.0, 3.0), (4.0, 0.0, 5.0)]


def random_history(spark, seed=3):
    """Pixel 0 owns most of the observations, many of them on the same days."""
    rng = random.Random(seed)
    start = dt.date(2012, 1, 1)
    seen = set()
    while len(seen) < 300:
        pixel = 0 if rng.random() < 0.6 else rng.randrange(1, 5)
        date = start + dt.timedelta(rng.randrange(60))
        seen.add((pixel, f"p{pixel}", date, date.timetuple().tm_yday, *[round(rng.random(), 2) for _ in INDEX_COLS]))
    asked = {(p, f"p{p}", start + dt.timedelta(rng.randrange(-5, 70))) for p in (rng.randrange(7) for _ in range(25))}
    return (
        spark.createDataFrame(sorted(asked), "ID long, PixelID string, SrvvR_Date date"),
        spark.createDataFrame(sorted(seen), OBS_SCHEMA),
        sorted(asked),
        sorted(seen),
    )


@pytest.mark.parametrize("slice_days", [365, 7, 1])
def test_history_against_brute_force(spark, slice_days):
    """The result does not depend on how finely a pixel's time is cut."""
    records, obs, asked, seen = random_history(spark)
    got = sorted(
        (r.ID, r.SrvvR_Date, r.pos, r.NDVI, r.TCW)
        for r in history.history_long(records, obs, slice_days=slice_days).collect()
    )
    want = []
    for i, _, date in asked:
        past = [o for o in seen if o[0] == i and o[2] <= date]
        want += [(i, date, n, o[4], o[13]) for n, o in enumerate(past, 1)]
    assert got == sorted(want)


def exchanges(df):
    """The columns that rows are moved by, exchange by exchange."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def test_steps_stay_at_their_pixel(spark):
    """Chunks and summaries are made where the observations of a pixel are: dates are moved, steps are not."""
    records, obs, _, _ = random_history(spark)
    steps = history.history_long(records, obs)
    assert not [e for e in exchanges(history.collect_steps(steps)) if "chunk" in e]
    assert len([e for e in exchanges(history.summarise_steps(steps)) if "SrvvR_Date" in e]) == 1  # the distinct dates


def test_a_large_pixel_is_cut_into_slices(spark, monkeypatch):
    records, obs, _, _ = random_history(spark)
    whole = sorted(history.history_long(records, obs).collect())
    assert history.slice_length(obs) == history.slice_length(obs.limit(0)) == 0
    monkeypatch.setattr(history, "PIXEL_ROWS", 50)
    assert history.slice_length(obs) == history.SLICE_DAYS
    cut = history.history_long(records, obs)
    assert [e for e in exchanges(cut) if "_slice" in e] and sorted(cut.collect()) == whole


def test_written_tables_leave_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in files.getAllFiles().mkString("|").split("|") if "/shuffle_" in name}

    before, setting = shuffled(), spark.conf.get(io.FREE_SHUFFLES)
    stored = io.materialise(spark.range(1000).repartition(4, "id"))
    assert spark.conf.get(io.FREE_SHUFFLES) == setting
    for _ in range(50):  # they are removed in the background
        left = shuffled() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and stored.count() == 1000


def test_order_and_presence(spark):
    records, obs, asked, seen = random_history(spark)
    steps = history.history_long(records, obs)
    by_record = {}
    for r in steps.orderBy("pos").collect():
        by_record.setdefault((r.ID, r.SrvvR_Date), []).append(r.log_dt)
    assert all(a >= b for s in by_record.values() for a, b in zip(s, s[1:]))
    kept = {(r.ID, r.SrvvR_Date) for r in history.with_history(records, obs).collect()}
    assert kept == set(by_record) and len(kept) < len(asked)


def test_chunks_hold_the_whole_sequence(spark):
    records, obs, _, _ = random_history(spark)
    steps = history.history_long(records, obs)
    chunks = history.collect_steps(steps, chunk_steps=7)
    assert chunks.agg(F.max(F.size("seq"))).first()[0] == 7
    back = history.explode_steps(chunks).select(*steps.columns)
    assert sorted(back.collect()) == sorted(steps.collect())


def test_summary(spark):
    steps = spark.createDataFrame(
        [(1, "p", day("2020-01-11"), 1, math.log(11), 1.0), (1, "p", day("2020-01-11"), 2, 0.0, 3.0)],
        "ID long, PixelID string, SrvvR_Date date, pos long, log_dt double, NDVI double",
    )
    r = history.summarise_steps(steps, ["NDVI"]).first()
    assert (r.seq_len, r.NDVI_last, r.NDVI_mean, r.NDVI_min, r.NDVI_max) == (2, 3.0, 2.0, 1.0, 3.0)
    assert r.NDVI_slope == pytest.approx(0.2)
    assert r.NDVI_recent == pytest.approx((1 / 11 + 3) / (1 / 11 + 1))


def test_summary_leaves_steps_without_value_out(spark):
    rows = [(1, "p", day("2020-01-31"), k, math.log1p(31 - d), v) for k, (d, v) in enumerate([(1, None), (11, 2.0), (21, None), (31, 4.0)], 1)]
    steps = spark.createDataFrame(rows, "ID long, PixelID string, SrvvR_Date date, pos long, log_dt double, NDVI double")
    r = history.summarise_steps(steps, ["NDVI"]).first()
    assert r.seq_len == 4 and r.NDVI_slope == pytest.approx(0.1)
    assert r.NDVI_recent == pytest.approx((2 / 21 + 4) / (1 / 21 + 1))


def padding_tables(spark):
    date = day("2020-01-01")
    batched = spark.createDataFrame(
        [(1, "a", date, 0, 0, 71.0), (2, "b", date, 0, 1, 72.0), (3, "c", date, 0, 2, 73.0)],
        "ID long, PixelID string, SrvvR_Date date, batch long, position long, target double",
    )
    steps = spark.createDataFrame(
        [(1, "a", date, 1, 1.0), (1, "a", date, 2, 2.0), (2, "b", date, 1, 3.0), (2, "b", date, 2, 4.0), (2, "b", date, 3, 5.0)],
        "ID long, PixelID string, SrvvR_Date date, pos long, x double",
    )
    return batched, steps


def test_padding(spark):
    batched, steps = padding_tables(spark)
    rows = batching.pad_batches(batched, steps, features=["x"]).orderBy("batch_row", "pos").collect()
    shape = {}
    for r in rows:
        shape.setdefault((r.batch_row, r.ID, r.sequence_length), []).append(r.x)
    assert shape == {(1, 2, 3): [3.0, 4.0, 5.0], (2, 1, 2): [1.0, 2.0, 0.0], (3, 3, 1): [0.0, 0.0, 0.0]}


@pytest.mark.parametrize("join_chunk", [1, 2, 3, 65_536])
def test_fetch_gives_one_zero_step(spark, join_chunk):
    batched, steps = padding_tables(spark)
    fetched = batching.fetch_steps(batched, steps, features=["x"], join_chunk=join_chunk)
    got = sorted((r.ID, r.pos, r.x) for r in fetched.collect())
    assert got == [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0), (2, 2, 4.0), (2, 3, 5.0), (3, 1, 0.0)]


def test_shuffle_keeps_groups(spark):
    ages = [1, 1, 1, 2, 2, 3, 4] * 20
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "k long, Age int")
    first = batching.shuffle_in_group(df, ["k"]).orderBy("position").collect()
    assert [r.position for r in first] == list(range(len(ages)))
    assert [r.Age for r in first] == sorted(ages)
    again = batching.shuffle_in_group(df.repartition(5), ["k"]).orderBy("position").collect()
    assert first == again
    later = batching.shuffle_in_group(df, ["k"], epoch=1).orderBy("position").collect()
    assert [r.k for r in later] != [r.k for r in first] and {r.k for r in later} == {r.k for r in first}
    sizes = batching.assign_batches(batching.shuffle_in_group(df, ["k"]), 5).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in sizes) == [12, 32, 32, 32, 32]


def test_explode_range(spark):
    df = spark.createDataFrame([(1, 10), (5, 4), (7, 7)], "a long, b long")
    got = explode_range(df, F.col("a"), F.col("b"), "n", step=3).select("a", "n").collect()
    assert sorted(map(tuple, got)) == [(1, n) for n in range(1, 11)] + [(7, 7)]


def test_record_key_is_declared():
    assert RECORD_KEY == ["ID", "PixelID", "SrvvR_Date"]
