"""Boosting, forests without depth limit, path contributions, recurrent states and mergeable statistics."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from fieldpanel.ml import deep_forest, importance, kernels, models, recurrent, stored_forest
from fieldpanel.ml import boosting as boosting_module
from fieldpanel.ml.boosting import BoostedTrees
from fieldpanel.ml.deep_forest import DeepForest
from fieldpanel.operators import moments, sketches
from fieldpanel.operators.importance import early_stop
from fieldpanel.sources import sequence_store
from fieldpanel.sources.io import materialise

SMALL = "/root/testdata/sf0.001"


def frame(spark, x, y, w=None, sites=10):
    w = np.ones(len(y)) if w is None else w
    rows = [(i % sites, float(y[i]), float(w[i]), Vectors.dense(x[i])) for i in range(len(y))]
    return materialise(spark.createDataFrame(rows, ["ID", "target", "weight", "features"]).repartition(5))


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4)).round(2)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(600) < 0.1)).astype(int)
    return x, y, rng.uniform(0.5, 2, 600)


# --- boosting ---


def brute_boosting(x, y, w, rounds, depth, rate, alpha, lam, gamma, least):
    """Exact greedy boosting over all thresholds, by recursion."""
    margin = np.zeros(len(y))
    drawn = lambda g: np.sign(g) * max(abs(g) - alpha, 0)
    score = lambda g, h: drawn(g) ** 2 / (h + lam)

    def tree(at, level, g, h, out):
        best = (1e-10, None)
        if level < depth:
            for j in range(x.shape[1]):
                for cut in np.unique(x[at, j])[:-1]:
                    left = x[at, j] <= cut
                    a, b = at[left], at[~left]
                    if h[a].sum() < least or h[b].sum() < least:
                        continue
                    change = score(g[a].sum(), h[a].sum()) + score(g[b].sum(), h[b].sum()) - score(g[at].sum(), h[at].sum())
                    if change > best[0] + 1e-12:
                        best = (change, (a, b))
        if best[1] is None:
            out[at] = -rate * drawn(g[at].sum()) / (h[at].sum() + lam)
            return True
        leaves = [tree(side, level + 1, g, h, out) for side in best[1]]
        if all(leaves) and best[0] < gamma:
            out[at] = -rate * drawn(g[at].sum()) / (h[at].sum() + lam)
            return True
        return False

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        tree(np.arange(len(y)), 0, w * (p - y), w * p * (1 - p), step)
        margin += step
    return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize(("alpha", "lam", "gamma", "least"), [(0.0, 1.0, 0.0, 1.0), (2.0, 0.5, 0.0, 3.0), (0.5, 5.0, 6.0, 0.0)])
def test_boosting_equals_exact_greedy_trees(spark, points, alpha, lam, gamma, least):
    x, y, w = (v[:200] for v in points)
    x = x.round(1)  # few enough values for every one of them to be a bin
    expected = brute_boosting(x, y, w, 10, 3, 0.3, alpha, lam, gamma, least)
    boosting = BoostedTrees(10, 0.3, 3, reg_alpha=alpha, reg_lambda=lam, gamma=gamma, min_child_weight=least, max_bin=5000)
    df = frame(spark, x, y, w)
    out = boosting.fit(df).transform(df).select(vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("p")).collect()
    by_row = {tuple(r["x"]): r["p"] for r in out}
    assert np.allclose([by_row[tuple(v)] for v in x], expected, atol=1e-9)


def test_penalties_shrink_the_leaves(spark, points):
    x, y, w = points
    df = frame(spark, x, y, w)
    spread = lambda **p: BoostedTrees(1, max_depth=2, **p).fit(df).transform(df).agg(F.stddev(vector_to_array("probability")[1])).first()[0]
    plain, squared, absolute = spread(), spread(reg_lambda=100.0), spread(reg_alpha=20.0)
    assert squared < plain and absolute < plain and spread(reg_alpha=1e6) < 1e-12
    assert spread(subsample=0.5) != plain


def test_early_stopping_cuts_the_model(spark, points):
    x, y, w = points
    df = frame(spark, x, np.where(np.arange(600) % 3, y, 1 - y), w, sites=20)  # a third of the labels is turned, so fits go wrong early
    boosting = BoostedTrees(60, 0.6, 4, early_stopping_rounds=2, validation_share=0.3)
    model = boosting.fit(df)
    losses = [r["loss"] for r in boosting.losses.orderBy("epoch").collect()]
    assert len(losses) < 60 and model.getNumTrees == boosting.best_round == 1 + int(np.argmin(losses))
    assert boosting.best_round == early_stop(boosting.losses, 2).first()["best_step"]
    # Spark's own loss of every round: twice the log loss.
    even = BoostedTrees(5, 0.6, 4, early_stopping_rounds=9, validation_share=0.3)
    own = even.fit(df).evaluateEachIteration(even._marked(df)[0].filter("_held"))
    assert len(own) == even.best_round and np.allclose([r["loss"] for r in even.losses.orderBy("epoch").collect()][: len(own)], np.array(own) / 2)


def test_boosting_stores_equal_rows_once(spark, points, monkeypatch):
    x, y, w = (v[:200] for v in points)
    kept, write = [], boosting_module.materialise
    monkeypatch.setattr(boosting_module, "materialise", lambda df: kept.append(write(df)) or kept[-1])
    df = frame(spark, x.round(1), y, w)
    copies = frame(spark, np.tile(x.round(1), (7, 1)), np.tile(y, 7), np.tile(w, 7) / 7)
    chances = [BoostedTrees(4, 0.3, 3, max_bin=8).fit(d).transform(df).select(vector_to_array("probability")[1]).collect() for d in (df, copies)]
    assert np.allclose(*chances, atol=1e-9)
    assert kept[0].count() == kept[1].count() <= 200 and kept[1].agg(F.sum("n")).first()[0] == 1400
    BoostedTrees(1, 0.3, 3, max_bin=8, subsample=0.5).fit(copies)  # drawn row by row
    assert kept[2].count() == 1400


def test_boosting_parameters(spark, points):
    for wrong in ({"max_depth": 0}, {"max_depth": 13}, {"reg_lambda": -1.0}, {"n_estimators": 0}, {"subsample": 1.5}, {"max_bin": 1}):
        with pytest.raises(ValueError):
            BoostedTrees(**wrong)
    df = frame(spark, *points)
    with pytest.raises(ValueError):
        BoostedTrees(2, early_stopping_rounds=2).fit(df.drop("ID"))
    with pytest.raises(ValueError):
        BoostedTrees(2).fit(df.limit(0))


def test_boosting_of_one_class_and_constants(spark):
    df = frame(spark, np.ones((50, 2)), np.ones(50))
    model = BoostedTrees(3).fit(df)
    assert model.totalNumNodes == 3 and {r[0] for r in model.transform(df).select("prediction").collect()} == {1.0}


# --- forests ---


@pytest.mark.parametrize("local_rows", [8192, 40])
@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_deep_forest_fits_distinct_rows_exactly(spark, points, local_rows, criterion):
    x, y, w = points
    df = frame(spark, x, y, w)
    model = DeepForest(4, criterion, 2, bootstrap=False, local_rows=local_rows).fit(df)
    labels = {}
    for v, c in zip(x, y):
        labels.setdefault(tuple(v), set()).add(int(c))
    for r in model.transform(df).select(vector_to_array("features").alias("x"), "prediction", "target").collect():
        assert r["prediction"] == r["target"] or len(labels[tuple(r["x"])]) == 2
    assert model.getNumTrees == 4 and max(t.depth for t in model.trees) > 5
    assert model.featureImportances[0] + model.featureImportances[1] > 0.5


def test_deep_forest_groups_stay_small(spark, points, monkeypatch):
    """No task meets more rows of a node than the bound, though one value holds most rows and a large leaf can't be split."""
    x, y, w = (np.copy(v) for v in points)
    x[:450] = [1.0, 2.0, 3.0, 4.0]
    sizes = []
    monkeypatch.setattr(DeepForest, "_finish", _spying(DeepForest._finish, sizes))
    df = frame(spark, x, y, w)
    model = DeepForest(2, bootstrap=False, max_features=None, local_rows=50).fit(df)
    assert sizes and max(sizes) <= 50
    told = model.transform(df).filter(F.array_contains(vector_to_array("features"), 2.0) & (vector_to_array("features")[3] == 4.0)).select(vector_to_array("probability")[1].alias("p")).distinct().collect()
    assert [r["p"] for r in told] == [pytest.approx((w[:450] * y[:450]).sum() / w[:450].sum())]


def _spying(inner, sizes):
    def finish(self, rows, upper, growth):
        shapes, depth = upper.arrays(), upper.depth
        x = np.array([r["x"] for r in rows.collect()])
        for slot, shape in enumerate(shapes):
            at = kernels.value_place(x, shape, depth)
            sizes.extend(int((at == k).sum()) for k in np.unique(at) if k not in upper.closed[slot])
        return inner(self, rows, upper, growth)

    return finish


def test_deep_forest_of_rare_values(spark):
    """Rows that share a bin of the table, but not their values, are told apart in large nodes too."""
    x = np.concatenate([np.zeros(3000), 1 + np.arange(60) / 1000, np.full(3000, 5.0)])[:, None]
    y = np.concatenate([np.zeros(3000), np.arange(60) % 2, np.ones(3000)]).astype(int)
    df = frame(spark, x, y)
    model = DeepForest(1, bootstrap=False, max_features=None, max_bin=4, local_rows=20).fit(df)
    assert model.transform(df).filter("prediction <> target").count() == 0


def test_deep_forest_draws_rows_and_features(spark, points):
    df = frame(spark, *points)
    model = DeepForest(12, min_samples_leaf=5).fit(df)
    assert len({t.numNodes for t in model.trees}) > 1
    assert model.transform(df).filter("prediction = target").count() > 450
    one = DeepForest(2, min_samples_leaf=300, bootstrap=False).fit(df)
    assert max(t.numNodes for t in one.trees) <= 3
    times = kernels.draw(np.arange(200_000), 3, 7)
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02 and (kernels.draw(np.arange(50), 4, 7) != times[:50]).any()
    with pytest.raises(ValueError):
        DeepForest(2, max_features="most").fit(df)
    with pytest.raises(ValueError):
        DeepForest(2).fit(df.limit(0))


def test_stored_forest_predicts_as_spark(spark, points, monkeypatch, tmp_path):
    """A forest that the driver doesn't hold: same values, parameters and importances; also for rows it was not fitted on."""
    x, y, w = (np.copy(v) for v in points)
    x[:200] = [1.0, 2.0, 3.0, 4.0]
    df, estimator = frame(spark, x, y, w), DeepForest(3, max_features=2, local_rows=40)
    plain = estimator.fit(df)
    monkeypatch.setattr(stored_forest, "DRIVER_NODES", 100)
    monkeypatch.setattr(stored_forest.StoredForest, "_whole", property(lambda self: pytest.fail("the trees were loaded")))
    model = estimator.fit(df)
    assert isinstance(model, stored_forest.StoredForest) and model.getNumTrees == 3 and model.totalNumNodes == plain.totalNumNodes
    ours, theirs = ({p.name: v for p, v in m.extractParamMap().items()} for m in (model, plain))
    assert ours == theirs and ours["numTrees"] == 3
    assert model.featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray())
    rng = np.random.default_rng(5)
    other = frame(spark, rng.permuted(x, axis=0)[:300], y[:300], w[:300])
    model.write().save(str(tmp_path / "forest"))
    for made in (model, stored_forest.StoredForest.load(str(tmp_path / "forest"))):
        for rows in (df, other.unionByName(other), df.limit(0)):
            want, got = plain.transform(rows), made.transform(rows)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["forest_exact", "weighted_accuracy", "feature_names"])
def test_exact_forests_stay_in_tables(spark, name, monkeypatch):
    """The queries' rows don't depend on whether the driver holds the forest; with a bound of few nodes it doesn't."""
    query, loaded = entry_points.queries()[name], []
    want = sorted(map(str, query(spark, SMALL).collect()))
    monkeypatch.setattr(stored_forest, "DRIVER_NODES", 100)
    monkeypatch.setattr(deep_forest, "assemble", lambda *a: loaded.append(a))
    assert sorted(map(str, query(spark, SMALL).collect())) == want and not loaded


# --- contributions ---


@pytest.mark.parametrize("kind", [models.RF, models.GBT, "deep"])
def test_leaf_paths_equal_a_walk(spark, points, kind):
    """Every leaf's contributions against a walk over the saved nodes, and leaves numbered as Spark numbers them."""
    df = frame(spark, *points)
    model = DeepForest(2).fit(df) if kind == "deep" else models.estimator(kind, {"n_estimators": 3, "max_depth": 5}, 3, 1.0).setFeaturesCol("features").fit(df)
    explained = importance.tree_contributions(model, df, 4)
    assert explained.columns == [*df.columns, "phi", "base"]
    p = vector_to_array("probability")
    value = F.log(p[1] / p[0]) if kind == models.GBT else p[0]
    told = model.transform(explained).select(value.alias("v"), "phi", "base").collect()
    assert len(told) == 600 and all(abs(sum(r["phi"]) + r["base"] - r["v"]) < 1e-9 for r in told)
    assert len({tuple(r["phi"]) for r in told}) > 3
    paths = importance.leaf_paths(model, 4).groupBy("tree").agg(F.count("*").alias("n"), F.max("leaf").alias("last")).collect()
    assert {r["tree"]: r["n"] for r in paths} == {k: (t.numNodes + 1) // 2 for k, t in enumerate(model.trees)} and all(r["last"] == r["n"] - 1 for r in paths)


# --- recurrent states ---


def sequences(spark, rng, orders):
    """Records of the same steps in one of two orders, which decides the target."""
    lookup, steps = [], []
    for i, rising in enumerate(orders):
        values = sorted(rng.random() for _ in range(12))
        values = values if rising else values[::-1]
        lookup.append((i, f"{i}_0", dt.date(2015, 1, 1), i % 7 + 1, 0.5, 0, 1, "f", 90.0 if rising else 10.0))
        steps += [(i, f"{i}_0", dt.date(2015, 1, 1), k + 1, float(12 - k), v) for k, v in enumerate(values)]
    records = spark.createDataFrame(lookup, "ID long, PixelID string, SrvvR_Date date, Age int, Density double, Type_Conifer int, Type_Decidous int, filename string, target double")
    return records, spark.createDataFrame(steps, "ID long, PixelID string, SrvvR_Date date, pos long, log_dt double, NDVI double")


@pytest.mark.parametrize("concat", [False, True])
def test_regression_sees_the_order_of_steps(spark, concat):
    rng = random.Random(6)
    orders = [rng.random() < 0.5 for _ in range(80)]
    lookup, steps = sequences(spark, rng, orders)
    model = recurrent.RecurrentRegressor(concat, inputs=("log_dt", "NDVI")).fit(lookup, steps)
    mixed = steps.withColumn("NDVI", F.first("NDVI").over(_shuffled()))
    error = lambda s: model.predict(lookup, s).agg(F.avg(F.abs(F.col("raw_y_true") - F.col("raw_y_pred")))).first()[0]
    out = model.predict(lookup, steps).collect()
    assert len(out) == 80 and all(0 <= r.raw_y_pred <= 100 for r in out) and sum(r.y_true == r.y_pred for r in out) > 76
    assert error(steps) < 8 and error(mixed) > 3 * error(steps)


def _shuffled():
    from pyspark.sql import Window

    # Each step takes the value of a random step of its record.
    return Window.partitionBy("ID").orderBy(F.xxhash64("ID", "pos")).rowsBetween(-5, 0)


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_states_carry_over_chunks(spark, chunk):
    from fieldpanel.operators.history import collect_steps

    rng = random.Random(2)
    lookup, steps = sequences(spark, rng, [True, False] * 20)
    steps = steps.filter("ID <> 5 OR pos < 3").withColumn("NDVI", F.when(F.col("pos") != 4, F.col("NDVI")))
    fold = recurrent.Recurrence(units=5, leak=0.4)
    found = recurrent.last_states(collect_steps(steps, features=["log_dt", "NDVI"], chunk_steps=chunk), ["log_dt", "NDVI"], [6.0, 0.5], [3.0, 0.3], fold)
    a, b, c = fold.weights(2)
    expected = {}
    for r in steps.orderBy("ID", "pos").collect():
        h = expected.get(r["ID"], np.zeros(5))
        x = np.array([(r["log_dt"] - 6) / 3, 0.0 if r["NDVI"] is None else (r["NDVI"] - 0.5) / 0.3])
        expected[r["ID"]] = 0.6 * h + 0.4 * np.tanh(a @ x + b @ h + c)
    got = {r["ID"]: r["state"] for r in found.collect()}
    assert set(got) == set(expected) and all(np.allclose(got[k], expected[k]) for k in got)


def test_long_batches_fold_without_python_rows(spark):
    """Shuffled lengths, sequences over batch borders; steps that are no record of the lookup are not folded."""
    steps = spark.range(60_000).select((F.col("id") % 1500).alias("ID"), F.lit("p").alias("PixelID"), F.lit("2020-01-01").cast("date").alias("SrvvR_Date"), (F.floor(F.col("id") / 1500) + 1).alias("pos"), (F.col("id") % 11).cast("double").alias("NDVI"))
    steps = steps.filter("pos <= 1 + ID % 40")
    chunks = materialise(steps.groupBy("ID", "PixelID", "SrvvR_Date", F.floor((F.col("pos") - 1) / 7).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "NDVI"))).alias("seq")))
    fold = recurrent.Recurrence(units=3)
    a, b, c = fold.weights(1)
    got = {r["ID"]: r["state"] for r in recurrent.last_states(chunks, ["NDVI"], [5.0], [2.0], fold).collect()}
    assert set(got) == set(range(1500))
    for k in range(0, 1500, 37):
        h = np.zeros(3)
        for p in range(1 + k % 40):
            h = 0.7 * h + 0.3 * np.tanh(a @ [((k + 1500 * p) % 11 - 5) / 2] + b @ h + c)
        assert np.allclose(got[k], h)
    lookup = spark.createDataFrame([(3, "p", dt.date(2020, 1, 1), 1, 50.0)], "ID long, PixelID string, SrvvR_Date date, Age int, target double")
    fitted = recurrent.RecurrentModel(recurrent.RecurrentRegressor(inputs=("NDVI",)), [5.0], [2.0], [0.0] * 49)
    folded = fitted.predict(lookup, steps)._jdf.queryExecution().optimizedPlan().toString()
    assert folded.index("MapInArrow") < folded.index("LeftSemi")  # the semi join is below the fold


def test_a_node_tries_its_features_side_by_side(monkeypatch):
    """Two scorings per split node whatever the number of features, and leaves that are pure or all equal."""
    calls, plain = [], kernels.mixed
    monkeypatch.setattr(kernels, "mixed", lambda *a: calls.append(1) or plain(*a))
    rng = np.random.default_rng(4)
    x, y, w = rng.integers(0, 4, (400, 9)).astype(float), rng.integers(0, 2, 400), rng.choice([1.0, 0.5], 400)
    for criterion in ("gini", "entropy"):
        calls.clear()
        grown = kernels.grow_local(x, y, w, np.ones(400, np.int64), kernels.Growth(criterion, 9, 1, 7), 0, 0)
        assert len(calls) == 2 * sum(g[0] >= 0 for g in grown)
        a, b = rng.random((2, 50)) * rng.integers(0, 2, (2, 50))
        assert np.allclose(plain(a, b, criterion), (a + b) * kernels.impurity_of(np.stack([a, b], 1), criterion))
        j, threshold, *_ = grown[0]
        score = lambda f, t: sum(float(plain(*np.bincount(y[m], w[m], 2)[:, None], criterion)[0]) for m in (x[:, f] <= t, x[:, f] > t))
        assert score(j, threshold) == pytest.approx(min(score(f, t + 0.5) for f in range(9) for t in range(3)))
        assert all((g[4] > 0).sum() == 1 for g in grown if g[0] < 0 and g[5] > 1)


# --- mergeable statistics ---


def test_merged_states_equal_one_pass(spark, tmp_path):
    rng = np.random.default_rng(8)
    values = 1e6 + rng.normal(size=500)
    rows = [(int(k % 7), float(v), None if k % 3 else float(k)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "part int, a double, b double").withColumn("empty", F.lit(None).cast("double"))
    cols = ["a", "b", "empty"]
    merged = {r["column"]: r for r in moments.merge_moments(moments.moment_state(df, cols, ["part"])).collect()}
    whole = {r["column"]: r for r in moments.moment_state(df, cols).collect()}
    for c in cols:
        assert merged[c]["n"] == whole[c]["n"] and merged[c]["mean"] == pytest.approx(whole[c]["mean"]) and merged[c]["m2"] == pytest.approx(whole[c]["m2"], rel=1e-9)
    path = str(tmp_path / "state")
    for k in range(7):
        last = moments.add_to_state(spark, path, moments.moment_state(df.filter(F.col("part") == k), cols))
    stats = moments.stats_of_state(last).first()
    assert stats["std"]["a"] == pytest.approx(values.std(ddof=1)) and stats["mean"]["empty"] is None and stats["std"]["empty"] is None
    moments.compact_state(spark, path, str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 3


def test_co_moments_give_pairwise_correlations(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)) + [1e5, 0, -3]
    rows = [("g" if k % 4 else None, k % 2, *(None if (k + 3 * j) % 5 == 0 else float(v) for j, v in enumerate(r)), 2.5) for k, r in enumerate(x)]
    cols = ["a", "b", "c", "flat"]
    df = spark.createDataFrame(rows, "g string, k int, a double, b double, c double, flat double").repartition(6)
    found = moments.correlation_of(moments.merge_co_moments(moments.co_moments(df, cols, ["g", "k"]), ["g", "k"]), cols, ["g", "k"])
    got = {(r["g"], r["k"], r["left"], r["right"]): r["corr"] for r in found.collect()}
    for g in ("g", None):
        for k in (0, 1):
            part = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows if r[0] == g and r[1] == k])
            if not len(part):
                continue
            for i in range(4):
                for j in range(i + 1, 4):
                    both = ~np.isnan(part[:, i]) & ~np.isnan(part[:, j])
                    value = got[g, k, cols[i], cols[j]]
                    if j == 3:
                        assert value is None
                    else:
                        assert value == pytest.approx(np.corrcoef(part[both, i], part[both, j])[0, 1], abs=1e-9)


# --- sketches and the sequence store ---


def test_merged_sketches_stay_within_their_bound(spark):
    df = spark.range(40_000).select((F.col("id") % 7).alias("part"), (F.col("id") % 9000).cast("string").alias("many"), F.when(F.col("id") % 3 > 0, F.least(F.col("id") % 50, F.lit(5))).alias("few"))
    states = sketches.category_sketches(df, ["many", "few"], ["part"])
    assert states.count() == 14
    found = {r["column"]: r for r in sketches.category_estimates(sketches.merge_sketches(states), 2).collect()}
    assert abs(found["many"]["distinct"] - 9000) <= 9000 * sketches.relative_error() and found["few"]["distinct"] == 6
    exact = df.filter("few = 5").count()
    assert found["few"]["top"][0][:] == ("5", exact) and found["few"]["n"] == df.filter("few is not null").count()


def test_top_category_is_exact_beyond_the_tracked_items(spark, tmp_path):
    keys = F.array(F.col("id") % 100_000, F.when(F.col("id") < 7, F.lit(5)))
    orders = spark.range(200_000).select(F.explode(keys).alias("o_custkey")).filter("o_custkey IS NOT NULL")
    orders = orders.withColumns({"o_orderpriority": F.concat(F.lit("P"), (F.col("o_custkey") % 3).cast("string")), "o_orderstatus": F.lit("O")})
    orders.withColumn("o_orderdate", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("o_custkey") % 365).cast("int"))).write.parquet(f"{tmp_path}/orders.parquet")
    found = {r["column"]: r for r in entry_points.queries()["category_sketch"](spark, str(tmp_path)).collect()}
    assert found["o_custkey"][1:] == (200_007, 100_000, True, None, 9)
    assert found["o_orderpriority"][1:] == (200_007, 3, True, "P2", 66_673)
    assert found["o_orderstatus"][1:] == (200_007, 1, True, "O", 200_007)



def test_store_reads_few_row_groups(spark, tmp_path):
    """64 of 60,000 keys out of a store of some hundred row groups read a small share of the rows."""
    steps = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("filename"), F.lit(0).alias("chunk"), F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.struct(k.alias("pos"), F.rand(3).alias("NDVI"))).alias("seq"))
    path = str(tmp_path / "store")
    sequence_store.write_store(steps.repartition(7), path, row_group_bytes=32 << 10, files=8)
    names = [r[0] for r in spark.read.parquet(path).select("filename").orderBy(F.xxhash64("filename")).limit(64).collect()]
    near = [r[0] for r in spark.read.parquet(path).select("filename").orderBy("filename").limit(64).collect()]
    for asked, share in ((names, 0.25), (near, 0.05)):
        result = sequence_store.fetch_batch(spark, path, [*asked, asked[0], None, "unknown"])
        rows = result.collect()
        assert {r["filename"] for r in rows} == set(asked) and len(rows) == 64 and all(len(r["seq"]) == 20 for r in rows)
        assert 64 <= sequence_store.rows_scanned(result) <= share * 60_000
    assert sequence_store.fetch_batch(spark, path, []).count() == 0
    with pytest.raises(ValueError):
        sequence_store.fetch_batch(spark, path, [str(k) for k in range(2000)])
