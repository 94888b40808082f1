import datetime as dt
import itertools
import random
import threading

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fieldpanel.ml import evaluate, importance, kernels, models, search, select, seqreg
from fieldpanel.ml.prep import Prep
from fieldpanel.schemas import INDEX_COLS

FOREST = {"n_estimators": 4, "max_depth": 3}
SCHEMA = "ID long, PixelID string, Density double, Type string, Season int, Age int, target int, SrvvR_Date date, "
SCHEMA += ", ".join(f"{c} double" for c in INDEX_COLS)


@pytest.fixture(scope="module")
def rows(spark):
    """120 rows in 30 sites; NDVI decides the class, one row is incomplete."""
    rng = random.Random(5)
    out = []
    for i in range(120):
        site = i // 4
        values = [round(rng.uniform(-1, 1), 3) for _ in INDEX_COLS]
        label = int(values[0] + rng.uniform(-0.2, 0.2) > 0)
        kind = ("Conifer", "Decidous", "Mixed")[site % 3]
        out.append((site, f"{site}_{i % 4}", 10.0 + site % 5, kind, 2001, i % 7 + 1, label, dt.date(2005, 1, 1), *values))
    out.append((0, "0_9", 10.0, "Mixed", 2001, 1, 1, dt.date(2005, 1, 1), None, *[0.0] * 9))
    df = spark.createDataFrame(out, SCHEMA).persist()
    yield df
    df.unpersist()


def test_encoded_names_and_values(spark, rows):
    prep = Prep().fit(rows.dropna())
    assert prep.names == ["Type_Conifer", "Type_Decidous", "Type_Mixed", "Density", "Age", *INDEX_COLS]
    vector = prep.transform(rows.dropna().filter("PixelID = '0_1'")).first().features
    assert list(vector)[:3] == [1.0, 0.0, 0.0]
    unknown = rows.dropna().withColumn("Type", F.lit("Palm"))
    assert list(prep.transform(unknown).first().features)[:3] == [0.0, 0.0, 0.0]
    strict = models.build_random_forest().prep.fit(rows.dropna())
    with pytest.raises(Exception):
        strict.transform(unknown).collect()


def test_scaling_uses_the_population_deviation(rows):
    spec = models.build_logistic_regression()
    prep = spec.prep.fit(rows.dropna())
    assert prep.names == ["Density", *INDEX_COLS, "Type_Conifer", "Type_Decidous", "Type_Mixed", "Age"]
    x = np.array([r[0] for r in prep.transform(rows.dropna()).select(vector_to_array("features")).collect()])
    assert np.allclose(x[:, :11].mean(axis=0), 0) and np.allclose(x[:, :11].std(axis=0), 1)
    assert x[:, -1].max() == 7


@pytest.mark.parametrize("build", models.BUILDERS.values())
def test_builder_arguments(build):
    with pytest.raises(ValueError):
        build(models.Selection("best"))
    with pytest.raises(ValueError):
        build(drop_features="NDVI")
    spec = build(models.Selection("RFE", 5, 2), drop_features=["NDVI"], seed=3)
    assert spec.seed == 3 and spec.prep.drop_features == ("NDVI",) and (spec.feat_select, spec.num_feats, spec.step) == ("RFE", 5, 2)


def test_parameters_reach_the_estimators():
    forest = models.estimator(models.RF, {"n_estimators": 7, "max_depth": 4, "criterion": "log_loss", "max_features": None, "bootstrap": False}, 1, 1.0)
    assert (forest.getNumTrees(), forest.getImpurity(), forest.getFeatureSubsetStrategy(), forest.getBootstrap()) == (7, "entropy", "all", False)
    deep = models.estimator(models.RF, {"n_estimators": 7, "criterion": "log_loss", "max_features": None, "bootstrap": False, "min_samples_leaf": 2}, 5, 1.0)
    assert (deep.n_estimators, deep.criterion, deep.max_features, deep.bootstrap, deep.min_samples_leaf, deep.seed) == (7, "log_loss", None, False, 2, 5)
    asked = {"learning_rate": 0.05, "max_depth": 2, "n_estimators": 9, "reg_alpha": 0.5, "reg_lambda": 3.0, "gamma": 0.1, "subsample": 0.8}
    boosted = models.estimator(models.GBT, asked, 1, 1.0)
    assert {k: getattr(boosted, k) for k in asked} == asked
    linear = models.estimator(models.LR, {"C": 0.5, "penalty": "l1"}, 1, 100.0)
    assert linear.getRegParam() == pytest.approx(0.02) and linear.getElasticNetParam() == 1.0
    assert models.estimator(models.LR, {"penalty": None}, 1, 100.0).getRegParam() == 0.0
    refused = [(models.RF, {"colour": 1}), (models.RF, {"max_depth": 31}), (models.GBT, {"max_depth": 40}), (models.GBT, {"reg_alpha": -1.0}), (models.GBT, {"subsample": 0.0}), (models.GBT, {"losses": None})]
    for kind, params in refused:
        with pytest.raises(ValueError):
            models.estimator(kind, params, 1, 1.0)


def test_logistic_regression_finds_the_optimum(rows):
    """The gradient of the penalised weighted loss vanishes at the fitted coefficients."""
    spec = models.build_logistic_regression(C=0.7, tol=1e-12)
    complete = rows.dropna()
    prep = spec.prep.fit(complete)
    data = models.weighted(prep.transform(complete), spec.params)
    model = models.fit_on_features(spec.kind, spec.params, 1, data)
    got = data.select(vector_to_array("features"), "target", "weight").collect()
    x, y, w = np.array([r[0] for r in got]), np.array([r[1] for r in got]), np.array([r[2] for r in got])
    beta = np.array(model.coefficients)
    p = 1 / (1 + np.exp(-(x @ beta + model.intercept)))
    assert np.abs(0.7 * x.T @ (w * (p - y)) + beta).max() < 1e-3
    assert abs((w * (p - y)).sum()) < 1e-3
    assert w.sum() == pytest.approx(120)


def test_out_of_fold_covers_each_row_once(rows):
    out = evaluate.out_of_fold(models.build_random_forest(**FOREST), rows, 3, record=["ID", "PixelID"])
    got = out.collect()
    assert len(got) == 120 == len({r.PixelID for r in got})
    folds = {}
    for r in got:
        folds.setdefault(r.ID, set()).add(r.fold)
    assert all(len(f) == 1 for f in folds.values()) and {f for s in folds.values() for f in s} == {0, 1, 2}
    scores = evaluate.evaluation(out).first()
    assert scores.accuracy > 0.6 and scores.auc > 0.6 and scores.n_records == 120


def test_save_and_load(rows, tmp_path):
    model = models.fit(models.build_gradient_boosting(models.Selection("RFE", 3, 6), n_estimators=2, max_depth=2), rows)
    assert len(model.selected) == 3
    model.save(str(tmp_path / "m"))
    again = models.FittedModel.load(str(tmp_path / "m"))
    assert again.selected == model.selected and again.params == model.params
    assert again.score(rows.dropna()) == model.score(rows.dropna())


def test_scorers(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 1.0), (1, 1.0)], "target int, prediction double")
    got = {s: evaluate.scorer(s).evaluate(df) for s in ("f1", "accuracy", "precision", "recall")}
    assert got == pytest.approx({"f1": 2 / 3, "accuracy": 0.75, "precision": 2 / 3, "recall": 1.0})
    with pytest.raises(ValueError):
        evaluate.scorer("fame")
    assert evaluate.scorer("balanced_accuracy").evaluate(df) == pytest.approx(0.75)
    chances = [0.9, 0.4, 0.6, 0.1]
    rows = spark.createDataFrame([(t, Vectors.dense(p, 1 - p)) for t, p in zip([0, 0, 1, 1], chances)], ["target", "probability"])
    areas = {s: evaluate.scorer(s).evaluate(rows) for s in ("roc_auc", "average_precision", "neg_log_loss")}
    loss = np.log([0.9, 0.4, 0.4, 0.9]).mean()
    assert areas == pytest.approx({"roc_auc": 0.75, "average_precision": 0.5 + 0.5 * 2 / 3, "neg_log_loss": loss})


def test_records_that_share_a_key_stay_apart(rows):
    """Two dates and two values per age are four records, and every one is predicted under its own id."""
    later = rows.withColumn("SrvvR_Date", F.date_add("SrvvR_Date", 9))
    out = evaluate.out_of_fold(models.build_random_forest(**FOREST), rows.unionByName(later).unionByName(rows), 2).collect()
    complete = rows.dropna().count()
    assert len(out) == 3 * complete == len({tuple(r[c] for c in evaluate.RECORD) for r in out})


def test_selection_inside_the_search_folds(rows):
    """The fold score is that of a model on the selected features."""
    space = {"n_estimators": [4]}
    plain = search.cross_validate(models.build_random_forest(max_depth=3), rows, [{"n_estimators": 4}], 2)
    chosen = search.cross_validate(models.build_random_forest(models.Selection("RFE", 1, 14), max_depth=3), rows, [{"n_estimators": 4}], 2)
    assert [r["score"] for r in plain] != [r["score"] for r in chosen] and len(search.grid_configs(space)) == 1


def test_search_arguments_and_spaces(rows):
    space = {"n_estimators": [1, 2], "max_depth": [1, 2]}
    with pytest.raises(ValueError):
        search.search(models.build_random_forest(), rows, space, "guess")
    with pytest.raises(TypeError):
        search.search(models.build_random_forest(), rows, {"max_depth": search.RandInt(1, 3)}, "grid")
    with pytest.raises(ValueError):
        search.default_space("other")
    assert len(search.grid_configs(space)) == 4 and len(search.sample_configs(space, 10, 1)) == 4
    for kind in models.BUILDERS:
        drawn = search.sample_configs(search.default_space(kind), 20, 9)
        assert drawn == search.sample_configs(search.default_space(kind), 20, 9) and len(drawn) == 20
        for config in drawn:
            models.estimator(kind, config, 1, 10.0)


def test_search_is_reproducible(rows):
    space = {"max_depth": search.RandInt(1, 4), "n_estimators": [2, 3]}
    runs = [search.search(models.build_random_forest(), rows, space, num_iter=2, num_folds=2, return_results=True) for _ in range(2)]
    assert runs[0]["best_score"] == runs[1]["best_score"] and runs[0]["best_params"] == runs[1]["best_params"]
    log = runs[0]["results"].collect()
    assert len(log) == 2 and log[0].mean_test_score == round(runs[0]["best_score"], 3)
    assert {"mean_fit_time", "max_depth", "n_estimators", "std_test_score"} <= set(runs[0]["results"].columns)
    assert runs[0]["experiments"].count() == 4


def test_elimination(rows):
    spec = models.build_random_forest(models.Selection("RFE", 4, 3), **FOREST)
    ranked = select.rank_features(spec, rows).collect()
    assert sorted(r["rank"] for r in ranked) == [1] * 4 + [2] * 2 + [3] * 3 + [4] * 3 + [5] * 3
    assert {r.feature for r in ranked if r.selected} >= {"NDVI"}
    cv = models.build_random_forest(models.Selection("RFECV", 4, 6, 2), **FOREST)
    assert len(models.fit(cv, rows).selected) in (4, 9, 15)
    with pytest.raises(ValueError):
        models.fit(cv, rows, key="Plot")
    assert select.best_count([(0, 4, 0.5), (0, 9, 0.6), (1, 4, 0.6), (1, 9, 0.5)]) == 4


def at_once(count, work):
    """``work``, which goes on only when ``count`` threads are in it, for its first ``count`` calls."""
    barrier, calls = threading.Barrier(count, timeout=60), itertools.count()

    def run(*args, **options):
        if next(calls) < count:
            barrier.wait()
        return work(*args, **options)

    return run


def test_fits_of_different_folds_run_side_by_side(rows, monkeypatch):
    monkeypatch.setattr(search, "fit_on_features", at_once(2, search.fit_on_features))
    configs = [{"C": 1.0}]
    records = search.cross_validate(models.build_logistic_regression(max_iter=5), rows, configs, 2, parallelism=2)
    assert sorted((r["config"], r["fold"]) for r in records) == [(0, 0), (0, 1)]


def test_out_of_fold_fits_run_side_by_side(rows, monkeypatch):
    monkeypatch.setattr(evaluate, "fit", at_once(5, evaluate.fit))
    predicted = evaluate.out_of_fold(models.build_gradient_boosting(n_estimators=1, max_depth=1), rows)
    assert sorted(r.fold for r in predicted.select("fold").distinct().collect()) == [0, 1, 2, 3, 4]


def prepared_forest(rows, kind=models.RF, params=None):
    complete = rows.dropna()
    prep = Prep().fit(complete)
    data = models.weighted(prep.transform(complete), params or FOREST)
    return prep, data, models.fit_on_features(kind, params or FOREST, 1, data)


def test_permutation_importance(rows):
    prep, data, model = prepared_forest(rows)
    scores = importance.permutation_scores(model, data, prep.names, 3, keys=["ID", "PixelID"])
    assert scores.count() == 15 * 3
    rated = {r.feature: r.importance for r in importance.permutation_summary(scores).collect()}
    assert max(rated, key=rated.get) == "NDVI"
    unused = [n for n, v in zip(prep.names, model.featureImportances.toArray()) if v == 0]
    assert unused and all(rated[n] == 0 for n in unused)
    repeat = importance.permutation_scores(model, data.repartition(3), prep.names, 3, keys=["ID", "PixelID"])
    assert sorted(repeat.collect()) == sorted(scores.collect())


@pytest.mark.parametrize("params", [{"n_estimators": 12, "max_depth": 6}, {"n_estimators": 4}, {"n_estimators": 2, "max_depth": 0}])
def test_permuted_rows_of_a_forest_are_answered_as_by_spark(rows, params, monkeypatch):
    prep, data, model = prepared_forest(rows, params=params)
    found = importance.permutation_scores(model, data, prep.names, 2, "f1", keys=["ID", "PixelID"])
    monkeypatch.setattr(importance, "MOST_NODES", 0)  # every copy by the model
    assert importance.forest_nodes(model) is None
    wanted = importance.permutation_scores(model, data, prep.names, 2, "f1", keys=["ID", "PixelID"])
    assert found.dtypes == wanted.dtypes and sorted(found.collect()) == sorted(wanted.collect())


def test_swapped_answers_count_near_ties_tree_by_tree():
    rng = np.random.default_rng(3)
    # Two trees of opposite leaves: votes of many rows are equal, and the first class wins.
    forest = kernels.Forest(np.array([0, 0, 0, 1, 0, 0]), np.array([0.5, np.inf, np.inf, 0.5, np.inf, np.inf]), np.array([1, 1, 2, 4, 4, 5]), np.array([2, 1, 2, 5, 4, 5]), np.array([[0.5, 0.9, 0.1, 0.5, 0.1, 0.9], [0.5, 0.1, 0.9, 0.5, 0.9, 0.1]]), np.array([0, 3]), 1)
    own, donor = rng.random((200, 3)), rng.random((200, 3))
    found = kernels.swapped_answers(forest, own, donor)
    for j in range(3):
        x = own.copy()
        x[:, j] = donor[:, j]
        assert (found[:, j] == ((x[:, 0] > 0.5) & (x[:, 1] <= 0.5))).all()


@pytest.mark.parametrize("kind, params", [(models.RF, FOREST), (models.GBT, {"n_estimators": 3, "max_depth": 2})])
def test_tree_contributions_add_up(rows, kind, params):
    prep, data, model = prepared_forest(rows, kind, params)
    explained = importance.tree_contributions(model, data, len(prep.names))
    total = (F.aggregate("phi", F.lit(0.0), lambda a, x: a + x) + F.col("base")).alias("total")
    p = vector_to_array(F.col("probability"))
    value = p[0] if kind == models.RF else F.log(p[1] / p[0])
    for r in model.transform(explained).select(total, value.alias("value")).collect():
        assert r.total == pytest.approx(r.value)


def test_linear_contributions_add_up(rows):
    spec = models.build_logistic_regression()
    prep = spec.prep.fit(rows.dropna())
    data = models.weighted(prep.transform(rows.dropna()), spec.params)
    model = models.fit_on_features(spec.kind, spec.params, 1, data)
    explained = importance.contributions(model, data, len(prep.names))
    p = vector_to_array(F.col("probability"))
    total = F.aggregate("phi", F.lit(0.0), lambda a, x: a + x) + F.col("base")
    for r in model.transform(explained).select(total.alias("t"), F.log(p[1] / p[0]).alias("m")).collect():
        assert r.t == pytest.approx(r.m)


@pytest.mark.parametrize(
    "arguments",
    [
        {}, {"method": "guess"}, {"method": "SHAP", "num_feats": 0}, {"method": "SHAP", "num_feats": 2.5},
        {"method": "SHAP", "drop_features": "NDVI"}, {"method": "SHAP", "keep_features": "NDVI"},
        {"method": "SHAP", "scaler": "yes"},
    ],
)
def test_selector_arguments(arguments):
    with pytest.raises(ValueError):
        importance.ImportanceSelector(models.build_random_forest(), **arguments)


@pytest.mark.parametrize("method", ["SHAP", "permute"])
def test_selector(rows, method):
    keys = ["ID", "PixelID"]
    spec = models.build_random_forest(**FOREST)
    model = importance.ImportanceSelector(spec, method, repeats=2).fit(rows, keys=keys)
    assert len(model.selected_features) == 5 and "NDVI" in model.selected_features
    assert model.get_feature_names()[:5] == ["Type_Conifer", "Type_Decidous", "Type_Mixed", "Density", "Age"]
    assert set(model.selected_features) <= set(model.transform(rows.dropna()).columns)
    assert model.get_params()["maxDepth"] == 3
    out = model.predict(rows.dropna()).first()
    assert out.y_prob + out.y_prob_high == pytest.approx(1.0)
    assert 0.5 < model.score(rows.dropna()) <= 1


def test_selector_is_saved_with_its_values(rows, tmp_path):
    model = importance.ImportanceSelector(models.build_random_forest(**FOREST), "permute", 3, repeats=2).fit(rows)
    model.save(str(tmp_path / "selector"))
    again = importance.SelectorModel.load(str(tmp_path / "selector"))
    assert again.selected_features == model.selected_features
    for name in ("values", "rating"):
        assert sorted(getattr(again, name).collect()) == sorted(getattr(model, name).collect())


def test_selector_keeps_and_weighs(rows):
    weighted = rows.withColumn("w", F.when(F.col("target") == 0, 1.0).otherwise(1e-6))
    spec = models.build_logistic_regression(class_weight=None)
    model = importance.ImportanceSelector(spec, "SHAP", 3, keep_features=["SAVI", "TCB"], scaler=True).fit(weighted, "w")
    assert len(model.selected_features) == 5 and model.selected_features[3:] == ["SAVI", "TCB"]
    assert "w" not in model.get_feature_names()
    answers = {r.y_pred for r in model.predict(weighted.dropna()).select("y_pred").collect()}
    assert answers == {0}
    assert model.score(weighted.dropna(), "w") > 0.99


def test_sequence_regression(spark, tmp_path):
    rng = random.Random(4)
    lookup, steps = [], []
    for i in range(60):
        date, level = dt.date(2015, 1, 1), rng.random()
        lookup.append((i, f"{i}_0", date, i % 7 + 1, 0.5, i % 2, 0, "f", 100 * level))
        steps += [(i, f"{i}_0", date, k + 1, float(5 - k), level + rng.uniform(-0.05, 0.05)) for k in range(5)]
    records = spark.createDataFrame(
        lookup,
        "ID long, PixelID string, SrvvR_Date date, Age int, Density double, Type_Conifer int, Type_Decidous int, filename string, target double",
    )
    history = spark.createDataFrame(steps, "ID long, PixelID string, SrvvR_Date date, pos long, log_dt double, NDVI double")
    frame = seqreg.sequence_features(records, history, ["NDVI"])
    model = seqreg.SequenceRegressor(concat_features=True, max_iter=8, step_size=0.5).fit(frame, ["NDVI"])
    out = model.predict(frame, 0.7).collect()
    assert len(out) == 60 and all(0 <= r.raw_y_pred <= 100 for r in out)
    assert sum(r.y_true == r.y_pred for r in out) > 45
    assert {r.y_true for r in out} == {0, 1}
    model.save(str(tmp_path / "s"))
    again = seqreg.SequenceModel.load(str(tmp_path / "s")).predict(frame, 0.7).collect()
    assert sorted(again) == sorted(out)


def test_rows_for_a_fit_are_dealt_evenly(rows, monkeypatch):
    monkeypatch.setattr(models, "PART_ROWS", 30)
    kept = models.kept_for_fit(rows.coalesce(1))
    try:
        sizes = [r["n"] for r in kept.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1 and sum(sizes) == 121
    finally:
        kept.unpersist()
    # Forests number the nodes of their rows; the trees are the same.
    made = models.estimator(models.RF, FOREST, 1, 1.0)
    assert made.getCacheNodeIds()
    prep, data, model = prepared_forest(rows)
    plain = made.setFeaturesCol("features").setCacheNodeIds(False).fit(data)
    assert plain.toDebugString.split("\n")[1:] == model.toDebugString.split("\n")[1:]


def test_sequence_fit_reads_assembled_rows_once(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(i, i, 10.0, 5, 0.0, 1.0, float(i % 100), float(i)) for i in range(60)], "ID long, Age int, Density double, seq_len int, Type_Conifer double, Type_Decidous double, target double, NDVI_last double")
    seen = []
    monkeypatch.setattr(seqreg, "kept_for_fit", lambda df: seen.append(df) or models.kept_for_fit(df))
    model = seqreg.SequenceRegressor(True, max_iter=2).fit(frame, ["NDVI"])
    assert [d.columns for d in seen] == [["_x", "target", "_valid"]] and 0 < seen[0].filter("_valid").count() < 60
    assert [type(s).__name__ for s in model.pipeline.stages] == ["VectorAssembler", "GBTRegressionModel"]
