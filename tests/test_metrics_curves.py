import math
import random

import pytest
from pyspark.sql import functions as F

from fieldpanel.operators import curves, importance, metrics, profile
from fieldpanel.sources import io

#: (truth, prediction, probability of class 0, age): three hits, two misses, one false alarm, four rightly left.
CASES = [
    (0, 0, 0.9, 1), (0, 0, 0.9, 1), (0, 0, 0.9, 2), (0, 1, 0.3, 2), (0, 1, 0.3, 3),
    (1, 0, 0.6, 1), (1, 1, 0.3, 2), (1, 1, 0.1, 3), (1, 1, 0.1, 3), (1, 1, 0.1, 3),
]
Y_TRUE, Y_PRED, Y_PROB, AGE = (list(x) for x in zip(*CASES))
# Published score groups, which these curves must give again.
# (score, rows of class 0, rows of class 1) in descending order.
COUNTS_80 = [
    (0.6381269912221222, 1654, 2587), (0.6315345075567612, 1973, 2790), (0.6251068074141686, 1866, 2450),
    (0.6170791028955406, 1667, 2169), (0.5679507539848744, 3063, 3745), (0.39309379265779654, 755, 4552),
    (0.3824374624890679, 1238, 4878), (0.3807332527243938, 1207, 4566), (0.3722188958352113, 1256, 3989),
    (0.24481413109501163, 623, 1406),
]
COUNTS_50 = [
    (0.7501257645859595, 39, 508), (0.734659398406238, 51, 1267), (0.7329330731275789, 117, 1129),
    (0.6722493727187151, 170, 722), (0.5560289010714528, 375, 5311), (0.464246196725166, 252, 7999),
    (0.45568652299197404, 503, 9382), (0.4459893104686725, 446, 7145), (0.44417286067864453, 322, 8896),
    (0.32744853822892556, 198, 3602),
]


@pytest.fixture(scope="module")
def predicted(spark):
    return spark.createDataFrame(CASES, "y_true int, y_pred int, y_prob double, Age int")


def test_matrix_and_scores(predicted):
    counts = metrics.confusion(predicted)
    assert tuple(counts.first()) == (3, 2, 1, 4)
    assert [tuple(r) for r in metrics.confusion_matrix(counts).collect()] == [("True Low", 3, 2), ("True High", 1, 4)]
    melted = metrics.melt_matrix(metrics.confusion_matrix(counts)).collect()
    assert {(r["True"], r["Predicted"]): r["Count"] for r in melted}[("True High", "Predicted Low")] == 1
    row = metrics.class_metrics(counts).first()
    assert (row.precision, row.recall, row.n_records) == (0.75, 0.6, 10)
    assert row.f1 == pytest.approx(0.667) and row.f2 == pytest.approx(0.625) and row.accuracy == pytest.approx(0.7)
    assert (row.pct_low, row.pct_high) == (pytest.approx(50), pytest.approx(50))


def test_areas(predicted):
    cumulative = curves.cumulative_counts(curves.score_counts(predicted))
    row = curves.curve_scores(cumulative).first()
    # 22 of 25 pairs are in order, a tie counting half; precision is 1, 3/4, 5/7, 1/2 down the scores.
    assert row.auc == pytest.approx(0.88) and row.ap == pytest.approx(0.6 + 0.4 * 5 / 7)
    got = [(r.tp, r.fp) for r in cumulative.orderBy(F.desc("score")).collect()]
    assert got == [(3, 0), (3, 1), (5, 2), (5, 5)]


def test_absent_predictions_score_zero(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y_true int, y_pred int")
    row = metrics.class_metrics(metrics.confusion(df)).first()
    assert (row.precision, row.recall, row.f1, row.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_by_age(predicted):
    raw = predicted.withColumns({f"raw_{c}": F.when(F.col(c) == 0, 60.0).otherwise(90.0) for c in ("y_true", "y_pred")})
    rows = metrics.metrics_by_group(raw, ["Age"], 3, "raw_y_true", "raw_y_pred").collect()
    assert {r.Age: r.n_records for r in rows} == {1: 3, 2: 3, 3: 4}
    errors = {a: sum((t != p) for t, p, b in zip(Y_TRUE, Y_PRED, AGE) if b == a) / AGE.count(a) for a in set(AGE)}
    for r in rows:
        assert r.rmse == pytest.approx(30 * math.sqrt(errors[r.Age]))


def test_log_loss(predicted):
    got = predicted.agg(metrics.log_loss(F.col("y_true"), F.col("y_prob"))).first()[0]
    want = sum(-math.log(p if t == 0 else 1 - p) for t, p in zip(Y_TRUE, Y_PROB)) / len(Y_TRUE)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("counts, auc, ap", [(COUNTS_80, 0.6064, 0.3862), (COUNTS_50, 0.5454, 0.0609)])
@pytest.mark.parametrize("ranges", [1, 3, 200])
def test_known_curves(spark, counts, auc, ap, ranges):
    df = spark.createDataFrame(counts, "score double, pos long, neg long")
    cumulative = curves.cumulative_counts(df, ranges=ranges)
    row = curves.curve_scores(cumulative).first()
    assert round(row.auc, 4) == auc and round(row.ap, 4) == ap
    roc = curves.roc_curve(cumulative).orderBy(F.desc("threshold")).collect()
    assert len(roc) == 11 and roc[0].threshold == math.inf and (roc[0].fpr, roc[0].tpr) == (0.0, 0.0)
    assert (roc[-1].fpr, roc[-1].tpr) == (1.0, 1.0)
    pr = curves.pr_curve(cumulative).orderBy("threshold").collect()
    assert len(pr) == 10 and pr[0].recall == 1.0
    assert pr[-1].precision == pytest.approx(counts[0][1] / (counts[0][1] + counts[0][2]))


@pytest.mark.parametrize("ranges", [1, 4, 50])
def test_curves_against_brute_force(spark, ranges):
    """Ties, equal neighbours and two groups, cut into several ranges."""
    rng = random.Random(11)
    rows = [(g, rng.randrange(2), round(rng.random(), 2 if g == "a" else 3)) for g in "ab" for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, y_true int, y_prob double")
    cumulative = curves.cumulative_counts(curves.score_counts(df, ["g"]), ["g"], ranges)
    got = {(r.g, r.threshold): (r.fpr, r.tpr) for r in curves.roc_curve(cumulative, ["g"]).collect()}
    want = {}
    for g in "ab":
        mine = [(s, t) for h, t, s in rows if h == g]
        scores = sorted({s for s, _ in mine}, reverse=True)
        n_pos = sum(t == 0 for _, t in mine)
        n_neg = len(mine) - n_pos
        sizes = [(sum(x == s and t == 0 for x, t in mine), sum(x == s and t == 1 for x, t in mine)) for s in scores]
        want[(g, math.inf)] = (0.0, 0.0)
        tp = fp = 0
        for i, (s, (p, n)) in enumerate(zip(scores, sizes)):
            tp, fp = tp + p, fp + n
            if i in (0, len(scores) - 1) or sizes[i + 1] != (p, n):
                want[(g, s)] = (fp / n_neg, tp / n_pos)
    for i in (0, 1):
        assert {k: v[i] for k, v in got.items()} == pytest.approx({k: v[i] for k, v in want.items()})
    points = curves.roc_curve(cumulative, ["g"]).filter("g = 'a'").orderBy("fpr", "tpr").collect()
    area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(curves.curve_scores(cumulative, ["g"]).filter("g = 'a'").first().auc)


def test_curve_files_carry_their_path(spark, tmp_path, predicted):
    drawn = curves.pr_curve(curves.cumulative_counts(curves.score_counts(predicted)))
    for threshold in (50, 80):
        io.save_csv(drawn, f"{tmp_path}/{threshold}/random_forest_pr_curve")
    paths = [f"{tmp_path}/{t}/random_forest_pr_curve" for t in (50, 80)]
    back = io.with_path_labels(io.load_csv(spark, paths, "threshold double, precision double, recall double"), "pr_curve")
    assert {(r.Threshold, r.Model) for r in back.collect()} == {("50%", "Random Forest"), ("80%", "Random Forest")}
    assert back.count() == 2 * drawn.count()


def test_csv_header_must_fit(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0)], "recall double, precision double").write.option("header", True).csv(f"{tmp_path}/swapped")
    with pytest.raises(Exception, match="header"):
        io.load_csv(spark, f"{tmp_path}/swapped", "precision double, recall double").collect()


def test_linear_contributions_add_up(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0), (5.0, -1.0)], "a double, b double")
    out = importance.linear_contributions(df, {"a": 2.0, "b": -1.0}, 0.5).collect()
    for r in out:
        assert r.phi_a + r.phi_b + r.base == pytest.approx(0.5 + 2 * r.a - r.b)


def test_top_features(spark):
    rated = spark.createDataFrame([("a", 5.0), ("b", 4.0), ("c", 3.0), ("d", 2.0), ("e", 1.0)], "feature string, importance double")

    def chosen(k, keep=()):
        return [r.feature for r in importance.top_features(rated, k, keep).orderBy("position").collect()]

    assert chosen(3) == ["a", "b", "c"]
    assert chosen(2, ["e", "a"]) == ["b", "c", "e", "a"]
    assert chosen(9) == ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize("patience", [1, 2, 3])
def test_early_stop(spark, patience):
    losses = [5.0, 4.0, 4.1, 4.2, 3.9, 4.0, 4.1, 4.2, 1.0]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(losses, 1)], "run string, epoch int, loss double")
    row = importance.early_stop(df, patience, ["run"]).first()
    worse, stop = 0, len(losses)
    for i in range(1, len(losses)):
        worse = worse + 1 if losses[i] > losses[i - 1] * (1 + 1e-5) else 0
        if worse >= patience:
            stop = i + 1
            break
    assert row.stop_step == stop
    assert row.best_loss == min(losses[:stop]) and row.best_step == losses.index(row.best_loss) + 1


def test_categories_and_missing(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), ("y", 2), (None, 2)], "c string, d int")
    got = {r.column: tuple(r)[1:] for r in profile.category_share(df, ["c", "d"]).collect()}
    assert got == {"c": (2, "x", pytest.approx(2 / 3)), "d": (2, "2", pytest.approx(2 / 3))}
    missing = {r.column: (r.present, r.missing) for r in profile.missingness(df).collect()}
    assert missing == {"c": (3, 1), "d": (3, 1)}
