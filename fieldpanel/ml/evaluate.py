"""Out-of-fold and hold-out predictions and their scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any, Callable

from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldpanel.ml.models import FittedModel, ModelSpec, fit
from fieldpanel.ml.prep import LABEL
from fieldpanel.operators.curves import cumulative_counts, curve_scores, score_counts
from fieldpanel.operators.metrics import class_metrics, confusion, f_beta, log_loss, rate
from fieldpanel.operators.split import group_folds
from fieldpanel.schemas import SURVEY_KEY
from fieldpanel.sources.io import materialise

PREDICTION_COLS = ["y_true", "y_pred", "y_prob"]
#: Fits that run at once. Most of their jobs wait for the driver, so two leave the executors idle.
SIDE_BY_SIDE = 5


def in_threads(jobs: Sequence[Callable[[], Any]], parallelism: int) -> list[Any]:
    """Run driver-side functions, each of which submits Spark jobs, a few at a time."""
    if parallelism <= 1:
        return [job() for job in jobs]
    spark_jobs = [inheritable_thread_target(SparkSession.active())(job) for job in jobs]
    with ThreadPool(parallelism) as pool:
        return pool.map(lambda job: job(), spark_jobs)


def score_expression(scoring: str):
    """Score from ``tp, fn, fp, tn``. ``f1`` rates class 0; precision and recall rate class 1."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    known = {
        "f1": f_beta(1.0),
        "f2": f_beta(2.0),
        "accuracy": rate(tp + tn, tp + fn + fp + tn),
        "precision": rate(tn, tn + fn),
        "recall": rate(tn, tn + fp),
        "balanced_accuracy": (rate(tp, tp + fn) + rate(tn, tn + fp)) / 2,
    }
    if scoring not in known:
        raise ValueError(f"scoring must be one of {sorted([*known, *PROBABILITY_SCORES])} or an Evaluator, got {scoring!r}")
    return known[scoring]


class CountEvaluator(Evaluator):
    """Spark ML evaluator over the four conditional counts; a label absent from a fold gives 0, not an error."""

    def __init__(self, scoring: str = "f1", label: str = LABEL, prediction: str = "prediction"):
        super().__init__()
        self.expression, self.label, self.prediction = score_expression(scoring), label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        counts = confusion(dataset, (), self.label, self.prediction)
        return float(counts.select(self.expression).first()[0])

    def isLargerBetter(self) -> bool:
        return True


class ProbabilityEvaluator(Evaluator):
    """Spark ML evaluator over the probability of class 0: areas under curves, or the log loss with its sign changed."""

    def __init__(self, scoring: str, label: str = LABEL):
        super().__init__()
        self.scoring, self.label = scoring, label

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = dataset.select(F.col(self.label).alias("y_true"), vector_to_array("probability")[0].alias("y_prob"))
        if self.scoring == "neg_log_loss":
            return -float(scored.agg(log_loss(F.col("y_true"), F.col("y_prob"))).first()[0])
        areas = curve_scores(cumulative_counts(score_counts(scored)))
        return float(areas.select(PROBABILITY_SCORES[self.scoring]).first()[0] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


#: Scores of probabilities, and the column of the curve areas that holds each.
PROBABILITY_SCORES = {"roc_auc": "auc", "average_precision": "ap", "neg_log_loss": ""}


def scorer(scoring: str | Evaluator) -> Evaluator:
    if isinstance(scoring, Evaluator):
        return scoring
    return ProbabilityEvaluator(scoring) if scoring in PROBABILITY_SCORES else CountEvaluator(scoring)


#: What identifies a record: its survey key and date, and a number among records that share them.
RECORD = [*SURVEY_KEY, "SrvvR_Date", "record_no"]


def numbered(df: DataFrame) -> DataFrame:
    """Add ``record_no``, from 1 among the rows of one survey key and date in the order of the other columns."""
    if "record_no" in df.columns:
        return df
    shared = [c for c in RECORD if c in df.columns]
    others = [c for c in df.columns if c not in shared]
    return df.withColumn("record_no", F.row_number().over(Window.partitionBy(*shared).orderBy(*others)))


def predictions(model: FittedModel, df: DataFrame, record: Sequence[str] = tuple(RECORD)) -> DataFrame:
    """``record`` columns, ``y_true``, ``y_pred`` and ``y_prob`` of the complete rows."""
    out = model.transform(numbered(df.dropna()) if "record_no" in record else df.dropna())
    return out.select(*record, F.col(LABEL).alias("y_true"), "y_pred", "y_prob")


def out_of_fold(
    spec: ModelSpec,
    df: DataFrame,
    num_folds: int = 5,
    seed: int = 591,
    key: str = "ID",
    record: Sequence[str] = tuple(RECORD),
    parallelism: int = SIDE_BY_SIDE,
    weight_col: str | None = None,
) -> DataFrame:
    """Each complete row predicted by the model fitted without its fold: (record, fold, y_true, y_pred, y_prob).

    Class and probability come from the same fit.
    """
    complete = numbered(df.dropna()) if "record_no" in record else df.dropna()
    folded = materialise(group_folds(complete, num_folds, seed, key))

    def one(f: int) -> DataFrame:
        model = fit(spec, folded.filter(F.col("fold") != f).drop("fold"), weight_col, key)
        held = predictions(model, folded.filter(F.col("fold") == f).drop("fold"), record)
        return held.withColumn("fold", F.lit(f))

    parts = in_threads([lambda f=f: one(f) for f in range(num_folds)], parallelism)
    return reduce(DataFrame.unionByName, parts)


def hold_out(
    spec: ModelSpec, train: DataFrame, test: DataFrame, record: Sequence[str] = tuple(RECORD), weight_col: str | None = None
) -> DataFrame:
    """Predictions for the test rows by a model fitted on the training rows; incomplete rows go on both sides."""
    return predictions(fit(spec, train, weight_col), test, record)


def evaluation(predicted: DataFrame, digits: int = 3) -> DataFrame:
    """One row: class metrics, AUC, average precision and log loss."""
    counted = class_metrics(confusion(predicted), digits=digits)
    areas = curve_scores(cumulative_counts(score_counts(predicted)))
    loss = predicted.agg(log_loss(F.col("y_true"), F.col("y_prob")).alias("log_loss"))
    rounded = areas.crossJoin(loss).select(*[F.round(c, digits).alias(c) for c in ("auc", "ap", "log_loss")])
    return counted.crossJoin(rounded)
