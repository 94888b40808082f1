"""Binary classification metrics with class 0 as the positive class.

Everything derives from four conditional counts, so any grouping costs one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["tp", "fn", "fp", "tn"]


def confusion(
    df: DataFrame,
    by: Sequence[str] = (),
    truth: str = "y_true",
    predicted: str = "y_pred",
    more: Sequence[Column] = (),
) -> DataFrame:
    """Counts ``tp, fn, fp, tn`` per group, with ``more`` aggregates from the same pass."""

    def cell(actual: int, answer: int) -> Column:
        return F.count(F.when((F.col(truth) == actual) & (F.col(predicted) == answer), 1))

    cells = dict(zip(COUNTS, [cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1)]))
    return df.groupBy(*by).agg(*[c.alias(name) for name, c in cells.items()], *more)


def confusion_matrix(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two labelled rows per group: truth down, prediction across."""
    rows = [("True Low", "tp", "fn"), ("True High", "fp", "tn")]
    entries = [
        F.struct(
            F.lit(name).alias("index"), F.col(low).alias("Predicted Low"), F.col(high).alias("Predicted High")
        )
        for name, low, high in rows
    ]
    return counts.select(*by, F.inline(F.array(*entries)))


def melt_matrix(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(True, Predicted, Count) from the labelled matrix."""
    cells = ["Predicted Low", "Predicted High"]
    return matrix.unpivot([*by, "index"], cells, "Predicted", "Count").withColumnRenamed("index", "True")


def rate(part: Column, whole: Column) -> Column:
    """Quotient; 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def f_beta(beta: float) -> Column:
    """F score from the counts."""
    weight = beta * beta
    hits = (1 + weight) * F.col("tp")
    return rate(hits, hits + weight * F.col("fn") + F.col("fp"))


def class_metrics(counts: DataFrame, by: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """Precision, recall, F1, F2, accuracy and class proportions in percent, rounded."""
    tp, fn, fp, tn = (F.col(c) for c in COUNTS)
    rows = tp + fn + fp + tn
    values = {
        "f1": f_beta(1.0),
        "f2": f_beta(2.0),
        "precision": rate(tp, tp + fp),
        "recall": rate(tp, tp + fn),
        "accuracy": rate(tp + tn, rows),
        "pct_low": rate(tp + fn, rows),
        "pct_high": rate(fp + tn, rows),
    }
    rounded = {
        name: F.round(value, digits) * (100 if name.startswith("pct") else 1) for name, value in values.items()
    }
    return counts.select(*by, *[v.alias(name) for name, v in rounded.items()], rows.alias("n_records"))


def rmse(truth: Column, prediction: Column) -> Column:
    difference = truth - prediction
    return F.sqrt(F.avg(difference * difference))


def log_loss(truth: Column, low_probability: Column, clip: float = 1e-15) -> Column:
    """Mean cross-entropy of the probability of class 0."""
    p = F.greatest(F.least(low_probability, F.lit(1 - clip)), F.lit(clip))
    return F.avg(F.when(truth == 0, -F.log(p)).otherwise(-F.log1p(-p)))


def metrics_by_group(
    df: DataFrame,
    by: Sequence[str],
    digits: int = 3,
    raw_truth: str | None = None,
    raw_prediction: str | None = None,
) -> DataFrame:
    """Class metrics, record count and (given raw values) RMSE for every group present."""
    if raw_truth is None or raw_prediction is None:
        return class_metrics(confusion(df, by), by, digits)
    error = rmse(F.col(raw_truth), F.col(raw_prediction)).alias("rmse")
    return class_metrics(confusion(df, by, more=[error]), [*by, "rmse"], digits)
