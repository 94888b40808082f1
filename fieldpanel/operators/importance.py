"""Additive contributions, global importance, feature choice and confidence intervals."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linear_contributions(df: DataFrame, coefficients: Mapping[str, float], intercept: float = 0.0) -> DataFrame:
    """Add ``phi_<feature>`` = coefficient * (value - mean) and ``base`` = margin at the mean.

    The sum of contributions and base is the row's margin. The means are one row.
    """
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in coefficients]).alias("_mean"))
    base: Column = F.lit(float(intercept))
    for c, beta in coefficients.items():
        base = base + F.lit(float(beta)) * F.col("_mean")[c]
    phi = {f"phi_{c}": F.lit(float(b)) * (F.col(c) - F.col("_mean")[c]) for c, b in coefficients.items()}
    return df.crossJoin(F.broadcast(means)).withColumns({**phi, "base": base}).drop("_mean")


def mean_absolute(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """(feature, importance): mean absolute value of each contribution column, from one aggregation."""
    row = df.agg(*[F.avg(F.abs(F.col(c))).alias(f"i{i}") for i, c in enumerate(columns.values())])
    entries = [
        F.struct(F.lit(name).alias("feature"), F.col(f"i{i}").alias("importance")) for i, name in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*entries)))


def top_features(importance: DataFrame, k: int, keep: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most important features outside ``keep``, then the kept ones: (feature, importance, position)."""
    keep = list(keep)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")
    best = (
        importance.filter(~F.col("feature").isin(keep))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= k)
    )
    if not keep:
        return best
    at = F.array_position(F.array(*[F.lit(c) for c in keep]), F.col("feature"))
    forced = importance.filter(F.col("feature").isin(keep)).withColumn("position", (at + k).cast("int"))
    return best.unionByName(forced)


def confidence_interval(
    df: DataFrame, by: Sequence[str], value: str, repeats: int = 5, z: float = 1.96
) -> DataFrame:
    """Mean of the repeats with ``mean -/+ z * std / sqrt(repeats)``; the deviation is the population one."""
    half = F.lit(z / math.sqrt(repeats)) * F.col("std")
    return (
        df.groupBy(*by)
        .agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
        .withColumns({"ci_lower": F.col("mean") - half, "ci_upper": F.col("mean") + half})
    )


def early_stop(
    losses: DataFrame, patience: int, run: Sequence[str] = (), step: str = "epoch", loss: str = "loss", tol: float = 1e-5
) -> DataFrame:
    """(run, stop_step, best_step, best_loss) of each loss curve.

    A step is worse when its loss exceeds the previous one by more than ``tol`` relatively. The run stops at
    the first step that ends ``patience`` worse steps in a row, else at its last; the best step is the first
    with the lowest loss up to there.
    """
    run = list(run)
    order = Window.partitionBy(*(run or [F.lit(0)])).orderBy(step)
    worse = F.coalesce(F.col(loss) > F.lag(loss).over(order) * (1 + tol), F.lit(False))
    streak = Window.partitionBy(*run, "_streak").orderBy(step)
    marked = (
        losses.withColumn("_worse", worse)
        .withColumn("_streak", F.sum(F.when(F.col("_worse"), 0).otherwise(1)).over(order))
        .withColumn("_count", F.sum(F.when(F.col("_worse"), 1).otherwise(0)).over(streak))
    )
    whole = Window.partitionBy(*(run or [F.lit(0)]))
    stop = F.coalesce(F.min(F.when(F.col("_count") >= patience, F.col(step))).over(whole), F.max(step).over(whole))
    used = marked.withColumn("stop_step", stop).filter(F.col(step) <= F.col("stop_step"))
    return used.groupBy(*run, "stop_step").agg(
        F.min_by(step, F.struct(loss, step)).alias("best_step"), F.min(loss).alias("best_loss")
    )


def best_row(df: DataFrame, score: str, tie: str) -> DataFrame:
    """The row with the highest score (first by ``tie``)."""
    return df.orderBy(F.desc(score), tie).limit(1)
