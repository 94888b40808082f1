"""ROC and precision-recall curves, AUC and average precision; class 0 is positive.

Rows are first reduced to counts per distinct score. Cumulative counts then run per score range, with the totals
of higher ranges added, so no task ever orders all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpanel.operators.metrics import rate
from fieldpanel.sources.io import materialise


def score_counts(df: DataFrame, by: Sequence[str] = (), score: str = "y_prob", truth: str = "y_true") -> DataFrame:
    """(by, score, pos, neg) per distinct score. Rows without score (null or NaN) or truth are left out."""
    return (
        df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(truth).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(F.count(F.when(F.col(truth) == 0, 1)).alias("pos"), F.count(F.when(F.col(truth) != 0, 1)).alias("neg"))
    )


def cumulative_counts(counts: DataFrame, by: Sequence[str] = (), ranges: int = 200) -> DataFrame:
    """Add the running ``tp, fp`` by descending score, group totals ``n_pos, n_neg`` and the next lower counts.

    The counts are stored, so their input is read once. A pass over them finds approximate quantiles; they only decide how
    the scores are spread over tasks. What is summed across ranges has at most ``ranges`` rows per group.
    """
    by, counts = list(by), materialise(counts)
    shares = [i / ranges for i in range(1, max(2, ranges))]
    found = counts.agg(F.percentile_approx("score", shares, 10 * len(shares) + 100)).first()[0]
    edges = [float("-inf"), *sorted(set(found or [0.0])), float("inf")]
    cut = Bucketizer(splits=edges, inputCol="score", outputCol="_range").transform(counts)
    # Summary of each range: its totals and its highest score.
    per_range = cut.groupBy(*by, "_range").agg(
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_n"),
        F.max_by(F.struct("pos", "neg"), "score").alias("_top"),
    )
    group = Window.partitionBy(*(by or [F.lit(0)]))
    descending = group.orderBy(F.desc("_range"))
    above = descending.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *by,
        "_range",
        F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p_above"),
        F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n_above"),
        F.sum("_p").over(group).alias("n_pos"),
        F.sum("_n").over(group).alias("n_neg"),
        F.lead("_top").over(descending).alias("_below"),
    )
    local = Window.partitionBy(*by, "_range").orderBy(F.desc("score"))
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cut.withColumns(
        {
            "_tp": F.sum("pos").over(running),
            "_fp": F.sum("neg").over(running),
            "_lower": F.lead(F.struct("pos", "neg")).over(local),
        }
    ).join(offsets, [*by, "_range"], "inner")
    return summed.select(
        *by,
        "score",
        "pos",
        "neg",
        (F.col("_tp") + F.col("_p_above")).alias("tp"),
        (F.col("_fp") + F.col("_n_above")).alias("fp"),
        "n_pos",
        "n_neg",
        F.coalesce("_lower", "_below").alias("lower"),
    )


def roc_curve(cumulative: DataFrame, by: Sequence[str] = (), drop_intermediate: bool = True) -> DataFrame:
    """(by, threshold, fpr, tpr), starting at (inf, 0, 0).

    A point between two steps of equal direction and size is left out, like the usual library curve does: it
    is kept where its own counts differ from those of the next lower score.
    """
    corner = (
        F.col("lower").isNull()
        | ((F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg")))
        | (F.col("lower.pos") != F.col("pos"))
        | (F.col("lower.neg") != F.col("neg"))
    )
    points = cumulative.filter(corner) if drop_intermediate else cumulative
    fpr = F.try_divide(F.col("fp").cast("double"), F.col("n_neg"))
    tpr = F.try_divide(F.col("tp").cast("double"), F.col("n_pos"))
    drawn = points.select(*by, F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))
    first = cumulative.filter(F.col("lower").isNull()).select(
        *by,
        F.lit(float("inf")).alias("threshold"),
        F.try_divide(F.lit(0.0), F.col("n_neg")).alias("fpr"),
        F.try_divide(F.lit(0.0), F.col("n_pos")).alias("tpr"),
    )
    return first.unionByName(drawn)


def pr_curve(cumulative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, precision, recall) at every distinct score; without the closing (1, 0) point."""
    tp, fp = F.col("tp"), F.col("fp")
    recall = F.coalesce(F.try_divide(tp.cast("double"), F.col("n_pos")), F.lit(1.0))
    return cumulative.select(
        *by, F.col("score").alias("threshold"), rate(tp, tp + fp).alias("precision"), recall.alias("recall")
    )


def curve_scores(cumulative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, auc, ap): area under the ROC curve by trapezoids and average precision by steps."""
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    area = F.sum(neg * (2 * tp - pos) / 2)
    steps = F.sum(F.try_divide(pos * tp, tp + fp))
    n_pos, n_neg = F.max("n_pos"), F.max("n_neg")
    return cumulative.groupBy(*by).agg(
        F.try_divide(area, n_pos * n_neg).alias("auc"), F.try_divide(steps, n_pos).alias("ap")
    )
