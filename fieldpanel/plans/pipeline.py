"""The three compositions: features for classical models, model evaluation, sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpanel.operators.clean import clean
from fieldpanel.operators.curves import cumulative_counts, curve_scores, pr_curve, roc_curve, score_counts
from fieldpanel.operators.history import normalisation_stats, sequence_tables
from fieldpanel.operators.match import label, label_thresholds, match_window
from fieldpanel.operators.metrics import class_metrics, confusion, confusion_matrix
from fieldpanel.operators.reshape import split_tables, survey_long
from fieldpanel.operators.split import group_split, mark_train
from fieldpanel.schemas import THRESHOLDS
from fieldpanel.sources.io import ingest_raw, save, save_csv, scan, stats_for


def classical_features(raw: DataFrame, days: int = 16, threshold: float | None = 0.7) -> DataFrame:
    """Clean, unpivot, match and label a raw wide table; ``threshold=None`` keeps the raw target."""
    tidy = clean(raw)
    matched = match_window(survey_long(tidy), tidy, days)
    return matched if threshold is None else label(matched, threshold)


def build_classical_data(
    spark: SparkSession,
    raw_path: str,
    out: str,
    days: int = 16,
    thresholds: Sequence[float] = tuple(THRESHOLDS),
    prop_train: float = 0.7,
    seed: int = 591,
) -> None:
    """Write ``clean`` and ``features`` (partitioned by threshold and side) below ``out``.

    The clean table is written once and read by the survey and the match branches; the split is made once and
    holds for all thresholds.
    """
    save(clean(ingest_raw(spark, raw_path)), f"{out}/clean", "overwrite")
    tidy = scan(spark, f"{out}/clean")
    matched = match_window(survey_long(tidy), tidy, days)
    sides = mark_train(matched, seed, prop_train)
    side = F.when(F.col("is_train"), "train").otherwise("test").alias("side")
    tagged = label_thresholds(sides.select("*", side).drop("is_train"), thresholds)
    save(tagged, f"{out}/features", "overwrite", ["threshold", "side"])


def build_sequence_data(spark: SparkSession, clean_path: str, out: str, prop_train: float = 0.7, seed: int = 591) -> None:
    """Write statistics, lookups and steps of the train, test and validation sides below ``out``.

    Statistics come from the training side only; the other side is halved by site into test and validation.
    """
    train, rest = group_split(scan(spark, clean_path), seed, prop_train)
    records, seen = split_tables(train)
    stats = stats_for(spark, f"{out}/norm_stats", lambda: normalisation_stats(seen, records))
    for name, tables in (("train", (records, seen)), ("rest", split_tables(rest))):
        lookup, steps = sequence_tables(*tables, stats)
        save(steps, f"{out}/steps/side={name}", "overwrite")
        if name == "train":
            save(lookup, f"{out}/train_lookup", "overwrite")
        else:
            write_halves(lookup, out, seed)


def write_halves(lookup: DataFrame, out: str, seed: int = 591) -> None:
    test, valid = group_split(lookup, seed, 0.5)
    save(test, f"{out}/test_lookup", "overwrite")
    save(valid, f"{out}/valid_lookup", "overwrite")


def write_evaluation(predictions: DataFrame, out: str, model: str) -> None:
    """Scores, precision-recall curve, ROC curve and matrix of ``y_true, y_pred, y_prob`` as CSV below ``out``."""
    counts = confusion(predictions)
    cumulative = cumulative_counts(score_counts(predictions))
    scores = class_metrics(counts).crossJoin(curve_scores(cumulative))
    save_csv(scores, f"{out}/{model}_scores", "overwrite")
    save_csv(pr_curve(cumulative).orderBy("threshold"), f"{out}/{model}_pr_curve", "overwrite")
    save_csv(roc_curve(cumulative).orderBy(F.desc("threshold")), f"{out}/{model}_roc_curve", "overwrite")
    save_csv(confusion_matrix(counts), f"{out}/{model}_confusion_matrix", "overwrite")
