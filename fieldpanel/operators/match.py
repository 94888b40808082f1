"""Symmetric time-window match of surveys to observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpanel.functions.scalar import below_threshold_label, check_threshold
from fieldpanel.schemas import INDEX_COLS, PIXEL_KEY, SURVEY_KEY, THRESHOLDS
from fieldpanel.sources.io import materialise


def day_number(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def window_join(
    surveys: DataFrame,
    observations: DataFrame,
    days: int,
    keys: Sequence[str] = tuple(PIXEL_KEY),
    survey_date: str = "SrvvR_Date",
    observed_date: str = "ImgDate",
) -> DataFrame:
    """Pairs with ``survey - days <= observation <= survey + days`` for equal keys, both ends included.

    The time axis is cut into blocks as wide as the window. A window then touches at most two blocks, so
    surveys are listed once per touched block and the join is an equality join on (keys, block) with the
    exact range test on top. A key with very many observations is spread over its blocks, and each
    observation meets only surveys of its own time.
    """
    if not 0 <= days <= 182:
        raise ValueError(f"days must lie between 0 and 182, got {days}")
    width = 2 * days + 1

    def block(day: Column) -> Column:
        return F.floor(day / F.lit(width))

    day = day_number(F.col(survey_date))
    listed = surveys.withColumn("_block", F.explode(F.sequence(block(day - days), block(day + days))))
    placed = observations.withColumn("_block", block(day_number(F.col(observed_date))))
    in_window = F.col(observed_date).between(
        F.date_sub(F.col(survey_date), days), F.date_add(F.col(survey_date), days)
    )
    return listed.join(placed, [*keys, "_block"], "inner").filter(in_window).drop("_block")


def window_means(
    surveys: DataFrame,
    observations: DataFrame,
    days: int = 16,
    value_cols: Sequence[str] = tuple(INDEX_COLS),
    keys: Sequence[str] = tuple(SURVEY_KEY),
    key_by_date: bool = False,
    dedupe: bool = False,
    join_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Mean of each value column over the observations in the window of each survey group.

    ``join_keys`` are the columns by which surveys meet observations; by default those of ``ID`` and ``PixelID`` that
    are among ``keys``. Observations are first summed and counted by day, so a pixel's many observations of one day
    are one row of the join.

    Surveys are first reduced to one weighted row per (keys, date); the weight stands for the repeats that
    a plain join would produce. By default all dates of one key pool their windows; ``key_by_date`` keeps
    them apart. ``dedupe`` counts equal observations once.
    """
    join_keys = [k for k in keys if k in PIXEL_KEY] if join_keys is None else list(join_keys)
    if not join_keys or not set(join_keys) <= set(keys):
        raise ValueError(f"join_keys must name some of the keys {list(keys)}, got {join_keys}")
    seen = observations.select(*join_keys, "ImgDate", *value_cols)
    seen = seen.dropDuplicates() if dedupe else seen
    daily = seen.groupBy(*join_keys, "ImgDate").agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in value_cols], *[F.count(c).alias(f"_count_{c}") for c in value_cols]
    )
    weighted = surveys.groupBy(*keys, "SrvvR_Date").agg(F.count(F.lit(1)).alias("_weight"))
    pairs = window_join(weighted, daily, days, join_keys)
    group = [*keys, "SrvvR_Date"] if key_by_date else list(keys)
    means = [
        F.try_divide(F.sum(F.col(f"_sum_{c}") * F.col("_weight")), F.sum(F.col(f"_count_{c}") * F.col("_weight"))).alias(c)
        for c in value_cols
    ]
    return pairs.groupBy(*group).agg(*means)


def match_window(
    surveys: DataFrame,
    observations: DataFrame,
    days: int = 16,
    value_cols: Sequence[str] = tuple(INDEX_COLS),
    key_by_date: bool = False,
    dedupe: bool = False,
    keys: Sequence[str] = tuple(SURVEY_KEY),
    join_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Every survey row with its window means; null means where nothing was observed.

    Surveys are read for their windows and for their rows, so they are written once: the table they are unpivoted from
    is much larger.
    """
    surveys = materialise(surveys)
    means = window_means(surveys, observations, days, value_cols, keys, key_by_date, dedupe, join_keys)
    on = [*keys, "SrvvR_Date"] if key_by_date else list(keys)
    return surveys.join(means, on, "left").select(*surveys.columns, *value_cols)


def label(df: DataFrame, threshold: float | None, column: str = "target") -> DataFrame:
    return df.withColumn(column, below_threshold_label(F.col(column), threshold))


def label_thresholds(df: DataFrame, thresholds: Sequence[float] = tuple(THRESHOLDS), column: str = "target") -> DataFrame:
    """One labelled copy of the table per threshold, told apart by a ``threshold`` column in percent.

    The list is exploded inside the projection, so the copies cost no join and no shuffle. Thresholds that are no whole
    percents are refused, since two of them could share one label.
    """
    if odd := [t for t in thresholds if abs(check_threshold(t) * 100 - round(check_threshold(t) * 100)) > 1e-9]:
        raise ValueError(f"thresholds must be whole percents, got {odd}")
    steps = [
        F.struct(
            F.lit(round(check_threshold(t) * 100)).alias("threshold"),
            below_threshold_label(F.col(column), t).alias("_label"),
        )
        for t in thresholds
    ]
    fanned = df.withColumn("_t", F.explode(F.array(*steps)))
    others = [F.col("_t._label").alias(column) if c == column else F.col(c) for c in df.columns]
    return fanned.select(F.col("_t.threshold").alias("threshold"), *others)
