"""Full prior history of each survey record as ordered steps.

The history of a survey is a prefix of its pixel's observations in time order, so a step's position is computed
once per observation and holds for every survey of the pixel. Steps stay in long form (one row per step); arrays
are built only in chunks of bounded length. Observations are moved to their pixel, and what is made of a pixel's steps
(positions, steps, chunks, summaries) is made in that place: steps, several times as many, are not moved again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpanel.functions.scalar import log_days, record_key, seasonal_cosine, zscore
from fieldpanel.operators.match import day_number
from fieldpanel.operators.moments import moment_state, stats_of_state
from fieldpanel.operators.reshape import add_one_hot
from fieldpanel.schemas import INDEX_COLS, PIXEL_KEY, RECORD_KEY, TASSELED_CAP, TYPE_LEVELS

STEP_FEATURES = ["log_dt", "neg_cos_DOY", *INDEX_COLS]
SLICE_DAYS = 365
#: Observations of a pixel that one task takes; where a pixel has more, pixels are cut into slices of ``SLICE_DAYS``.
PIXEL_ROWS = 1 << 20


def slice_length(observations: DataFrame, keys: Sequence[str] = tuple(PIXEL_KEY)) -> int:
    """Days of the slices that pixels are cut into; 0 where each is small enough to stay whole."""
    most = observations.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return SLICE_DAYS if (most or 0) > PIXEL_ROWS else 0


def history_long(
    records: DataFrame,
    observations: DataFrame,
    keys: Sequence[str] = tuple(PIXEL_KEY),
    value_cols: Sequence[str] = tuple(INDEX_COLS),
    slice_days: int | None = None,
) -> DataFrame:
    """All observations on or before each record's date: (keys, SrvvR_Date, pos, log_dt, neg_cos_DOY, values).

    ``pos`` counts from 1 for the oldest step; observations of one day are ordered by their values. Records
    without history have no rows. With ``slice_days`` every pixel is cut into slices: the sort and the join of a
    pixel with very many observations are spread over its slices, and the rows before a slice are a running sum
    over slice sizes. With 0 pixels stay whole, and by default the largest pixel decides (:func:`slice_length`).
    """
    keys = list(keys)
    slice_days = slice_length(observations, keys) if slice_days is None else slice_days
    dates = records.select(*keys, "SrvvR_Date").dropDuplicates()
    placed = _placed_in_slices(dates, observations, keys, value_cols, slice_days) if slice_days else _placed(dates, observations, keys, value_cols)
    return placed.filter(F.col("ImgDate") <= F.col("SrvvR_Date")).select(
        *keys,
        "SrvvR_Date",
        F.col("_place").cast("long").alias("pos"),
        log_days(F.col("SrvvR_Date"), F.col("ImgDate")).alias("log_dt"),
        seasonal_cosine(F.col("DOY")).alias("neg_cos_DOY"),
        *value_cols,
    )


def _placed(dates: DataFrame, observations: DataFrame, keys: list[str], value_cols: Sequence[str]) -> DataFrame:
    """Dates and the numbered observations of their pixel; the numbering already brings a pixel to one task."""
    in_pixel = Window.partitionBy(*keys).orderBy("ImgDate", "DOY", *value_cols)
    seen = observations.select(*keys, "ImgDate", "DOY", *value_cols).withColumn("_place", F.row_number().over(in_pixel))
    return seen.join(dates, keys, "inner")


def _placed_in_slices(dates: DataFrame, observations: DataFrame, keys: list[str], value_cols: Sequence[str], slice_days: int) -> DataFrame:
    """The same, slice by slice."""
    sliced = observations.select(*keys, "ImgDate", "DOY", *value_cols).withColumn(
        "_slice", F.floor(day_number(F.col("ImgDate")) / F.lit(slice_days))
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    in_slice = Window.partitionBy(*keys, "_slice").orderBy("ImgDate", "DOY", *value_cols)
    placed = sliced.withColumn("_inside", F.row_number().over(in_slice))
    reached = F.floor(day_number(F.col("SrvvR_Date")) / F.lit(slice_days))
    wanted = dates.join(offsets, keys, "inner").filter(F.col("_slice") <= reached)
    # The ranked side is already partitioned by (keys, slice), so the join moves only the record dates.
    return placed.join(wanted, [*keys, "_slice"], "inner").withColumn("_place", F.col("_inside") + F.col("_before"))


def history_length(steps: DataFrame, keys: Sequence[str] = tuple(RECORD_KEY)) -> DataFrame:
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("seq_len"))


def with_history(records: DataFrame, observations: DataFrame, keys: Sequence[str] = tuple(PIXEL_KEY)) -> DataFrame:
    """Records that have at least one observation on or before their date.

    The first observation date of each pixel decides, so no observation is paired with a record.
    """
    first = observations.groupBy(*keys).agg(F.min("ImgDate").alias("_first"))
    return records.join(first, list(keys), "inner").filter(F.col("_first") <= F.col("SrvvR_Date")).drop("_first")


def normalisation_stats(
    observations: DataFrame,
    surveys: DataFrame,
    observed_cols: Sequence[str] = tuple(TASSELED_CAP),
    survey_cols: Sequence[str] = ("Density",),
) -> DataFrame:
    """One row ``mean, std`` of maps by column; each column over its own population, sample deviation."""
    states = moment_state(observations, observed_cols).unionByName(moment_state(surveys, survey_cols))
    return stats_of_state(states)


def apply_stats(df: DataFrame, stats: DataFrame, columns: Sequence[str], zero_std: str = "null") -> DataFrame:
    """Standardise columns with the single statistics row."""
    scaled = {c: zscore(F.col(c), F.col("_st.mean")[c], F.col("_st.std")[c], zero_std) for c in columns}
    one_row = stats.select(F.struct("mean", "std").alias("_st"))
    return df.crossJoin(F.broadcast(one_row)).withColumns(scaled).drop("_st")


def sequence_tables(
    records: DataFrame,
    observations: DataFrame,
    stats: DataFrame,
    levels: Sequence[str] = tuple(v for v in TYPE_LEVELS if v != "Mixed"),
    zero_std: str = "null",
    slice_days: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(lookup, steps) ready for modelling: standardised, encoded, addressed by ``filename``."""
    slice_days = slice_length(observations) if slice_days is None else slice_days
    steps = history_long(records, apply_stats(observations, stats, TASSELED_CAP, zero_std), slice_days=slice_days)
    kept = apply_stats(with_history(records, observations), stats, ["Density"], zero_std)
    address = record_key([F.col("ID"), F.col("PixelID")], F.col("SrvvR_Date"))
    types = [f"Type_{v}" for v in levels]
    lookup = add_one_hot(kept, "Type", levels).withColumn("filename", address)
    return lookup.select(*RECORD_KEY, "Age", "Density", *types, "filename", "target"), steps


def collect_steps(
    steps: DataFrame,
    keys: Sequence[str] = tuple(RECORD_KEY),
    features: Sequence[str] = tuple(STEP_FEATURES),
    chunk_steps: int = 1024,
) -> DataFrame:
    """Ordered arrays of steps, at most ``chunk_steps`` long: (keys, chunk, seq).

    ``chunk`` counts from 0. A sequence longer than one chunk takes several rows and stays whole.
    """
    chunk = F.floor((F.col("pos") - 1) / F.lit(chunk_steps))
    step = F.struct("pos", *features)
    return (
        steps.withColumn("chunk", chunk)
        .groupBy(*keys, "chunk")
        .agg(F.sort_array(F.collect_list(step)).alias("seq"))
    )


def explode_steps(chunks: DataFrame) -> DataFrame:
    """Inverse of :func:`collect_steps`."""
    others = [c for c in chunks.columns if c not in ("chunk", "seq")]
    return chunks.select(*others, F.inline("seq"))


def summarise_steps(
    steps: DataFrame, value_cols: Sequence[str] = tuple(INDEX_COLS), keys: Sequence[str] = tuple(RECORD_KEY)
) -> DataFrame:
    """Fixed-width description of each sequence: last, mean, min, max, slope per day, recency-weighted mean.

    The weight of a step is one over one plus its age in days. A step without value counts in ``seq_len`` alone. All are mergeable aggregates, so a long
    sequence is reduced before it is shuffled.
    """
    age = F.expm1("log_dt")
    weight = F.exp(-F.col("log_dt"))
    out = [F.count(F.lit(1)).alias("seq_len")]
    for c in value_cols:
        value = F.col(c)
        out += [
            F.max_by(value, "pos").alias(f"{c}_last"),
            F.avg(value).alias(f"{c}_mean"),
            F.min(value).alias(f"{c}_min"),
            F.max(value).alias(f"{c}_max"),
            F.try_divide(F.covar_pop(value, -age), F.var_pop(F.when(value.isNotNull(), age))).alias(f"{c}_slope"),
            F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight))).alias(f"{c}_recent"),
        ]
    return steps.groupBy(*keys).agg(*out)
