"""Wide to long survey tables, table split, one-hot columns, confusion-matrix melt."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpanel.functions.scalar import one_hot
from fieldpanel.operators.clean import keep_between
from fieldpanel.schemas import AGES, DATE_COLS, INDEX_COLS, PIXEL_KEY, RATE_COLS, SURVEY_KEY
from fieldpanel.sources.io import materialise


def unpivot_repeated(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], labels: Sequence[int], label_name: str, value_name: str
) -> DataFrame:
    """One row per (ids, label) with a non-null value, without duplicate rows."""
    pairs = F.array(
        *[F.struct(F.lit(k).alias(label_name), F.col(c).alias(value_name)) for k, c in zip(labels, columns)]
    )
    return df.select(*ids, F.inline(pairs)).dropna(subset=[value_name]).dropDuplicates()


def site_rows(df: DataFrame) -> DataFrame:
    """Distinct site and survey attributes.

    The wide table repeats them on every observation of a pixel. Duplicates collapse in the map-side
    aggregation, so what is shuffled and unpivoted is one row per pixel, not one per observation, however
    many observations a single pixel has.
    """
    return df.select(*PIXEL_KEY, "Density", "Type", "Season", *RATE_COLS, *DATE_COLS).dropDuplicates()


def survey_rates(sites: DataFrame) -> DataFrame:
    ids = [*PIXEL_KEY, "Density", "Type", "Season"]
    return unpivot_repeated(sites, ids, RATE_COLS, AGES, "Age", "target")


def survey_dates(sites: DataFrame) -> DataFrame:
    return unpivot_repeated(sites, PIXEL_KEY, DATE_COLS, AGES, "Age", "SrvvR_Date")


SURVEY_COLUMNS = [*PIXEL_KEY, "Density", "Type", "Season", "Age", "target", "SrvvR_Date"]


def pair_rates_dates(rates: DataFrame, dates: DataFrame, low: float = 0, high: float = 100) -> DataFrame:
    """Join separately given values and dates on (ID, PixelID, Age); values outside the range go."""
    return keep_between(rates.join(dates, SURVEY_KEY, "inner"), "target", low, high).select(*SURVEY_COLUMNS)


def survey_long(clean: DataFrame, low: float = 0, high: float = 100) -> DataFrame:
    """One row per surveyed (ID, PixelID, Age): every valid value paired with every date of its key.

    Same rows as :func:`pair_rates_dates`, in one pass over the sites: the dates of a key (no more than there
    are days) are gathered next to its values, so both sides share one shuffle and nothing is joined.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(k).alias("Age"), F.col(rate).alias("target"), F.col(date).alias("_date"))
            for k, rate, date in zip(AGES, RATE_COLS, DATE_COLS)
        ]
    )
    long = site_rows(clean).select(*PIXEL_KEY, "Density", "Type", "Season", F.inline(pairs))
    known = long.filter(F.col("target").isNotNull() | F.col("_date").isNotNull())
    dates = F.collect_set("_date").over(Window.partitionBy(*SURVEY_KEY))
    valid = keep_between(known.withColumn("_dates", dates), "target", low, high)
    paired = valid.withColumn("SrvvR_Date", F.explode("_dates"))
    return paired.select(*SURVEY_COLUMNS).dropDuplicates()


def observations(clean: DataFrame) -> DataFrame:
    """Distinct observations of a clean table."""
    return clean.select(*PIXEL_KEY, F.col("ImgDate").cast("date").alias("ImgDate"), "DOY", *INDEX_COLS).dropDuplicates()


def lookup(surveys: DataFrame) -> DataFrame:
    """Distinct survey records that sequences are built for."""
    return surveys.select(
        *PIXEL_KEY,
        F.col("SrvvR_Date").cast("date").alias("SrvvR_Date"),
        F.col("Age").cast("int").alias("Age"),
        "Density",
        "Type",
        F.col("target").cast("double").alias("target"),
    ).dropDuplicates()


def split_tables(clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lookup, observations) of a clean table.

    Histories, lengths and lookups each read the records, so these are written once: the clean table is much larger.
    """
    return materialise(lookup(survey_long(clean))), observations(clean)


def add_one_hot(df: DataFrame, column: str, levels: Sequence[str], keep: bool = False) -> DataFrame:
    """Declared levels as 0/1 columns, emitted whether or not the level occurs."""
    encoded = df.select("*", *one_hot(F.col(column), levels, column))
    return encoded if keep else encoded.drop(column)


def union_tagged(frames: Sequence[tuple[dict[str, str], DataFrame]]) -> DataFrame:
    """Stack frames, adding the tags of each as literal columns."""
    tagged = [df.withColumns({name: F.lit(value) for name, value in tags.items()}) for tags, df in frames]
    return reduce(DataFrame.unionByName, tagged)


def complement(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``ids``."""
    return df.join(ids.select(key).dropDuplicates(), key, "left_anti")
