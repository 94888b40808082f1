"""Data-quality shares, missingness, categories, seasonal and age profiles, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpanel.operators.clean import all_between, all_present
from fieldpanel.operators.moments import co_moments, correlation_of, merge_co_moments
from fieldpanel.operators.reshape import unpivot_repeated
from fieldpanel.schemas import AGES, AGRICULTURAL_USES, BOUNDED_INDICES, INDEX_COLS, RATE_COLS


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def quality_shares(raw: DataFrame) -> DataFrame:
    """One row of percentages (agricultural sites as a share of 1).

    Row and site figures come from one aggregation by site followed by a total. Duplicate surveys of a site
    collapse map-side before the invalid ones are counted.
    """

    def rows_where(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    in_range = all_between(BOUNDED_INDICES, -1.0, 1.0)
    per_site = raw.groupBy("ID").agg(
        F.count(F.lit(1)).alias("rows"),
        rows_where(F.col("NmbrPlR") > 0).alias("replanted"),
        (F.avg("NmbrPlR") > 0).alias("replanted_site"),
        rows_where(in_range).alias("in_range"),
        rows_where(all_present(INDEX_COLS)).alias("complete"),
        rows_where(F.col("Year") < F.col("Season")).alias("early"),
        (rows_where(F.col("prevUse").isin(AGRICULTURAL_USES)) > 0).alias("agricultural"),
    )
    rows = F.sum("rows")
    shares = per_site.agg(
        percent(F.sum("replanted"), rows).alias("replanted_rows_pct"),
        percent(rows_where(F.col("replanted_site")), F.count(F.lit(1))).alias("replanted_sites_pct"),
        percent(rows - F.sum("in_range"), rows).alias("out_of_range_pct"),
        percent(rows - F.sum("complete"), rows).alias("missing_pct"),
        percent(F.sum("early"), rows).alias("pre_planting_pct"),
        F.try_divide(rows_where(F.col("agricultural")), F.count(F.lit(1))).alias("agricultural_share"),
    )
    sites = raw.select("ID", *RATE_COLS).dropDuplicates()
    surveys = unpivot_repeated(sites, ["ID"], RATE_COLS, AGES, "Age", "target")
    valid = rows_where(F.col("target").between(0, 100))
    bad = surveys.agg(percent(F.count(F.lit(1)) - valid, F.count(F.lit(1))).alias("bad_survey_pct"))
    return shares.crossJoin(bad)


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, present, missing, missing_share), from one aggregation."""
    columns = list(columns or df.columns)
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)])
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("present"),
            (F.col("_rows") - F.col(f"n{i}")).alias("missing"),
            F.try_divide((F.col("_rows") - F.col(f"n{i}")).cast("double"), F.col("_rows")).alias("missing_share"),
        )
        for i, c in enumerate(columns)
    ]
    return counted.select(F.inline(F.array(*entries)))


def category_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, classes, dominant, dominant_share) over non-null values; ties go to the larger name."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    counts = (
        df.select(F.inline(F.array(*entries)))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("classes"),
        F.max_by("value", F.struct("n", "value")).alias("dominant"),
        (F.max("n") / F.sum("n")).alias("dominant_share"),
    )


def mean_profile(df: DataFrame, by: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """Means and row count by group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in value_cols])


def seasonal_profile(df: DataFrame, value_cols: Sequence[str] = tuple(INDEX_COLS), date: str = "ImgDate") -> DataFrame:
    return mean_profile(df.withColumn("month", F.month(date)), ["month"], value_cols)


def group_numeric_mean(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of every numeric column by group."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in by]
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numeric])


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """(by, left, right, corr): all pairs in one pass, by co-moments that tasks sum up and Spark merges."""
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    found = correlation_of(merge_co_moments(co_moments(df, cols, by), by), cols, by)
    place = {c: k for k, c in enumerate(cols)}
    # States hold each pair once, in the order of the columns.
    turned = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.lit(cols[min(place[a], place[b])]).alias("_a"), F.lit(cols[max(place[a], place[b])]).alias("_b")) for a, b in pairs])
    asked = df.sparkSession.range(1).select(F.inline(turned))
    named = found.select(*by, F.col("left").alias("_a"), F.col("right").alias("_b"), "corr")
    return named.join(F.broadcast(asked), ["_a", "_b"]).select(*by, "left", "right", "corr")
