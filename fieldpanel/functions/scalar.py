"""Column expressions; all built from JVM functions."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in every floating column, keeping the column order."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns]
    )


def composition_parts(composition: Column) -> tuple[Column, Column]:
    """The two numbers of a ``'HW a, SW b'`` string; null where it does not parse."""
    # Fixed value: the format of a composition string.
    pattern = r"^\s*HW\s*(\d+)\s*,\s*SW\s*(\d+)\s*$"
    first, second = (F.regexp_extract(composition, pattern, i).try_cast("int") for i in (1, 2))
    return first, second


def class_of_parts(
    hard: Column,
    soft: Column,
    shown: Column,
    cut: float = 0.8,
    hard_level: str = "Decidous",
    soft_level: str = "Conifer",
    mixed_level: str = "Mixed",
    strict: bool = True,
) -> Column:
    """Class by the share of either part.

    Strict mode fails where a part is missing or both are 0, quoting ``shown``; otherwise both give null.
    """
    total = hard + soft
    known = (
        F.when(hard / total >= cut, F.lit(hard_level))
        .when(soft / total >= cut, F.lit(soft_level))
        .otherwise(F.lit(mixed_level))
    )
    if strict:
        quoted = F.coalesce(shown, F.lit("null"))
        no_parse = F.raise_error(F.concat(F.lit("composition does not parse: "), quoted))
        no_total = F.raise_error(F.concat(F.lit("composition sums to zero: "), quoted))
    else:
        no_parse = no_total = F.lit(None)
    return F.when(total.isNull(), no_parse).when(total == 0, no_total).otherwise(known)


def composition_class(composition: Column, strict: bool = True, **levels) -> Column:
    """:func:`class_of_parts` of a composition string."""
    return class_of_parts(*composition_parts(composition), composition, strict=strict, **levels)


def overwrite_where(current: Column, condition: Column, replacement: Column) -> Column:
    return F.when(condition, replacement).otherwise(current)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient; null where the denominator is 0."""
    return F.try_divide(numerator, denominator)


def log_days(later: Column, earlier: Column) -> Column:
    """Natural logarithm of one plus the days from ``earlier`` to ``later``."""
    return F.log1p(F.datediff(later, earlier))


def seasonal_cosine(day_of_year: Column, period: int = 365) -> Column:
    """Negative cosine of the position in the year: lowest in January, highest in July."""
    return -F.cos(F.lit(2 * math.pi) * day_of_year / F.lit(period))


def check_threshold(threshold: float | None) -> float:
    if threshold is None:
        raise ValueError("a threshold between 0 and 1 is required")
    if not 0 <= threshold <= 1:
        raise ValueError(f"the threshold must lie between 0 and 1, got {threshold}")
    return float(threshold)


def below_threshold_label(value: Column, threshold: float | None) -> Column:
    """0 where ``value`` is below ``100 * threshold``, else 1 (a null value gives 1)."""
    limit = check_threshold(threshold) * 100
    return F.when(value < F.lit(limit), F.lit(0)).otherwise(F.lit(1))


def zscore(value: Column, mean: Column, std: Column, zero_std: str = "null") -> Column:
    """``(value - mean) / std``; a zero deviation gives null or, on request, 0."""
    if zero_std not in ("null", "zero"):
        raise ValueError("zero_std must be 'null' or 'zero'")
    scaled = F.try_divide(value - mean, std)
    return F.when((std == 0) & value.isNotNull(), F.lit(0.0)).otherwise(scaled) if zero_std == "zero" else scaled


def record_key(parts: Sequence[Column], date: Column, suffix: str = ".parquet") -> Column:
    """``<part>_<part>_<yyyy-MM-dd><suffix>``, the address of one record's sequence."""
    return F.concat(F.concat_ws("_", *parts, F.date_format(date, "yyyy-MM-dd")), F.lit(suffix))


def one_hot(column: Column, levels: Sequence[str], prefix: str) -> list[Column]:
    """0/1 columns for the declared levels; leave the reference level out of ``levels``."""
    return [F.when(column == v, 1).otherwise(0).alias(f"{prefix}_{v}") for v in levels]


def absolute_residual(truth: Column, prediction: Column) -> Column:
    return F.abs(truth - prediction)


def title_label(name: Column) -> Column:
    """``random_forest`` becomes ``Random Forest``."""
    return F.initcap(F.translate(name, "_", " "))


def percent_label(value: Column) -> Column:
    return F.concat(value.cast("string"), F.lit("%"))


def strip_prefix(df: DataFrame, pattern: str = r"^.*__") -> DataFrame:
    """Rename columns by removing what ``pattern`` matches (driver-side names only)."""
    return df.toDF(*[re.sub(pattern, "", c) for c in df.columns])


def round_columns(df: DataFrame, digits: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Round the floating columns, or the given ones."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    chosen = set(columns if columns is not None else floating)
    return df.select(*[F.round(c, digits).alias(c) if c in chosen else F.col(c) for c in df.columns])
