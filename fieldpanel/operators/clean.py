"""Row rules of the cleaning step. Every rule is a filter or a projection: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpanel.functions.scalar import class_of_parts, composition_parts, overwrite_where, ratio
from fieldpanel.schemas import BOUNDED_INDICES, INDEX_COLS

# Columns that the cleaning step removes.
DROPPED_AFTER_CLEANING = ["NmbrPlO", "NmbrPlR", "NmbrPlT", "prevUse", "SpcsCmp", "PlantDt", "Year"]


def null_or_zero(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == 0)


def all_present(columns: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def not_before(column: str, other: str) -> Column:
    return F.col(column) >= F.col(other)


def all_between(columns: Sequence[str], low: float, high: float) -> Column:
    return reduce(and_, [F.col(c).between(low, high) for c in columns])


def keep_between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with a null in any of the columns (default: all columns) go."""
    return df.dropna(subset=list(columns) if columns is not None else None)


def cleaning_rules() -> list[tuple[str, Column]]:
    """The four row rules in order, as named predicates."""
    return [
        ("not_replanted", null_or_zero("NmbrPlR")),
        ("indices_present", all_present(INDEX_COLS)),
        ("not_before_planting", not_before("Year", "Season")),
        ("indices_in_range", all_between(BOUNDED_INDICES, -1.0, 1.0)),
    ]


def clean_rows(df: DataFrame, strict: bool = True) -> DataFrame:
    """Apply the row rules, recompute ``Type`` where no replanting is recorded, drop spent columns.

    The composition is parsed into helper columns first, once per row and only where it is needed.
    """
    for _, rule in cleaning_rules():
        df = df.filter(rule)
    unset = F.col("NmbrPlR").isNull()
    hard, soft = (F.when(unset, part) for part in composition_parts(F.col("SpcsCmp")))
    parsed = df.withColumns({"_hard": hard, "_soft": soft})
    from_parts = class_of_parts(F.col("_hard"), F.col("_soft"), F.col("SpcsCmp"), strict=strict)
    typed = parsed.withColumn("Type", overwrite_where(F.col("Type"), unset, from_parts))
    return typed.drop("_hard", "_soft", *DROPPED_AFTER_CLEANING)


def add_density(df: DataFrame) -> DataFrame:
    """Replace planted count and area by their ratio."""
    return df.withColumn("Density", ratio(F.col("Planted"), F.col("Area_ha"))).drop("Planted", "Area_ha")


def clean(df: DataFrame, strict: bool = True) -> DataFrame:
    return add_density(clean_rows(df, strict))


def rule_counts(df: DataFrame, rules: Sequence[tuple[str, Column]] | None = None) -> DataFrame:
    """Rows kept and removed after each rule in turn, from a single aggregation over the table."""
    rules = list(rules) if rules is not None else cleaning_rules()
    kept: list[Column] = [F.count(F.lit(1)).alias("k0")]
    so_far = F.lit(True)
    for i, (_, rule) in enumerate(rules, 1):
        so_far = so_far & rule
        kept.append(F.count(F.when(so_far, 1)).alias(f"k{i}"))
    steps = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(name).alias("rule"),
            F.col(f"k{i}").alias("kept"),
            (F.col(f"k{i - 1}") - F.col(f"k{i}")).alias("removed"),
        )
        for i, (name, _) in enumerate(rules, 1)
    ]
    return df.agg(*kept).select(F.inline(F.array(*steps)))
