"""Cardinality and heavy hitters of categories as sketches that can be stored and merged.

Sketches of parts of a table are rows of a table themselves. Their union is the sketch of all parts, so new rows need no
scan of old ones. A HyperLogLog sketch of 2 ** lg_k cells estimates a distinct count with a relative standard error of
about 1.04 / sqrt(2 ** lg_k); a top-k sketch is exact up to its number of tracked items, and may be empty beyond it.
:func:`category_counts` is exact for any number of items.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12
TRACKED = 10_000


def relative_error(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    return deviations * 1.04 / math.sqrt(2**lg_k)


def category_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), lg_k: int = LG_K, tracked: int = TRACKED) -> DataFrame:
    """``by..., column, n, cells, items``: rows with a value and both sketches of each column, in one pass."""
    by = list(by)
    each = lambda c: (F.count(c).alias(f"n_{c}"), F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(f"h_{c}"), F.expr(f"approx_top_k_accumulate(CAST(`{c}` AS string), {tracked})").alias(f"t_{c}"))
    wide = df.groupBy(*by).agg(*[x for c in cols for x in each(c)])
    entry = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.col(f"h_{c}").alias("cells"), F.col(f"t_{c}").alias("items"))
    return wide.select(*by, F.inline(F.array(*map(entry, cols))))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), tracked: int = TRACKED) -> DataFrame:
    """One pair of sketches per ``by`` and column."""
    return sketches.groupBy(*by, "column").agg(F.sum("n").alias("n"), F.hll_union_agg("cells").alias("cells"), F.expr(f"approx_top_k_combine(items, {tracked})").alias("items"))


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, item, n``: rows of every value, counted whole. One shuffle of counts, however many values there are."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("item")) for c in cols])
    return df.select(F.inline(items)).filter(F.col("item").isNotNull()).groupBy("column", "item").agg(F.count(F.lit(1)).alias("n"))


def exact_categories(counts: DataFrame) -> DataFrame:
    """``column, distinct, top``: number of values, and the most frequent one (the lesser of equals) with its rows."""
    first = F.min(F.struct((-F.col("n")).alias("_n"), "item")).alias("_first")
    whole = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), first)
    return whole.select("column", "distinct", F.struct("_first.item", (-F.col("_first._n")).alias("count")).alias("top"))


def category_estimates(sketches: DataFrame, top: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """``by..., column, n, distinct, top``: estimated distinct values, and the most frequent ones with their counts.

    ``top`` holds the items that are surely frequent; with more values than tracked it can be empty.
    """
    return sketches.select(*by, "column", "n", F.hll_sketch_estimate("cells").alias("distinct"), F.expr(f"approx_top_k_estimate(items, {top})").alias("top"))
