"""Mean, deviation and correlation as states that can be stored, merged and updated.

A state holds a count, a mean and a sum of squared (or multiplied) deviations. States of disjoint rows merge exactly: the
counts add up, and so do the deviations together with what the means differ from the mean of all. So new rows need no
scan of old ones, and any partition of the rows gives the statistics of one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpanel.sources.io import ship

STATE_SCHEMA = "column string, n long, mean double, m2 double"


def moment_state(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by..., column, n, mean, m2`` of each column over its values, nulls left out; in one pass."""
    fields = [x for c in cols for x in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"a_{c}"), F.var_pop(c).alias(f"v_{c}"))]
    wide = df.groupBy(*by).agg(*fields)
    entry = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.coalesce(F.col(f"a_{c}").cast("double"), F.lit(0.0)).alias("mean"), F.coalesce(F.col(f"v_{c}") * F.col(f"n_{c}"), F.lit(0.0)).alias("m2"))
    return wide.select(*by, F.inline(F.array(*map(entry, cols))))


def merge_moments(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state per ``by`` and column out of states of disjoint rows. Many states of a column are merged by partial sums."""
    key = [*by, "column"]
    whole = states.groupBy(*key).agg(F.sum("n").alias("total"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("centre"))
    gap = F.col("mean") - F.col("centre")
    joined = states.join(whole.select(*[F.col(k).alias(f"_{k}") for k in key], "total", "centre"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    merged = joined.groupBy(*key, "total", "centre").agg(F.sum(F.col("m2") + F.when(F.col("n") > 0, F.col("n") * gap * gap).otherwise(0.0)).alias("m2"))
    return merged.select(*key, F.col("total").alias("n"), F.coalesce("centre", F.lit(0.0)).alias("mean"), "m2")


def stats_of_state(state: DataFrame) -> DataFrame:
    """One row ``mean, std`` of maps by column (sample deviation; null where there are too few values)."""
    rated = state.select("column", F.when(F.col("n") > 0, F.col("mean")).alias("m"), F.sqrt(F.try_divide(F.col("m2"), F.when(F.col("n") > 1, F.col("n") - 1))).alias("s"))
    pairs = lambda c: F.map_from_entries(F.collect_list(F.struct("column", c)))
    return rated.agg(pairs("m").alias("mean"), pairs("s").alias("std"))


def add_to_state(spark: SparkSession, path: str, fresh: DataFrame) -> DataFrame:
    """Append the state of new rows to the stored ones and return the merged state. Stored rows are read, data are not."""
    fresh.select("column", "n", "mean", "m2").coalesce(1).write.mode("append").parquet(path)
    return merge_moments(spark.read.schema(STATE_SCHEMA).parquet(path))


def compact_state(spark: SparkSession, path: str, target: str) -> None:
    """Write the merged state of ``path`` to another folder, as one row per column."""
    merge_moments(spark.read.schema(STATE_SCHEMA).parquet(path)).coalesce(1).write.parquet(target)


# --- pairs of columns ----------------------------------------------------------------------------------------


class _Pairs:
    """Running co-moments of all column pairs over the rows in which both have a value."""

    def __init__(self, width: int):
        self.n, self.x, self.y, self.xx, self.yy, self.xy = (np.zeros((width, width)) for _ in range(6))

    def add(self, values: np.ndarray) -> None:
        there = (~np.isnan(values)).astype(np.float64)
        # Any centre near the values keeps the products small.
        centre = np.where(there.sum(0) > 0, np.nansum(values, 0) / np.maximum(there.sum(0), 1), 0.0)
        v = np.where(there > 0, values - centre, 0.0)
        n = there.T @ there
        some = np.maximum(n, 1)
        sx, sy = v.T @ there, there.T @ v
        xx, yy, xy = (v * v).T @ there - sx * sx / some, there.T @ (v * v) - sy * sy / some, v.T @ v - sx * sy / some
        self.merge(n, centre[:, None] + sx / some, centre[None, :] + sy / some, xx, yy, xy)

    def merge(self, n, x, y, xx, yy, xy) -> None:
        total = np.maximum(self.n + n, 1)
        dx, dy, part = x - self.x, y - self.y, self.n * n / total
        self.xx += xx + dx * dx * part
        self.yy += yy + dy * dy * part
        self.xy += xy + dx * dy * part
        self.x += dx * n / total
        self.y += dy * n / total
        self.n += n


def co_moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by..., i, j, n, x, y, xx, yy, xy``: states of all column pairs i < j, one per task and group, in one pass.

    ``n`` counts rows in which both have a value, ``x`` and ``y`` are the means there, the rest are sums of products of
    deviations. A task holds one matrix per group that it meets.
    """
    ship(df.sparkSession)
    cols, by, width = list(cols), list(by), len(cols)
    first, second = np.triu_indices(width, 1)
    groups = df.select(*by).schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Pairs] = {}
        types = None
        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in cols]) if cols else np.zeros((batch.num_rows, 0))
            code = np.zeros(batch.num_rows, np.int64)
            for c in by:
                coded = batch.column(c).dictionary_encode("encode")
                code = code * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False)
            _, at, which = np.unique(code, return_index=True, return_inverse=True)
            for g, k in enumerate(at.tolist()):
                key = tuple(batch.column(c)[k].as_py() for c in by)
                held.setdefault(key, _Pairs(width)).add(values[which == g])
        for key, pairs in held.items():
            keyed = [pa.array([v] * len(first), t) for v, t in zip(key, types, strict=True)]
            sums = [pa.array(m[first, second]) for m in (pairs.n, pairs.x, pairs.y, pairs.xx, pairs.yy, pairs.xy)]
            yield pa.RecordBatch.from_arrays([*keyed, pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), *sums], names=[*by, "i", "j", "n", "x", "y", "xx", "yy", "xy"])

    target = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in groups) + "i int, j int, n double, x double, y double, xx double, yy double, xy double"
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).mapInArrow(run, target)


def merge_co_moments(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state per group and pair out of states of disjoint rows."""
    key = [*by, "i", "j"]
    mean = lambda c: F.try_divide(F.sum(F.col("n") * F.col(c)), F.sum("n"))
    whole = states.groupBy(*key).agg(F.sum("n").alias("total"), mean("x").alias("cx"), mean("y").alias("cy"))
    whole = whole.select(*[F.col(k).alias(f"_{k}") for k in key], "total", "cx", "cy")
    joined = states.filter("n > 0").join(whole, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    sums = [F.sum(F.col(c) + F.col("n") * gap).alias(c) for c, gap in (("xx", dx * dx), ("yy", dy * dy), ("xy", dx * dy))]
    return joined.groupBy(*key, "total", "cx", "cy").agg(*sums).select(*key, F.col("total").alias("n"), F.col("cx").alias("x"), F.col("cy").alias("y"), "xx", "yy", "xy")


def correlation_of(state: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by..., left, right, corr`` of the pairs; null where a column does not vary."""
    name = F.array(*[F.lit(c) for c in cols])
    corr = F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))
    return state.select(*by, name[F.col("i")].alias("left"), name[F.col("j")].alias("right"), corr.alias("corr"))
