"""Global order without a global sort in one task.

A seeded order over rows is the order of ``md5(key:seed)``. The leading hex digits of a hash split the rows
into evenly filled blocks whatever the data looks like, so a rank is the rank inside the block plus the number
of rows in earlier blocks. Only the block sizes (at most ``16 ** digits`` rows per group) are summed up in one
place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DIGITS = 3


def hash_order(keys: Sequence[str], seed: int | str) -> Column:
    """``md5`` of the keys and the seed, joined by colons."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))


def _block_offsets(blocks: DataFrame, within: Sequence[str]) -> DataFrame:
    """Rows before each block, and in all blocks, of its group (``_before``, ``_total``)."""
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumns(
        {"_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), "_total": F.sum("_rows").over(group)}
    )


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    seed: int | str,
    within: Sequence[str] = (),
    digits: int = BLOCK_DIGITS,
    rank: str = "rank",
    total: str | None = None,
    continuous: bool = False,
) -> DataFrame:
    """Number the rows 1..n in seeded order, per group of ``within`` where given.

    ``keys`` must identify a row. Groups may be very large. ``continuous`` numbers on through the groups in
    ascending group order, for groups that are few (the levels of a category).
    """
    within = list(within)
    hashed = df.withColumn("_hash", hash_order(keys, seed)).withColumn("_block", F.substring("_hash", 1, digits))
    blocks = _block_offsets(hashed.groupBy(*within, "_block").agg(F.count(F.lit(1)).alias("_rows")), within)
    if continuous:
        groups = blocks.groupBy(*within).agg(F.sum("_rows").alias("_rows"))
        earlier = Window.partitionBy(F.lit(0)).orderBy(*within).rowsBetween(Window.unboundedPreceding, -1)
        starts = groups.select(*within, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
        blocks = blocks.join(starts, within, "inner").withColumn("_before", F.col("_before") + F.col("_start"))
    inside = F.row_number().over(Window.partitionBy(*within, "_block").orderBy("_hash", *keys))
    ranked = hashed.withColumn("_inside", inside).join(blocks, [*within, "_block"], "inner")
    extra = [F.col("_total").alias(total)] if total else []
    return ranked.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(rank), *extra)


def hash_cutoffs(
    df: DataFrame,
    key: str,
    seed: int | str,
    wanted: Callable[[Column], Column],
    digits: int = BLOCK_DIGITS,
) -> DataFrame:
    """One row holding the ascending hashes that stand at the wanted ranks of the distinct keys.

    ``wanted`` maps the number of keys to an array of ranks. Comparing a row's hash with a cutoff decides its
    side without joining the rows to a list of keys, so a key that owns a large part of the table costs nothing
    extra. Only the blocks that contain a wanted rank are sorted.
    """
    hashed = df.select(key).dropDuplicates().select(hash_order([key], seed).alias("_hash"))
    hashed = hashed.withColumn("_block", F.substring("_hash", 1, digits))
    blocks = _block_offsets(hashed.groupBy("_block").agg(F.count(F.lit(1)).alias("_rows")), [])
    targets = blocks.withColumn("_rank", F.explode(F.array_distinct(wanted(F.col("_total"))))).filter(
        (F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_rows"))
    )
    # The targets are at most as many as the wanted ranks, a number given by the caller.
    candidates = hashed.join(F.broadcast(targets), "_block", "inner")
    inside = F.row_number().over(Window.partitionBy("_block", "_rank").orderBy("_hash"))
    hits = candidates.withColumn("_inside", inside).filter(F.col("_before") + F.col("_inside") == F.col("_rank"))
    return hits.agg(F.sort_array(F.collect_list("_hash")).alias("_cutoffs"))


def with_cutoffs(df: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Attach the single cutoff row to every row (map side only)."""
    return df.crossJoin(F.broadcast(cutoffs))


def explode_range(df: DataFrame, low: Column, high: Column, name: str, step: int = 4096) -> DataFrame:
    """One row per integer of [low, high]; nothing for an empty range.

    Expanded in two levels so that no row ever holds an array longer than ``step``, or than the range over ``step``.
    """
    ranged = df.withColumns({"_low": low, "_high": high}).filter(F.col("_high") >= F.col("_low"))
    starts = ranged.withColumn("_start", F.explode(F.sequence("_low", "_high", F.lit(step).cast("long"))))
    stop = F.least(F.col("_start") + (step - 1), F.col("_high"))
    return starts.withColumn(name, F.explode(F.sequence("_start", stop))).drop("_low", "_high", "_start")
