"""Shuffled batches of sequences and their padding, in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpanel.operators.history import STEP_FEATURES
from fieldpanel.operators.ordering import explode_range, hash_rank
from fieldpanel.schemas import RECORD_KEY


def shuffle_in_group(
    df: DataFrame, keys: Sequence[str], group: str = "Age", seed: int = 591, epoch: int = 0
) -> DataFrame:
    """Add ``position`` (from 0): groups ascending, seeded random order inside each, new for every epoch."""
    ranked = hash_rank(df, keys, f"{seed}:{epoch}", within=[group], rank="_rank", continuous=True)
    return ranked.select(*df.columns, (F.col("_rank") - 1).alias("position"))


def assign_batches(df: DataFrame, size: int = 32, min_batch: int = 32, position: str = "position") -> DataFrame:
    """Add ``batch``: consecutive positions, ``size`` (at least ``min_batch``) rows each."""
    return df.withColumn("batch", F.floor(F.col(position) / F.lit(max(min_batch, size))))


JOIN_CHUNK = 65_536


def sequence_lengths(records: DataFrame, steps: DataFrame, keys: Sequence[str] = tuple(RECORD_KEY)) -> DataFrame:
    """Records with ``sequence_length``; 1 where there are no steps."""
    lengths = steps.groupBy(*keys).agg(F.max("pos").alias("_len"))
    joined = records.join(lengths, list(keys), "left")
    return joined.withColumn("sequence_length", F.coalesce("_len", F.lit(1).cast("long"))).drop("_len")


def fetch_steps(
    records: DataFrame,
    steps: DataFrame,
    keys: Sequence[str] = tuple(RECORD_KEY),
    features: Sequence[str] = tuple(STEP_FEATURES),
    carry: Sequence[str] = (),
    join_chunk: int = JOIN_CHUNK,
) -> DataFrame:
    """Steps of each record; a record without any gets a single all-zero step.

    Records are listed once per ``join_chunk`` steps and the join runs on (keys, chunk), so the steps of a very
    long sequence are spread over several tasks.
    """
    keys = list(keys)

    def chunk(position: Column) -> Column:
        return F.floor((position - 1) / F.lit(join_chunk))

    sized = records if "sequence_length" in records.columns else sequence_lengths(records, steps, keys)
    listed = sized.select(
        *keys, *carry, F.explode(F.sequence(F.lit(0).cast("long"), chunk(F.col("sequence_length")))).alias("_chunk")
    )
    placed = steps.select(*keys, "pos", *features, chunk(F.col("pos")).alias("_chunk"))
    joined = listed.join(placed, [*keys, "_chunk"], "left")
    missing = F.col("pos").isNull()
    zero_filled = [F.when(missing, F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in features]
    return joined.select(*keys, *carry, F.coalesce("pos", F.lit(1).cast("long")).alias("pos"), *zero_filled)


def pad_batches(
    batched: DataFrame,
    steps: DataFrame,
    keys: Sequence[str] = tuple(RECORD_KEY),
    features: Sequence[str] = tuple(STEP_FEATURES),
) -> DataFrame:
    """Steps of all batches, zero-padded to the longest sequence of the batch.

    One row per (batch, batch_row, pos) with the ``sequence_length`` before padding; longer sequences come first
    in a batch. Real steps pass through unchanged and only the padding is generated.
    """
    keys = list(keys)
    sized = sequence_lengths(batched, steps, keys)
    batch = Window.partitionBy("batch")
    order = batch.orderBy(F.desc("sequence_length"), "position")
    rows = sized.select(
        *keys,
        "batch",
        "sequence_length",
        F.row_number().over(order).alias("batch_row"),
        F.max("sequence_length").over(batch).alias("_longest"),
    )
    carry = ["batch", "batch_row", "sequence_length"]
    real = fetch_steps(rows, steps, keys, features, carry)
    padding = explode_range(rows, F.col("sequence_length") + 1, F.col("_longest"), "pos").select(
        *keys, *carry, "pos", *[F.lit(0.0).alias(c) for c in features]
    )
    return real.unionByName(padding)
