"""Sequences on disk, addressed by their key.

Rows are dealt into files by ranges of the key and sorted within them, so a key's chunks lie together, the minima and
maxima of row groups hardly overlap, and a Bloom filter per row group answers for keys between them. A batch of keys is
read by equality, which Parquet checks against those before it opens a row group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that one read asks for; more are for a join.
BATCH_KEYS = 1024


def write_store(chunks: DataFrame, path: str, key: str = "filename", row_group_bytes: int = 4 << 20, keys_per_group: int = 10_000, files: int | None = None, mode: str = "error") -> None:
    """Write chunks (``key, chunk, seq`` and other columns) clustered by key; ``files`` is the number of ranges."""
    order = [F.col(key), F.col("chunk")]
    dealt = chunks.repartitionByRange(files, *order) if files else chunks.repartitionByRange(*order)
    writer = dealt.sortWithinPartitions(*order).write.mode(mode)
    options = {"parquet.block.size": row_group_bytes, f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": keys_per_group}
    writer.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def fetch_batch(spark: SparkSession, path: str, keys: Sequence[str], key: str = "filename", columns: Sequence[str] = ("chunk", "seq")) -> DataFrame:
    """``key, columns...`` of the asked keys, repeated keys once; unknown keys have no rows.

    The keys reach the reader as equalities, each of which is checked against row group statistics and Bloom filters.
    """
    asked = sorted({k for k in keys if k is not None})
    if len(asked) > BATCH_KEYS:
        raise ValueError(f"a batch asks for {BATCH_KEYS} keys at most, got {len(asked)}; join larger sets")
    stored = spark.read.parquet(path)
    wanted = reduce(lambda a, b: a | b, [F.col(key) == F.lit(k) for k in asked], F.lit(False))
    return stored.filter(wanted).select(key, *columns)


def rows_scanned(result: DataFrame) -> int:
    """Rows of the row groups and pages that a collected result of :func:`fetch_batch` has read."""
    leaves = result._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))
