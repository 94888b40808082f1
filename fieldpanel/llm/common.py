"""What the operators of this package share: stored stages, row batches, runs of equal keys."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task handles at once, whatever the size of Arrow's batches.
SLICE_ROWS = 512

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python can import it."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="llm-"), "llm_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in [package.parent / "__init__.py", *package.glob("*.py")]:
            out.write(source, source.relative_to(package.parent.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(spark.sparkContext.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only in a local session that has none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="llm-"))


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write the rows as Parquet and read them back: work behind them is done once and outlives lost executors."""
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column with null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def offsets_of(table: DataFrame, size: str, keys: Sequence[str]) -> DataFrame:
    """``keys..., base``: how much lies before each part of a stored table, in the order of the keys.

    One row per part and nothing else meets in the running sum. The result is stored, so that a join with it is
    broadcast only if Spark finds its file small, and shuffled otherwise.
    """
    from pyspark.sql import Window

    totals = table.groupBy(*keys).agg(F.sum(size).alias("total"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return stored(totals.select(*keys, F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"), "total"))


def runs(batches: Iterable[pa.RecordBatch], same: Callable[[pa.RecordBatch], object]) -> Iterator[pa.RecordBatch]:
    """Cut a sorted stream into batches that end where the key changes; a run over several batches is joined.

    ``same(batch)`` gives a NumPy array that is true at row i (from 1) if rows i - 1 and i have the same key.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            edge = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]).combine_chunks().to_batches()[0]
            if not same(edge)[1]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        flags = same(batch)
        changes = [i for i in (~flags).nonzero()[0].tolist() if i]
        if changes:
            cut = changes[-1]
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
