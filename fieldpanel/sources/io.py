"""Reading and writing tables, statistics, curves and path-labelled files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import cache
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpanel.functions.scalar import nan_to_null, percent_label, title_label
from fieldpanel.schemas import RAW_SCHEMA, STATS_SCHEMA, check_schema, require_keys


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder name below the shared folder of the session.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, sessions in one process (tests) get a
    temporary folder that goes when Python ends; elsewhere it is an error, since executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share before the session starts")
        base = _local_folder(spark.sparkContext.applicationId)
    return f"{base}/{uuid.uuid4().hex}"


@cache
def _local_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"fieldpanel-{application}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once per application, for functions that run in their Python."""
    with _SHIPPING:  # fits run in several threads
        if spark.sparkContext.applicationId in _SHIPPED:
            return
        top = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="fieldpanel-"), "fieldpanel_core.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for source in [top / "__init__.py", top / "schemas.py", *(p for part in ("functions", "ml", "operators", "sources") for p in (top / part).glob("*.py"))]:
                out.write(source, source.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(spark.sparkContext.applicationId)


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table, under a declared schema where given; asked columns only reach the reader."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns is not None else df


def save(df: DataFrame, path: str, mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    """Write Parquet. Files of a partition value come from all tasks, so a large value is not one task's work."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def ingest_raw(
    spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, file_format: str = "parquet", keys: Sequence[str] = ("ID", "PixelID")
) -> DataFrame:
    """Exported raw table under its declared schema: column order kept, NaN read as null, null keys refused."""
    if file_format == "csv":
        df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    elif file_format == "parquet":
        have = spark.read.parquet(path)
        check_schema(have, schema)
        df = have.select(*schema.fieldNames())
    else:
        raise ValueError("file_format must be 'parquet' or 'csv'")
    return require_keys(nan_to_null(df), keys)


def save_stats(stats: DataFrame, path: str) -> None:
    """The statistics row as JSON: ``{"mean": {column: x}, "std": {column: x}}``."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(STATS_SCHEMA).json(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no statistics at {path}") from error


def stats_for(spark: SparkSession, path: str, compute: Callable[[], DataFrame] | None) -> DataFrame:
    """Compute and save the statistics, or (``compute=None``) load the saved ones."""
    if compute is not None:
        save_stats(compute(), path)
    return load_stats(spark, path)


def save_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def load_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """CSV under a declared schema; a header that names or orders the columns otherwise is an error."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(paths)


def with_path_labels(df: DataFrame, suffix: str) -> DataFrame:
    """Add ``Threshold`` and ``Model`` taken from ``.../<threshold>/<model>_<suffix>/<file>`` paths."""
    path = F.col("_metadata.file_path")
    pattern = rf"/([^/]+)/([^/]+)_{suffix}(?:\.csv)?(?:/[^/]*)?$"
    return df.select(
        "*",
        percent_label(F.regexp_extract(path, pattern, 1)).alias("Threshold"),
        title_label(F.regexp_extract(path, pattern, 2)).alias("Model"),
    )


#: Set while a frame is written: the files that its shuffles left go when the write ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITES: dict[str, list] = {}  # application -> writes under way, the setting before them
_WRITING = threading.Lock()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, queries free their shuffle files when they end, not when their plans are collected as garbage."""
    with _WRITING:  # fits write in several threads
        under_way = _WRITES.setdefault(spark.sparkContext.applicationId, [0, None])
        if not under_way[0]:
            under_way[1] = spark.conf.get(FREE_SHUFFLES, "false")
            spark.conf.set(FREE_SHUFFLES, "true")
        under_way[0] += 1
    try:
        yield
    finally:
        with _WRITING:
            under_way[0] -= 1
            if not under_way[0]:
                spark.conf.set(FREE_SHUFFLES, under_way[1])


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    For tables that several jobs use: the work behind them is done once, and a lost executor costs a re-read. What was
    shuffled for the frame leaves the disk once it is written.
    """
    path = scratch_dir(df.sparkSession)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
