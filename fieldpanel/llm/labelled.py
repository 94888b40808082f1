"""What the trained operators share: a bounded sample of labelled rows, the held-out rule, models and their use."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpanel.llm import common


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """True if ``crc32`` of the id as text leaves the remainder ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: Sequence[tuple[Any, int]], apart: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, label`` of at most so many labelled rows of each class, in the order of a hash of their ids.

    Rows for which ``apart`` (a column over ``labels``) is true, null labels and null ids are left out, and the largest
    label counts where an id has several; a label without a document gives no row. The chosen ids are bounded by the given numbers, so they are broadcast and
    no text is shuffled to find them.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~apart).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).alias("label"))
    chosen = [known.filter(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(n) for value, n in per_class]
    ids = reduce(DataFrame.unionByName, chosen)
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return wanted.join(F.broadcast(ids), "id").dropDuplicates(["id"]).select("id", "text", "label")


def trained(rows: DataFrame, fit: Callable[[list[str], list], bytes]) -> bytes | None:
    """The model that one task fits on the bounded sample, in the order of ids; None if there are no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [(i, t, y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("id", "text", "label")), strict=True)]
        table.sort(key=lambda r: r[0])
        if table:
            yield pa.RecordBatch.from_arrays([pa.array([fit([r[1] for r in table], [r[2] for r in table])], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(found[0][0]) if found else None


def scored(docs: DataFrame, schema: str, score: Callable[[], Callable[[list[str]], Sequence[pa.Array]]], names: Sequence[str], carry: Sequence[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns of every row with what ``score()`` makes of the whole texts; null text counts as empty.

    ``score`` is called once per task and gives the function that scores a list of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = score()
        for batch in common.slices(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *use(common.texts(batch, "_text"))], names=[*carry, *names])

    return docs.select(*carry, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def kept(docs: DataFrame, keeps: Callable[[], Callable[[list[str]], Sequence[bool]]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose whole text passes, with their columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, at = keeps(), None
        for batch in common.slices(batches):
            at = batch.schema.names.index(text_col) if at is None else at
            texts = [x or "" for x in batch.column(at).cast(pa.string()).to_pylist()]
            yield batch.filter(pa.array(use(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
