"""Whitening of embeddings by shifted CholeskyQR.

The rows are the distinct vectors, centred. A pass over them sums a Gram matrix per task, adds the sums, and takes the
Cholesky factor R of the total; the next pass solves every row against that factor, so that Q = Y / R is nearer to
orthogonal, and sums again. The first Gram matrix gets a small shift, which keeps it positive definite however
ill-conditioned the rows are. All factors compose to one R with Y = Q R; the singular values and right singular vectors
of R are the deviations and directions of Y. Only d x d matrices reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpanel.llm import common

#: Passes at most; three are enough for full rank, and more do no harm where the rank is short.
PASSES = 6
#: Rows that are solved at once in a task.
ROWS = 4096


def whole_numbers(vector: Column, factor: int = 64, base: int = 1_000_000) -> Column:
    """``floor(factor * c) + base`` of every entry c as a double.

    Null if the vector is null or has an entry that is null or not finite, or too large for a long.
    """
    entries = F.transform(vector, lambda c: c.cast("double"))
    usable = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**62 / factor))
    return F.when(usable, F.transform(entries, lambda c: F.floor(c * factor) + base))


def solve_rows(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """X with X R = rows for an upper triangular R, column by column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _entries(column: pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


class Centre:
    """Exact sums of a fit list of n vectors; centred rows without cancellation."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: integers are subtracted before the fraction."""
        return (x - self.whole).astype(np.float64) - self.rest


def _gram(fit: DataFrame, width: int, project: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of the outer products of the projected rows of ``x``; every task adds its own rows up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in common.slices(batches, ROWS):
            q = project(_entries(batch.column("x"), width))
            total += q.T @ q
        cells = [pa.array(np.repeat(np.arange(size), size)), pa.array(np.tile(np.arange(size), size)), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(cells, names=["i", "j", "v"])

    parts = fit.select("x").mapInArrow(run, "i long, j long, v double")
    out = np.zeros((size, size))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():  # size x size cells
        out[i, j] = v
    return (out + out.T) / 2


def _sums(fit: DataFrame, width: int) -> Centre:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in common.slices(batches, ROWS):
            rows = _entries(batch.column("x"), width)
            # Halves of the numbers, so that no sum of a batch leaves 64 bits.
            total += (rows >> 32).sum(0).astype(object) * (1 << 32) + (rows & 0xFFFFFFFF).sum(0).astype(object)
            n += len(rows)
        cells = [pa.array(range(-1, width), pa.int64()), pa.array([str(v) for v in [n, *total]], pa.string())]
        yield pa.RecordBatch.from_arrays(cells, names=["i", "v"])

    parts = fit.select("x").mapInArrow(run, "i long, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {i: int(v) for i, v in parts.collect()}  # one number per dimension
    return Centre(found[-1], [found[i] for i in range(width)])


def triangular_factors(gram: Callable[[list[np.ndarray]], np.ndarray], n: int, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Factors R1, R2, ... of Y, and the Gram matrix of Y / R1 / R2 ... that is left after them.

    ``gram(factors)`` is the pass over the rows. The shift of the first pass is the one that guarantees success; a later
    Gram matrix gets one only if rows of short rank leave it without a Cholesky factor.
    """
    unit = np.finfo(np.float64).eps / 2
    factors: list[np.ndarray] = []
    while True:
        total = gram(factors)
        if factors and (np.abs(total - np.eye(width)).max() < 8 * width * unit or len(factors) == PASSES):
            return factors, total
        shift = 11 * (width * n + width * (width + 1)) * unit * max(np.linalg.norm(total, 2), np.finfo(np.float64).tiny)
        try:
            lower = np.linalg.cholesky(total if factors else total + shift * np.eye(width))
        except np.linalg.LinAlgError:
            lower = np.linalg.cholesky(total + shift * np.eye(width))
        factors.append(lower.T)


def directions(factors: list[np.ndarray], left: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of the covariance, falling, without those that rounding alone makes.

    The rows equal Q R with R the product of the factors; where Q is not quite orthogonal, the root of its Gram matrix
    goes with R. The sign makes the largest entry of a vector positive.
    """
    composed = factors[0]
    for factor in factors[1:]:
        composed = factor @ composed
    value, vector = np.linalg.eigh(left)
    root = np.sqrt(np.clip(value, 0, None))[:, None] * vector.T
    _, deviation, right = np.linalg.svd(root @ composed)
    kept = deviation > max(width, 16) * np.finfo(np.float64).eps * deviation[0] if deviation[0] > 0 else deviation > 0
    right = right[kept]
    largest = right[np.arange(len(right)), np.abs(right).argmax(1)]
    return deviation[kept] ** 2 / n, (right * np.sign(largest)[:, None]).T


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "x") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: every row on up to so many components.

    ``vector_col`` holds arrays of whole numbers. The fit list has each distinct array once; n, the centre and the
    components come from it. ``deviation`` is the exact sum of (n x - S)^2, ``whitened`` has variance one and no
    correlation over the fit list, and ``identity_error`` is how far its measured covariance there is from that.

    Rows whose array is null or holds a null are dropped. Null ids and repeated rows stay; other columns are ignored.
    Arrays of different lengths are different spaces: each length is fitted by itself. Directions without variance have
    no component, so equal rows alone, and an empty table, give no rows. A deviation that no long holds is null.
    """
    common.ship(vectors.sparkSession)
    x = F.col(vector_col).cast("array<bigint>")
    usable = vectors.select(F.col(id_col).alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull()) & (F.size("x") > 0))
    fit = common.stored(usable.select("x", F.size("x").alias("width")).distinct())
    widths = sorted(r[0] for r in fit.select("width").distinct().collect())
    schema = f"vec_id {usable.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = vectors.sparkSession.createDataFrame([], schema)
    for width in widths:
        part = _whiten_width(usable.filter(F.size("x") == width), fit.filter(F.col("width") == width), width, components, schema)
        out = part if len(widths) == 1 else out.unionByName(part)
    return out


def _whiten_width(usable: DataFrame, fit: DataFrame, width: int, components: int, schema: str) -> DataFrame:
    centre = _sums(fit, width)
    n = centre.n

    def orthogonal(factors: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        def project(x: np.ndarray) -> np.ndarray:
            rows = centre.rows(x)
            for factor in factors:
                rows = solve_rows(rows, factor)
            return rows

        return project

    factors, left = triangular_factors(lambda found: _gram(fit, width, orthogonal(found), width), n, width)
    variance, vector = directions(factors, left, n, width)
    few = min(components, len(variance))
    scaled = vector[:, :few] / np.sqrt(variance[:few])
    explained = variance[:few] / variance.sum() if few else variance
    error = float(np.abs(_gram(fit, width, lambda x: centre.rows(x) @ scaled, few) / n - np.eye(few)).max()) if few else 0.0
    # n x - S from the centre, so that neither n x nor S has to fit a long.
    parts = F.array(*[F.lit(int(w)).cast("long") for w in centre.whole]), F.array(*[F.lit(s % n).cast("long") for s in centre.sums])
    gaps = F.zip_with(F.zip_with("x", parts[0], lambda a, w: F.try_multiply(F.try_subtract(a, w), F.lit(n).cast("long"))), parts[1], lambda a, r: F.try_subtract(a, r))
    deviation = F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: F.try_add(total, F.try_multiply(g, g)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, ROWS):
            rows = batch.num_rows
            values = centre.rows(_entries(batch.column("x"), width)) @ scaled
            each = pa.array(np.repeat(np.arange(rows), few))
            cols = [
                batch.column("vec_id").take(each),
                pa.array(np.tile(np.arange(1, few + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * few, n)),
                batch.column("deviation").take(each),
                pa.array(values.ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * few, error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.withColumn("deviation", deviation).mapInArrow(run, schema)
