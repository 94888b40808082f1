"""Regression on ordered sequences: a fixed recurrence over the steps, and a fitted linear read-out.

The state of a sequence is h <- (1 - leak) h + leak tanh(A x + B h + c), folded over its steps from the oldest to the
latest, with weights that come from the seed alone. What is fitted are the means and deviations of the inputs and a ridge
regression on the last state, both by sums over the rows. Steps in another order give another state.

Sequences come in ordered chunks. A task folds the chunks of many sequences side by side and carries the state of a
sequence from one chunk to the next, so a long one needs no more memory than a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpanel.functions.scalar import below_threshold_label
from fieldpanel.operators.history import STEP_FEATURES, collect_steps
from fieldpanel.schemas import RECORD_KEY
from fieldpanel.sources.io import ship

SITE_COLS = ("Age", "Density", "Type_Conifer", "Type_Decidous")
#: Chunks that a task folds side by side.
ROWS = 512


@dataclass(frozen=True)
class Recurrence:
    """Weights of the fixed recurrence: sines of consecutive multiples of the seed, so that SQL can restate them.

    ``reach`` bounds the sum of the absolute weights of a unit on the state; below one, early steps fade.
    """

    units: int = 48
    leak: float = 0.3
    reach: float = 0.9
    seed: int = 591

    def weights(self, inputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input weights (units x inputs), state weights (units x units), offsets."""
        count = self.units * (inputs + self.units + 1)
        drawn = np.sin(self.seed * np.arange(1, count + 1, dtype=np.float64))
        a, b, c = np.split(drawn, [self.units * inputs, self.units * (inputs + self.units)])
        b = b.reshape(self.units, self.units)
        return a.reshape(self.units, inputs), self.reach * b / np.abs(b).sum(1, keepdims=True), c


def fold(state: np.ndarray, steps: np.ndarray, lengths: np.ndarray, weights: tuple[np.ndarray, np.ndarray, np.ndarray], leak: float) -> np.ndarray:
    """States (rows x units) after the first ``lengths`` steps (rows x steps x inputs) of every row."""
    a, b, c = weights
    order = np.argsort(-lengths, kind="stable")  # rows that still have steps come first
    state, steps, counts = state[order], steps[order], np.sort(lengths)
    for t in range(steps.shape[1]):
        now = len(counts) - np.searchsorted(counts, t, "right")
        held = state[:now]
        state[:now] = (1 - leak) * held + leak * np.tanh(steps[:now, t] @ a.T + held @ b.T + c)
    out = np.empty_like(state)
    out[order] = state
    return out


def last_states(chunks: DataFrame, inputs: Sequence[str], centre: Sequence[float], spread: Sequence[float], recurrence: Recurrence, keys: Sequence[str] = tuple(RECORD_KEY)) -> DataFrame:
    """``keys..., state``: the state after the last step of each sequence (``keys, chunk, seq``), inputs standardised.

    A step's missing value counts as the mean. The chunks of a sequence are sorted within one task.
    """
    ship(chunks.sparkSession)
    keys, weights = list(keys), recurrence.weights(len(inputs))
    middle, width = np.array(centre, np.float64), np.array(spread, np.float64)
    schema = chunks.select(*keys).schema
    target = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields) + ", state array<double>"

    def padded(seqs: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        offsets = seqs.offsets.to_numpy()
        lengths = np.diff(offsets)
        steps = seqs.values.slice(offsets[0], offsets[-1] - offsets[0])
        values = np.stack([steps.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in inputs], 1)
        out = np.zeros((len(seqs), lengths.max(initial=0), len(inputs)))
        out[np.arange(out.shape[1]) < lengths[:, None]] = np.nan_to_num((values - middle) / width)
        return out, lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # key and state of the sequence that the last rows belong to

        def emit(names: pa.RecordBatch, states: np.ndarray) -> pa.RecordBatch:
            offsets = pa.array(np.arange(len(states) + 1, dtype=np.int32) * recurrence.units)
            return pa.RecordBatch.from_arrays([*names.columns, pa.ListArray.from_arrays(offsets, pa.array(states.ravel()))], names=[*keys, "state"])

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n, names = batch.num_rows, batch.select(keys)
                steps, lengths = padded(batch.column("seq"))
                codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in names.columns]
                begins = np.append(True, np.any([c[1:] != c[:-1] for c in codes], axis=0))
                first = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
                turns = np.arange(n) - first  # place of a chunk among those of its sequence in this batch
                carried = held is not None and held[0].equals(names.slice(0, 1))
                states = np.zeros((n, recurrence.units))
                for r in range(turns.max() + 1):
                    now = np.nonzero(turns == r)[0]
                    start = states[now - 1] if r else np.zeros((len(now), recurrence.units))
                    if carried and r == 0:
                        start[0] = held[1]
                    states[now] = fold(start, steps[now], lengths[now], weights, recurrence.leak)
                if held is not None and not carried:
                    yield emit(held[0], held[1][None])
                ends = np.nonzero(begins[1:])[0]
                if len(ends):
                    yield emit(names.take(pa.array(ends)), states[ends])
                held = names.slice(n - 1, 1), states[n - 1]
        if held is not None:
            yield emit(held[0], held[1][None])

    dealt = chunks.select(*keys, "chunk", "seq").repartition(*keys).sortWithinPartitions(*keys, "chunk")
    return dealt.mapInArrow(run, target)


def normal_equations(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of z z' and of z y over the rows (``z array<double>, y double``); every task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total += z.T @ np.column_stack([z, batch.column("y").to_numpy(zero_copy_only=False)])
        cells = np.arange(width * (width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], names=["cell", "v"])

    out = np.zeros(width * (width + 1))
    for cell, v in rows.select("z", "y").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v")).collect():  # width squared
        out[cell] = v
    out = out.reshape(width, width + 1)
    return out[:, :width], out[:, width]


@dataclass(frozen=True)
class RecurrentRegressor:
    """Survey value from the order and the values of the steps; ``concat_features`` adds the site columns."""

    concat_features: bool = False
    recurrence: Recurrence = Recurrence()
    penalty: float = 1.0
    inputs: tuple[str, ...] = tuple(STEP_FEATURES)

    def _rows(self, lookup: DataFrame, steps: DataFrame, centre: Sequence[float], spread: Sequence[float]) -> DataFrame:
        """``steps`` hold no other records than ``lookup``."""
        states = last_states(collect_steps(steps, features=self.inputs), self.inputs, centre, spread, self.recurrence)
        site = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in SITE_COLS] if self.concat_features else []
        return lookup.join(states, RECORD_KEY, "inner").withColumn("z", F.concat(F.array(F.lit(1.0), *site), "state"))

    def fit(self, lookup: DataFrame, steps: DataFrame) -> RecurrentModel:
        """``lookup`` (record key, site columns, target) and ``steps`` as :func:`sequence_tables` gives them."""
        known = steps.join(lookup.select(*RECORD_KEY), RECORD_KEY, "left_semi")
        moments = known.agg(*[F.avg(c) for c in self.inputs], *[F.stddev_pop(c) for c in self.inputs]).first()
        n = len(self.inputs)
        centre = [m or 0.0 for m in moments[:n]]
        spread = [s or 1.0 for s in moments[n:]]
        rows = self._rows(lookup, known, centre, spread).filter(F.col("target").isNotNull()).withColumn("y", F.col("target").cast("double"))
        width = 1 + self.recurrence.units + (len(SITE_COLS) if self.concat_features else 0)
        gram, cross = normal_equations(rows, width)
        # The constant is free.
        ridge = np.diag([0.0] + [self.penalty] * (width - 1))
        return RecurrentModel(self, centre, spread, np.linalg.lstsq(gram + ridge, cross, rcond=None)[0].tolist())


@dataclass(frozen=True)
class RecurrentModel:
    regressor: RecurrentRegressor
    centre: list[float]
    spread: list[float]
    coefficients: list[float]

    def predict(self, lookup: DataFrame, steps: DataFrame, threshold: float = 0.7) -> DataFrame:
        """Record key, age, raw and thresholded truth and prediction (0..100) of the records with steps."""
        beta = F.array(*[F.lit(float(b)) for b in self.coefficients])
        known = steps.join(lookup.select(*RECORD_KEY), RECORD_KEY, "left_semi")
        rows = self.regressor._rows(lookup, known, self.centre, self.spread)
        raw = F.aggregate(F.zip_with("z", beta, lambda z, b: z * b), F.lit(0.0), lambda total, v: total + v)
        out = rows.select(*RECORD_KEY, "Age", F.col("target").alias("raw_y_true"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)).alias("raw_y_pred"))
        return out.withColumns({"y_true": below_threshold_label(F.col("raw_y_true"), threshold), "y_pred": below_threshold_label(F.col("raw_y_pred"), threshold)})
