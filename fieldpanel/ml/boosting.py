"""Second-order boosting of trees over quantile bins, with L1 and L2 penalties on the leaves.

A round fits a tree to the gradients g and hessians h of the log loss at the current margins. A level of the tree is one
job: every task sums g and h per (node, feature, bin) over its rows, and the sums of the tasks are added up. A split's
loss change is T(GL)^2 / (HL + lambda) + T(GR)^2 / (HR + lambda) - T(G)^2 / (H + lambda), where T draws a sum towards
zero by alpha; a leaf's value is -T(G) / (H + lambda), times the learning rate.

Rows are stored with the numbers of their bins; without subsampling, rows with the same bins, target and side have the
same margin and are stored as one, with their number and the sum of their weights. Margins are stored every few rounds; in between they are what the latest
trees add, so no plan grows with the rounds and a lost executor costs a re-read. What reaches the driver is one sum per
node, feature and bin, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpanel.ml.ensembles import NODE_SCHEMA, assemble, node
from fieldpanel.ml.kernels import bin_place, chance, matrix
from fieldpanel.operators.importance import early_stop
from fieldpanel.operators.ordering import hash_cutoffs, hash_order, with_cutoffs
from fieldpanel.sources.io import materialise, ship

#: Rounds after which margins are stored.
STORED_EVERY = 8
#: Deepest tree, which bounds the sums that reach the driver.
DEEPEST = 12
#: A split must change the loss by more than rounding does.
LEAST_CHANGE = 1e-10


@dataclass(frozen=True)
class Penalties:
    alpha: float = 0.0
    lam: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0

    def drawn(self, g: np.ndarray) -> np.ndarray:
        return np.sign(g) * np.maximum(np.abs(g) - self.alpha, 0.0)

    def score(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.divide(self.drawn(g) ** 2, h + self.lam, out=np.zeros_like(g), where=h + self.lam > 0)

    def value(self, g: float, h: float) -> float:
        return float(-self.drawn(np.float64(g)) / (h + self.lam)) if h + self.lam > 0 else 0.0


@dataclass
class Tree:
    """Nodes in the order of their making, so children come after their parent. ``bin`` b sends bins up to b to the left."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    sums: list[tuple[float, float, int]] = field(default_factory=list)  # g, h, rows
    change: list[float] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    depth: int = 0

    def add(self) -> int:
        for column, blank in ((self.feature, -1), (self.bin, -1), (self.left, -1), (self.right, -1), (self.sums, (0.0, 0.0, 0)), (self.change, 0.0), (self.value, 0.0)):
            column.append(blank)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c) for c in (self.feature, self.bin, self.left, self.right, self.value)) + (self.depth,)

    def prune(self, gamma: float) -> None:
        """Take back splits of two leaves that change the loss by less than ``gamma``, from below."""
        for k in range(len(self.feature) - 1, -1, -1):
            if self.feature[k] >= 0 and self.feature[self.left[k]] < 0 and self.feature[self.right[k]] < 0 and self.change[k] < gamma:
                self.feature[k] = self.left[k] = self.right[k] = -1

    def rows(self, tree: int, edges: Sequence[np.ndarray]) -> list[tuple]:
        """Nodes in Spark's form; its margin is twice the sum of the values, so values are halved."""
        order, number = [0], {0: 0}
        for k in order:
            if self.feature[k] >= 0:
                for child in (self.left[k], self.right[k]):
                    number[child] = len(order)
                    order.append(child)
        out = []
        for k in order:
            _, _, n = self.sums[k]
            stats = [float(n), 0.0, 0.0]
            if self.feature[k] < 0:
                out.append((tree, node(number[k], self.value[k] / 2, 0.0, stats, n)))
            else:
                split = self.feature[k], float(edges[self.feature[k]][self.bin[k]])
                out.append((tree, node(number[k], self.value[k] / 2, 0.0, stats, n, self.change[k] / max(n, 1), (number[self.left[k]], number[self.right[k]]), split)))
        return out


def quantile_edges(rows: DataFrame, x: Column, size: int, bins: int, accuracy: int = 100_000) -> list[np.ndarray]:
    """Distinct values at the quantiles k / bins of every feature, without the largest; one aggregation for all."""
    shares = [k / bins for k in range(1, bins)]
    parts = rows.select(x.alias("x")).agg(*[F.percentile_approx(F.col("x")[j], shares, accuracy).alias(f"q{j}") for j in range(size)], *[F.max(F.col("x")[j]).alias(f"m{j}") for j in range(size)])
    row = parts.first()
    return [np.array(sorted({v for v in row[f"q{j}"] or [] if v < row[f"m{j}"]}), np.float64) for j in range(size)]


def binned(prepared: DataFrame, features: str, edges: Sequence[np.ndarray], held: str | None, together: bool = False) -> DataFrame:
    """Stored ``row, y, w, n, held, bins, margin``: the bin of a value is the number of edges below it.

    ``together`` stores rows with the same ``y, held, bins`` as one: ``n`` is their number and ``w`` their weight. How many
    there are at most depends on the bins, not on the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), len(edges))
            found = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.int32) if edges else np.zeros((len(x), 0), np.int32)
            offsets = pa.array(np.arange(0, found.size + 1, max(len(edges), 1), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "y", "w", "n", "held")), pa.ListArray.from_arrays(offsets, pa.array(found.ravel())), pa.array(np.zeros(len(x)))], names=["row", "y", "w", "n", "held", "bins", "margin"])

    held_out = F.col(held).cast("boolean") if held else F.lit(False)
    x = prepared.select(F.monotonically_increasing_id().alias("row"), F.col("target").cast("double").alias("y"), F.col("weight").cast("double").alias("w"), F.lit(1.0).alias("n"), F.coalesce(held_out, F.lit(False)).alias("held"), vector_to_array(F.col(features)).alias("x"))
    rows = x.mapInArrow(run, "row long, y double, w double, n double, held boolean, bins array<int>, margin double")
    if together:
        rows = rows.groupBy("y", "held", "bins").agg(F.min("row").alias("row"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.min("margin").alias("margin")).select(*rows.columns)
    return materialise(rows)


class _Rounds:
    """The stored rows, and the trees since they were stored."""

    def __init__(self, state: DataFrame, size: int):
        self.state, self.size, self.latest = state, size, []

    def _margin(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        trees = [t.arrays() for t in self.latest]

        def margin(bins: np.ndarray, stored: np.ndarray) -> np.ndarray:
            out = stored.copy()
            for tree in trees:
                out += tree[4][bin_place(bins, tree)]
            return out

        return margin

    def store(self) -> None:
        margin, size = self._margin(), self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = margin(matrix(batch.column("bins"), size), batch.column("margin").to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "y", "w", "n", "held", "bins")), pa.array(new)], names=batch.schema.names)

        self.state, self.latest = materialise(self.state.mapInArrow(run, self.state.schema)), []

    def sums(self, tree: Tree, nodes: list[int], width: int, share: float, salt: int) -> tuple[np.ndarray, float | None]:
        """g, h and rows per (node, feature, bin), and the mean loss of the held-out rows."""
        margin, size, shape, drawn = self._margin(), self.size, tree.arrays(), share < 1.0
        slot = np.full(len(tree.feature), -1)
        slot[nodes] = np.arange(len(nodes))
        cells = len(nodes) * size * width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss, weight = np.zeros((3, cells)), 0.0, 0.0
            for batch in batches:
                bins, (y, w, n) = matrix(batch.column("bins"), size), (batch.column(c).to_numpy() for c in ("y", "w", "n"))
                held = batch.column("held").to_numpy(zero_copy_only=False)
                m = margin(bins, batch.column("margin").to_numpy())
                p = 1 / (1 + np.exp(-m))
                loss += float((w * np.where(y > 0, np.logaddexp(0, -m), np.logaddexp(0, m)))[held].sum())
                weight += float(w[held].sum())
                at = slot[bin_place(bins, shape)]
                used = ~held & (at >= 0)
                if drawn:
                    used &= chance(batch.column("row").to_numpy(), salt) < share
                cell = ((at[used, None] * size + np.arange(size)) * width + bins[used]).ravel()
                for k, v in enumerate((w * (p - y), w * p * (1 - p), n)):
                    total[k] += np.bincount(cell, np.repeat(v[used], size), cells)
            some = np.nonzero(total[2])[0]
            cols = [np.append(some, -1), *(np.append(total[k, some], v) for k, v in enumerate((loss, weight, 0.0)))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["cell", "g", "h", "n"])

        parts = self.state.mapInArrow(run, "cell long, g double, h double, n double").groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("n"))
        out, loss = np.zeros((3, cells)), None
        for cell, *values in parts.collect():  # nodes x features x bins
            if cell < 0:
                loss = values[0] / values[1] if values[1] > 0 else None
            else:
                out[:, cell] = values
        return out.reshape(3, len(nodes), size, width), loss


def best_split(sums: np.ndarray, penalties: Penalties) -> tuple[float, int, int] | None:
    """Loss change, feature and bin of the best split of a node from its sums (3, features, bins); the first of equals."""
    total = sums.sum(2, keepdims=True)
    left = sums.cumsum(2)
    right = total - left
    change = penalties.score(left[0], left[1]) + penalties.score(right[0], right[1]) - penalties.score(total[0], total[1])
    allowed = (left[2] > 0.5) & (right[2] > 0.5) & (left[1] >= penalties.min_child_weight) & (right[1] >= penalties.min_child_weight)
    change = np.where(allowed, change, -np.inf)
    if change.size == 0 or change.max() <= LEAST_CHANGE:
        return None
    feature, cut = np.unravel_index(int(change.argmax()), change.shape)
    return float(change[feature, cut]), int(feature), int(cut)


def grow(rounds: _Rounds, width: int, max_depth: int, penalties: Penalties, rate: float, share: float, salt: int) -> tuple[Tree, float | None]:
    """One tree, level by level, and the held-out loss before it."""
    tree, loss = Tree(), None
    open_nodes = [tree.add()]
    for level in range(max_depth):
        sums, seen = rounds.sums(tree, open_nodes, width, share, salt)
        loss = seen if level == 0 else loss
        next_nodes = []
        for k, at in enumerate(open_nodes):
            g, h, n = sums[:, k, 0].sum(1) if sums.shape[2] else np.zeros(3)
            tree.sums[at] = float(g), float(h), int(round(n))
            tree.value[at] = rate * penalties.value(g, h)
            found = best_split(sums[:, k], penalties)
            if found:
                tree.change[at], feature, cut = found
                tree.feature[at], tree.bin[at] = feature, cut
                tree.left[at], tree.right[at] = tree.add(), tree.add()
                next_nodes += [tree.left[at], tree.right[at]]
                # The children's sums are those of the split, so the last level needs no job of its own.
                for child, part in ((tree.left[at], sums[:, k, feature, : cut + 1]), (tree.right[at], sums[:, k, feature, cut + 1 :])):
                    g, h, n = part.sum(1)
                    tree.sums[child] = float(g), float(h), int(round(n))
                    tree.value[child] = rate * penalties.value(g, h)
        open_nodes, tree.depth = next_nodes, level + 1
        if not open_nodes:
            break
    tree.prune(penalties.gamma)
    return tree, loss


@dataclass
class BoostedTrees:
    """Boosting as an estimator of a frame with a feature vector, ``target`` (0 or 1) and ``weight``.

    With ``early_stopping_rounds``, a share of the sites (``validation_share``, by the order of their seeded hash) is kept out
    of the fit. Their loss after every round is ``losses``; boosting ends after so many rounds in a row that are each worse
    than the one before, and the model is cut after the round with the least loss, by the same rule as :func:`early_stop`.
    """

    n_estimators: int = 100
    learning_rate: float = 0.3
    max_depth: int = 6
    subsample: float = 1.0
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    max_bin: int = 64
    early_stopping_rounds: int | None = None
    validation_share: float = 0.2
    tolerance: float = 1e-5
    key: str = "ID"
    seed: int = 591
    features: str = "features"
    losses: DataFrame | None = None
    best_round: int | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.max_depth <= DEEPEST:
            raise ValueError(f"max_depth must be from 1 to {DEEPEST}, got {self.max_depth}")
        if min(self.reg_alpha, self.reg_lambda, self.gamma, self.min_child_weight) < 0:
            raise ValueError("penalties must not be negative")
        if self.n_estimators < 1 or not 0 < self.subsample <= 1 or self.max_bin < 2:
            raise ValueError("n_estimators must be 1 or more, subsample above 0 and up to 1, max_bin 2 or more")

    def setFeaturesCol(self, name: str) -> BoostedTrees:  # noqa: N802  (as Spark's estimators)
        self.features = name
        return self

    def _marked(self, prepared: DataFrame) -> tuple[DataFrame, str | None]:
        if not self.early_stopping_rounds:
            return prepared, None
        if self.key not in prepared.columns:
            raise ValueError(f"early stopping holds out groups of {self.key!r}, which the rows lack")
        salt, share = f"{self.seed}:valid", self.validation_share
        cut = hash_cutoffs(prepared, self.key, salt, lambda n: F.array(F.floor(F.lit(share) * n)))
        held = F.coalesce(hash_order([self.key], salt) <= F.try_element_at("_cutoffs", F.lit(1)), F.lit(False))
        return with_cutoffs(prepared, cut).withColumn("_held", held), "_held"

    def fit(self, prepared: DataFrame) -> GBTClassificationModel:
        ship(prepared.sparkSession)
        size = prepared.select(F.size(vector_to_array(F.col(self.features)))).first()
        if size is None:
            raise ValueError("no rows to fit")
        marked, held = self._marked(prepared)
        seen = marked.filter(~F.col(held)) if held else marked
        edges = quantile_edges(seen, vector_to_array(F.col(self.features)), size[0], self.max_bin)
        rounds = _Rounds(binned(marked, self.features, edges, held, together=self.subsample == 1), size[0])
        penalties = Penalties(self.reg_alpha, self.reg_lambda, self.gamma, self.min_child_weight)
        width = max((len(e) for e in edges), default=0) + 1
        trees: list[Tree] = []
        losses: list[float] = []  # after each round
        worse = 0
        while len(trees) < self.n_estimators:
            salt = (self.seed << 20) + len(trees)
            tree, before = grow(rounds, width, self.max_depth, penalties, self.learning_rate, self.subsample, salt)
            if trees and held:
                losses.append(before)
                worse = worse + 1 if len(losses) > 1 and losses[-1] > losses[-2] * (1 + self.tolerance) else 0
                if worse >= self.early_stopping_rounds:
                    break
            trees.append(tree)
            rounds.latest.append(tree)
            if len(rounds.latest) >= STORED_EVERY:
                rounds.store()
        spark = prepared.sparkSession
        if held:
            if len(losses) < len(trees):
                root = Tree()
                root.add()
                losses.append(rounds.sums(root, [], width, 1.0, 0)[1])
            if losses[0] is None:
                raise ValueError("early stopping needs sites to hold out")
            self.losses = spark.createDataFrame(list(enumerate(losses, 1)), "epoch int, loss double")
            self.best_round = early_stop(self.losses, self.early_stopping_rounds, tol=self.tolerance).first()["best_step"]
            trees = trees[: self.best_round]
        nodes = spark.createDataFrame([row for t, tree in enumerate(trees) for row in tree.rows(t, edges)], NODE_SCHEMA)
        return assemble(GBTClassificationModel, nodes, len(trees), size[0], {"featuresCol": self.features, "labelCol": "target", "weightCol": "weight"})
