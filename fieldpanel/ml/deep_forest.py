"""Random forests without a depth limit.

Nodes with many rows are split level by level, all trees of a batch at once: one job sums the class weights per (tree,
node, feature, bin) and picks every node's best split. A node with few enough rows (``local_rows``) is finished at once:
its rows meet in one group, and a task grows the whole subtree on their exact values, until leaves are pure. Groups of
all trees are spread over the tasks and none is above that bound, so depth costs neither jobs nor memory.

Bins are quantiles of the table; a large node whose rows all fall in one bin gets quantiles of its own rows instead.
The driver holds the splits of the large nodes, about two per ``local_rows`` rows and tree. A forest of more than
``DRIVER_NODES`` nodes stays in tables (:class:`StoredForest`); a smaller one is loaded as Spark's model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpanel.ml import stored_forest
from fieldpanel.ml.boosting import quantile_edges
from fieldpanel.ml.ensembles import NODE_SCHEMA, assemble, node
from fieldpanel.ml.kernels import Growth, draw, grow_local, impurity_of, matrix, value_place
from fieldpanel.ml.stored_forest import StoredForest
from fieldpanel.sources.io import materialise, ship

#: Rows of a node that one task finishes.
LOCAL_ROWS = 8192
#: Rows times trees of a batch; trees beyond it are grown in further batches.
BATCH_ROWS = 1 << 28


class _Upper:
    """Split nodes of the large part of a batch of trees. Nodes are (tree, number); 0 is the root."""

    def __init__(self, trees: Sequence[int]):
        self.trees = list(trees)
        self.split: list[dict[int, tuple[int, float, int, int]]] = [{} for _ in trees]  # node -> feature, threshold, left, right
        self.stats: list[dict[int, tuple[np.ndarray, np.ndarray, int]]] = [{} for _ in trees]  # class weights left and right, rows
        self.closed: list[list[int]] = [[] for _ in trees]  # large nodes that nothing splits
        self.count = [1] * len(trees)
        self.depth = 0

    def add(self, slot: int, at: int, feature: int, threshold: float) -> tuple[int, int]:
        left = self.count[slot]
        self.count[slot] += 2
        self.split[slot][at] = (feature, threshold, left, left + 1)
        return left, left + 1

    def arrays(self) -> list[tuple[np.ndarray, ...]]:
        out = []
        for slot in range(len(self.trees)):
            feature, threshold, left, right = np.full(self.count[slot], -1), np.zeros(self.count[slot]), np.zeros(self.count[slot], np.int64), np.zeros(self.count[slot], np.int64)
            for k, (j, cut, a, b) in self.split[slot].items():
                feature[k], threshold[k], left[k], right[k] = j, cut, a, b
            out.append((feature, threshold, left, right))
        return out


@dataclass
class _Grown:
    """Trees of a batch: nodes in Spark's format, nodes near the roots and subtrees (see :mod:`stored_forest`), and their number."""

    tables: tuple[DataFrame, DataFrame, DataFrame]
    nodes: int


def _votes(stats: Sequence[float]) -> tuple[float, float]:
    """Shares of the two classes, as Spark counts a leaf's votes."""
    total = stats[0] + stats[1]
    return (stats[0] / total, stats[1] / total) if total else (0.0, 0.0)


@dataclass
class DeepForest:
    """A random forest as an estimator of a frame with a feature vector, ``target`` (0 or 1) and ``weight``.

    ``max_features`` is "sqrt", "log2", a share, a number, or None for all. The result is Spark's forest model, or one
    that predicts the same from tables.
    """

    n_estimators: int = 100
    criterion: str = "gini"
    max_features: str | int | float | None = "sqrt"
    bootstrap: bool = True
    min_samples_leaf: int = 1
    max_bin: int = 64
    local_rows: int = LOCAL_ROWS
    seed: int = 591
    features: str = "features"

    def setFeaturesCol(self, name: str) -> DeepForest:  # noqa: N802  (as Spark's estimators)
        self.features = name
        return self

    def _tried(self, size: int) -> int:
        asked = self.max_features
        if asked is None:
            return size
        if asked == "sqrt":
            return max(1, int(size**0.5))
        if asked == "log2":
            return max(1, int(np.log2(size)))
        if isinstance(asked, float):
            return max(1, int(asked * size))
        if isinstance(asked, int) and asked > 0:
            return min(asked, size)
        raise ValueError(f"max_features must be sqrt, log2, a share, a number or None, got {asked!r}")

    def fit(self, prepared: DataFrame) -> RandomForestClassificationModel | StoredForest:
        ship(prepared.sparkSession)
        x = vector_to_array(F.col(self.features))
        rows = materialise(prepared.select(F.monotonically_increasing_id().alias("row"), F.col("target").cast("int").alias("y"), F.col("weight").cast("double").alias("w"), x.alias("x")))
        n, size = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no rows to fit")
        growth = Growth("gini" if self.criterion == "gini" else "entropy", self._tried(size), self.min_samples_leaf, self.seed)
        batch = int(max(1, min(self.n_estimators, BATCH_ROWS // n)))
        edges = quantile_edges(rows, F.col("x"), size, self.max_bin) if n > self.local_rows else None
        parts = []
        for first in range(0, self.n_estimators, batch):
            parts.append(self._trees(rows, range(first, min(first + batch, self.n_estimators)), size, n, growth, edges))
        nodes, above, below = (reduce(DataFrame.unionByName, tables) for tables in zip(*(p.tables for p in parts), strict=True))
        columns = {"featuresCol": self.features, "labelCol": "target", "weightCol": "weight"}
        if sum(p.nodes for p in parts) > stored_forest.DRIVER_NODES:
            return stored_forest.keep(nodes, above, below, self.n_estimators, size, columns, growth.criterion)
        return assemble(RandomForestClassificationModel, nodes, self.n_estimators, size, columns, growth.criterion)

    def _trees(self, rows: DataFrame, trees: Sequence[int], size: int, n: int, growth: Growth, edges: list[np.ndarray] | None) -> _Grown:
        upper = _Upper(trees)
        large = [(slot, 0) for slot in range(len(trees))] if n > self.local_rows else []
        while large:
            large = self._level(rows, upper, large, size, growth, edges)
        return self._finish(rows, upper, growth)

    # --- large nodes ---

    def _sampled(self, upper: _Upper, wanted: dict[int, list[int]] | None) -> Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """Per tree of the batch: (slot, row numbers, nodes, times drawn) of a block of rows, of the wanted nodes alone."""
        shapes, depth, trees, bootstrap, seed = upper.arrays(), upper.depth, upper.trees, self.bootstrap, self.seed

        def sampled(row: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            for slot, shape in enumerate(shapes):
                if wanted is not None and slot not in wanted:
                    continue
                times = draw(row, trees[slot], seed) if bootstrap else np.ones(len(row), np.int64)
                at = value_place(x, shape, depth)
                used = times > 0
                if wanted is not None:
                    used &= np.isin(at, wanted[slot])
                some = np.nonzero(used)[0]
                yield slot, some, at[some], times[some]

        return sampled

    def _level(self, rows: DataFrame, upper: _Upper, large: list[tuple[int, int]], size: int, growth: Growth, edges: list[np.ndarray]) -> list[tuple[int, int]]:
        """Split the large nodes; returns those of their children that are large too."""
        wanted: dict[int, list[int]] = {}
        for slot, at in large:
            wanted.setdefault(slot, []).append(at)
        found = self._best(self._table_sums(rows, upper, wanted, size, edges), growth, size)
        stuck = {s: [a for a in at if (s, a) not in found] for s, at in wanted.items()}
        stuck = {s: at for s, at in stuck.items() if at}
        cut = {(s, a): (j, float(edges[j][b])) for (s, a), (j, b, *_) in found.items()}
        if stuck:
            sums, own = self._own_sums(rows, upper, stuck, size)
            more = self._best(sums, growth, size)
            keys = {(s, a, j, b): v for s, a, j, b, v in own.select("slot", "at", "feature", "bin", "value").join(rows.sparkSession.createDataFrame([(s, a, j, b) for (s, a), (j, b, *_) in more.items()], "slot int, at long, feature int, bin int"), ["slot", "at", "feature", "bin"]).collect()} if more else {}
            cut |= {(s, a): (j, keys[s, a, j, b]) for (s, a), (j, b, *_) in more.items()}
            found |= more
        for slot, at in large:
            if (slot, at) not in cut:
                upper.closed[slot].append(at)
        again = []
        for (slot, at), (feature, threshold) in cut.items():
            _, _, left, right, n_left, n_right = found[slot, at]
            children = upper.add(slot, at, feature, threshold)
            upper.stats[slot][at] = (np.array(left), np.array(right), n_left + n_right)
            again += [(slot, child) for child, count in zip(children, (n_left, n_right), strict=True) if count > self.local_rows]
        upper.depth += 1
        return again

    def _table_sums(self, rows: DataFrame, upper: _Upper, wanted: dict[int, list[int]], size: int, edges: list[np.ndarray]) -> DataFrame:
        """``slot, at, feature, bin, w0, w1, n``, with the table's bins."""
        sampled, width = self._sampled(upper, wanted), max((len(e) for e in edges), default=0) + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y, w = matrix(batch.column("x"), size), batch.column("y").to_numpy(), batch.column("w").to_numpy()
                bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
                out = [[] for _ in range(7)]
                for slot, some, at, times in sampled(batch.column("row").to_numpy(), x):
                    nodes, local = np.unique(at, return_inverse=True)
                    cell = ((local[:, None] * size + np.arange(size)) * width + bins[some]).ravel()
                    cells = len(nodes) * size * width
                    kinds = [np.bincount(cell, np.repeat(v, size), cells) for v in (w[some] * times * (y[some] == 0), w[some] * times * (y[some] == 1), np.ones(len(some)))]
                    full = np.nonzero(kinds[2])[0]
                    for column, v in zip(out, (np.full(len(full), slot, np.int32), nodes[full // (size * width)], (full // width % size).astype(np.int32), (full % width).astype(np.int32), *(k[full] for k in kinds[:2]), kinds[2][full].astype(np.int64)), strict=True):
                        column.append(v)
                types = (np.int32, np.int64, np.int32, np.int32, np.float64, np.float64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, t)) for c, t in zip(out, types, strict=True)], names=["slot", "at", "feature", "bin", "w0", "w1", "n"])

        cells = rows.mapInArrow(run, "slot int, at long, feature int, bin int, w0 double, w1 double, n long")
        return cells.groupBy("slot", "at", "feature", "bin").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"), F.sum("n").alias("n"))

    def _own_sums(self, rows: DataFrame, upper: _Upper, wanted: dict[int, list[int]], size: int) -> tuple[DataFrame, DataFrame]:
        """The same for nodes whose rows the table's bins don't tell apart, by quantiles of each node's own rows."""
        sampled = self._sampled(upper, wanted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y, w = matrix(batch.column("x"), size), batch.column("y").to_numpy(), batch.column("w").to_numpy()
                for slot, some, at, times in sampled(batch.column("row").to_numpy(), x):
                    cols = [np.full(len(some) * size, slot, np.int32), np.repeat(at, size), np.tile(np.arange(size, dtype=np.int32), len(some)), x[some].ravel(), *(np.repeat(w[some] * times * (y[some] == k), size) for k in (0, 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["slot", "at", "feature", "value", "w0", "w1"])

        values = materialise(rows.mapInArrow(run, "slot int, at long, feature int, value double, w0 double, w1 double"))
        key = ["slot", "at", "feature"]
        shares = [k / self.max_bin for k in range(self.max_bin)]
        edges = values.groupBy(*key).agg(F.array_distinct(F.percentile_approx("value", shares, 100_000)).alias("edges"), F.max("value").alias("most"))
        edges = edges.select(*key, F.filter("edges", lambda e: e < F.col("most")).alias("edges")).filter(F.size("edges") > 0)
        edges = materialise(edges)
        placed = values.join(edges, key).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("value"))))
        sums = placed.groupBy(*key, "bin").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"), F.count(F.lit(1)).alias("n"))
        return sums, edges.select(*key, F.posexplode("edges").alias("bin", "value"))

    def _best(self, sums: DataFrame, growth: Growth, size: int) -> dict[tuple[int, int], tuple]:
        """(slot, node) -> feature, bin, left and right class weights, left and right rows of the best allowed split."""
        part = Window.partitionBy("slot", "at", "feature")
        upto = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cols = {f"l{c}": F.sum(c).over(upto) for c in ("w0", "w1", "n")} | {f"t{c}": F.sum(c).over(part) for c in ("w0", "w1", "n")}
        split = sums.select("slot", "at", "feature", "bin", *[v.alias(k) for k, v in cols.items()])
        split = split.withColumns({f"r{c}": F.col(f"t{c}") - F.col(f"l{c}") for c in ("w0", "w1", "n")})
        split = split.filter((F.col("ln") >= growth.least) & (F.col("rn") >= growth.least) & (F.col("tw0") > 0) & (F.col("tw1") > 0))

        def weighed(side: str):
            a, b = F.greatest(F.col(f"{side}w0"), F.lit(0.0)), F.greatest(F.col(f"{side}w1"), F.lit(0.0))
            total = a + b
            if growth.criterion == "gini":
                return F.coalesce(total - F.try_divide(a * a + b * b, total), F.lit(0.0))
            part_of = lambda v: F.coalesce(v * F.log2(F.try_divide(v, total)), F.lit(0.0))
            return -F.when(a > 0, part_of(a)).otherwise(0.0) - F.when(b > 0, part_of(b)).otherwise(0.0)

        # The features of a node in a seeded order, of which the first few that can split it count.
        order = F.xxhash64(F.lit(growth.seed), "slot", F.lit(0), "at", "feature")
        ranked = split.withColumn("turn", F.dense_rank().over(Window.partitionBy("slot", "at").orderBy(order, "feature")))
        allowed = ranked.filter(F.col("turn") <= growth.tried)
        best = F.min(F.struct((weighed("l") + weighed("r")).alias("below"), "feature", "bin", "lw0", "lw1", "rw0", "rw1", "ln", "rn")).alias("b")
        found = allowed.groupBy("slot", "at").agg(best).collect()  # one row per large node
        return {(r["slot"], r["at"]): (r["b"]["feature"], r["b"]["bin"], [r["b"]["lw0"], r["b"]["lw1"]], [r["b"]["rw0"], r["b"]["rw1"]], r["b"]["ln"], r["b"]["rn"]) for r in found}

    # --- small nodes ---

    def _finish(self, rows: DataFrame, upper: _Upper, growth: Growth) -> _Grown:
        """Subtrees of all frontier nodes, and the nodes above them."""
        spark = rows.sparkSession
        sampled = self._sampled(upper, None)
        size = rows.select(F.size("x")).first()[0]
        closed = [np.array(c, np.int64) for c in upper.closed]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("x"), size)
                for slot, some, at, times in sampled(batch.column("row").to_numpy(), x):
                    taken = pa.array(some)
                    cols = [pa.array(np.full(len(some), slot, np.int32)), pa.array(at), pa.array(np.isin(at, closed[slot])), pa.array(times), *(batch.column(c).take(taken) for c in ("row", "y", "w", "x"))]
                    yield pa.RecordBatch.from_arrays(cols, names=["slot", "at", "closed", "times", "row", "y", "w", "x"])

        def subtree(table: pa.Table) -> pa.Table:
            table = table.sort_by("row")
            slot, at = table["slot"][0].as_py(), table["at"][0].as_py()
            x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
            times = table["times"].to_numpy()
            grown = grow_local(x, table["y"].to_numpy(), table["w"].to_numpy() * times, np.ones(len(times), np.int64), growth, upper_trees[slot], at)
            out = []
            for k, (j, threshold, left, right, stats, n) in enumerate(grown):
                impurity = float(impurity_of(stats, growth.criterion))
                gain = -1.0
                if j >= 0:
                    sides = [grown[c][4] for c in (left, right)]
                    gain = impurity - float(sum(s.sum() * impurity_of(s, growth.criterion) for s in sides) / stats.sum())
                out.append((k, float(stats.argmax()), impurity, stats.tolist(), n, gain, left, right, j, threshold))
            names = ["k", "prediction", "impurity", "stats", "n", "gain", "left", "right", "feature", "threshold"]
            nodes = pa.array([[dict(zip(names, row, strict=True)) for row in out]], pa.list_(local_type))
            return pa.Table.from_arrays([pa.array([slot], pa.int32()), pa.array([at], pa.int64()), pa.array([len(out)], pa.int64()), nodes], names=["slot", "at", "size", "nodes"])

        upper_trees = upper.trees
        local_type = pa.struct([("k", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("stats", pa.list_(pa.float64())), ("n", pa.int64()), ("gain", pa.float64()), ("left", pa.int32()), ("right", pa.int32()), ("feature", pa.int32()), ("threshold", pa.float64())])
        of_node = "struct<k: int, prediction: double, impurity: double, stats: array<double>, n: bigint, gain: double, left: int, right: int, feature: int, threshold: double>"
        dealt = rows.mapInArrow(deal, "slot int, at long, closed boolean, times long, row long, y int, w double, x array<double>")
        grown = dealt.filter(~F.col("closed")).drop("closed").groupBy("slot", "at").applyInArrow(subtree, f"slot int, at long, size long, nodes array<{of_node}>")
        if any(upper.closed):
            # Large leaves are summed up, never brought together.
            of = lambda k: F.sum(F.when(F.col("y") == k, F.col("w") * F.col("times")).otherwise(0.0))
            sums = dealt.filter("closed").groupBy("slot", "at").agg(of(0).alias("a"), of(1).alias("b"), F.count(F.lit(1)).alias("n"))
            share = lambda c: F.col(c) / (F.col("a") + F.col("b"))
            bits = lambda c: F.when(F.col(c) > 0, -share(c) * F.log2(share(c))).otherwise(0.0)
            impurity = 1 - share("a") * share("a") - share("b") * share("b") if growth.criterion == "gini" else bits("a") + bits("b")
            whole = F.struct(F.lit(0).alias("k"), F.when(F.col("b") > F.col("a"), 1.0).otherwise(0.0).alias("prediction"), impurity.alias("impurity"), F.array("a", "b").alias("stats"), F.col("n").alias("n"), F.lit(-1.0).alias("gain"), F.lit(-1).alias("left"), F.lit(-1).alias("right"), F.lit(-1).alias("feature"), F.lit(0.0).alias("threshold"))
            grown = grown.unionByName(sums.select("slot", "at", F.lit(1).cast("long").alias("size"), F.array(whole).alias("nodes")))
        grown = materialise(grown)
        # Sizes and leaves of the frontier, about two per ``local_rows`` rows and tree; the subtrees themselves stay where they are.
        lone = F.when(F.col("size") == 1, F.col("nodes")[0]["stats"])
        frontier = sorted(grown.select("slot", "at", "size", lone).collect())
        bases, leaves, total = [], {}, list(upper.count)
        for slot, at, below_at, stats in frontier:
            bases.append((slot, upper.trees[slot], at, total[slot] - 1))
            total[slot] += below_at - 1
            if stats is not None:
                leaves[slot, at] = _votes(stats)
        shape = spark.createDataFrame(bases, "slot int, tree int, at long, base int")
        based = grown.join(F.broadcast(shape), ["slot", "at"])
        number = lambda k: F.when(k == 0, F.col("at").cast("int")).when(k > 0, F.col("base") + k).otherwise(F.lit(-1))
        d = F.col("d")
        split = F.struct(d["feature"].alias("featureIndex"), F.when(d["feature"] < 0, F.array().cast("array<double>")).otherwise(F.array(d["threshold"])).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
        data = F.struct(number(d["k"]).alias("id"), d["prediction"].alias("prediction"), d["impurity"].alias("impurity"), d["stats"].alias("impurityStats"), d["n"].alias("rawCount"), d["gain"].alias("gain"), number(d["left"]).alias("leftChild"), number(d["right"]).alias("rightChild"), split.alias("split"))
        below = based.select("tree", "at", "base", F.explode("nodes").alias("d")).select(F.col("tree").alias("treeID"), data.alias("nodeData"))
        above = []
        for slot, tree in enumerate(upper.trees):
            for at, (j, threshold, left, right) in upper.split[slot].items():
                *sides, count = upper.stats[slot][at]
                weights = sides[0] + sides[1]
                impurity = float(impurity_of(weights, growth.criterion))
                gain = impurity - float(sum(s.sum() * impurity_of(s, growth.criterion) for s in sides) / weights.sum())
                above.append((tree, node(at, float(weights.argmax()), impurity, weights.tolist(), count, gain, (left, right), (j, threshold))))
        nodes = below.unionByName(spark.createDataFrame(above, NODE_SCHEMA)) if above else below
        places = []
        for slot, (tree, shape_of) in enumerate(zip(upper.trees, upper.arrays(), strict=True)):
            for at, (j, threshold, left, right) in enumerate(zip(*(v.tolist() for v in shape_of), strict=True)):
                places.append((tree, at, int(j), threshold, left, right, *leaves.get((slot, at), (float("nan"),) * 2)))
        weight = F.aggregate(d["stats"], F.lit(0.0), lambda a, v: a + v)
        votes = [F.when(weight != 0, d["stats"][c] / weight).otherwise(0.0).alias(name) for c, name in enumerate(("low", "high"))]
        subtrees = based.filter("size > 1").select("tree", "at", F.explode("nodes").alias("d"))
        subtrees = subtrees.select("tree", "at", *[d[c].alias(c) for c in ("k", "feature", "threshold", "left", "right")], *votes)
        return _Grown((nodes, spark.createDataFrame(places, stored_forest.ABOVE_SCHEMA), subtrees), sum(total))
