"""Forests that are too large for the driver: kept as tables, read by tasks.

A forest that is grown until its leaves are pure has about as many nodes as rows and trees together. Such a forest stays
where it was written, in Spark's own format, and no process holds it whole. For a prediction the nodes near the roots,
which are few, go to every task; they lead a row to a subtree of each tree. Rows and subtrees then meet in one partition,
a subtree's nodes first, and a task holds one subtree at a time. Votes are added tree by tree, as Spark does.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpanel.ml.ensembles import NODE_SCHEMA, assemble, node, write_ensemble
from fieldpanel.ml.kernels import matrix, value_place
from fieldpanel.sources.io import materialise, scan, scratch_dir, ship

#: Nodes of a forest that the driver and every task can hold as Spark's own model.
DRIVER_NODES = 1 << 20
#: Nodes near the roots. ``low`` and ``high`` are the votes of a leaf, NaN where a subtree or a split follows.
ABOVE_SCHEMA = "tree int, at long, feature int, threshold double, left long, right long, low double, high double"
#: Nodes of the subtrees at ``at``; ``k`` is the place in the subtree.
BELOW_SCHEMA = "tree int, at long, k int, feature int, threshold double, left int, right int, low double, high double"
_ROW = (1 << 31) - 1  # in place of ``k``: rows come after all nodes of their subtree
_SPREAD = 1024  # parts that rows without a subtree are dealt to


class StoredForest(Model, MLWritable, MLReadable):
    """A random forest in the folder ``path``; it predicts as Spark's model of the same nodes does.

    What asks for parameters is answered by a Spark model without nodes. What asks for the trees themselves (``trees``,
    ``toDebugString``) loads them into the driver.
    """

    def __init__(self, path: str):
        super().__init__()
        self.path = path
        self._spark = SparkSession.active()
        self._about = json.loads(self._spark.read.text(f"{path}/metadata").first()[0])
        self._models: dict[str, RandomForestClassificationModel] = {}
        self._resetUid(self._about["uid"])

    @property
    def getNumTrees(self) -> int:  # noqa: N802  (as Spark's model)
        return self._about["numTrees"]

    @property
    def numFeatures(self) -> int:  # noqa: N802
        return self._about["numFeatures"]

    @property
    def totalNumNodes(self) -> int:  # noqa: N802
        return self._nodes().count()

    @property
    def featureImportances(self) -> Any:  # noqa: N802
        """Gain times weight by feature, each tree and the whole made to sum up to 1, as Spark defines it."""
        gained = self._nodes().filter("leftChild >= 0").groupBy("treeID", F.col("split.featureIndex").alias("feature")).agg(
            F.sum(F.col("gain") * F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)).alias("g"))
        found = np.zeros((self.getNumTrees, self.numFeatures))
        for tree, feature, g in gained.collect():
            found[tree, feature] = g
        whole = found.sum(1, keepdims=True)
        total = np.divide(found, whole, out=np.zeros_like(found), where=whole != 0).sum(0)
        total = total / total.sum() if total.sum() else total
        return Vectors.sparse(len(total), [(int(j), float(total[j])) for j in np.flatnonzero(total)])

    def extractParamMap(self, extra: Any = None) -> Any:  # noqa: N802
        return self._shell.extractParamMap(extra)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_") or "_about" not in self.__dict__:
            raise AttributeError(name)
        return getattr(self._shell if name in ("numClasses", "treeWeights", "isDefined") else self._whole, name)

    def _nodes(self) -> DataFrame:
        return scan(self._spark, f"{self.path}/data").select("treeID", "nodeData.*")

    @property
    def _shell(self) -> RandomForestClassificationModel:
        leaves = [(t, node(0, 0.0, 0.0, [1.0, 0.0], 1)) for t in range(self.getNumTrees)]
        return self._made("shell", lambda: self._spark.createDataFrame(leaves, NODE_SCHEMA))

    @property
    def _whole(self) -> RandomForestClassificationModel:
        return self._made("whole", lambda: scan(self._spark, f"{self.path}/data"))

    def _made(self, name: str, nodes: Callable[[], DataFrame]) -> RandomForestClassificationModel:
        if name in self._models:
            return self._models[name]
        params = dict(self._about["paramMap"])
        impurity = params.pop("impurity", None)
        params.pop("numTrees", None)
        self._models[name] = assemble(RandomForestClassificationModel, nodes(), self.getNumTrees, self.numFeatures, params, impurity)
        return self._models[name]

    # --- prediction ---

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark = dataset.sparkSession
        ship(spark)
        features = self._about["paramMap"]["featuresCol"]
        stored = materialise(dataset.withColumn("_row", F.monotonically_increasing_id()))
        rows = stored.select(F.col("_row").alias("row"), vector_to_array(features).alias("x"))
        nothing = {"row": F.lit(-1).cast("long"), "x": F.array().cast("array<double>")}
        nodes = scan(spark, f"{self.path}/below").withColumns(nothing)
        dealt = rows.mapInArrow(self._deal(), "tree int, at long, k int, feature int, threshold double, left int, right int, low double, high double, row long, x array<double>")
        met = nodes.unionByName(dealt).repartition("tree", "at").sortWithinPartitions("tree", "at", "k")
        votes = met.mapInArrow(_walk(self.numFeatures), "row long, tree int, low double, high double").groupBy(F.col("row").alias("_row")).agg(
            F.array_sort(F.collect_list(F.struct("tree", "low", "high"))).alias("_votes"))
        low, high = (F.aggregate(F.col("_votes")[c], F.lit(0.0), lambda a, v: a + v) for c in ("low", "high"))
        voted = stored.join(votes, "_row").select(*[F.col(f"`{c}`") for c in dataset.columns], low.alias("_low"), high.alias("_high"))
        total = F.col("_low") + F.col("_high")
        shares = [F.when(total != 0, F.col(c) / total).otherwise(0.0) for c in ("_low", "_high")]
        return voted.select(
            *[F.col(f"`{c}`") for c in dataset.columns],
            array_to_vector(F.array("_low", "_high")).alias("rawPrediction"),
            array_to_vector(F.array(*shares)).alias("probability"),
            F.when(F.col("_high") > F.col("_low"), 1.0).otherwise(0.0).alias("prediction"),
        )

    def _deal(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Rows once for every tree, with the subtree they go on in, or with the votes of the leaf they have reached."""
        size, trees = self.numFeatures, self.getNumTrees
        above = scan(self._spark, f"{self.path}/above").orderBy("tree", "at").toArrow()
        tree = above["tree"].to_numpy()
        shapes = []
        for t in range(trees):
            mine = above.filter(pa.array(tree == t))
            shapes.append([mine[c].to_numpy() for c in ("feature", "threshold", "left", "right", "low", "high")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, row = matrix(batch.column("x"), size), batch.column("row").to_numpy()
                n = len(row)
                for t, (*shape, low, high) in enumerate(shapes):
                    at = value_place(x, shape, len(low))
                    known = ~np.isnan(low[at])
                    starts = np.concatenate([[0], np.cumsum(np.where(known, 0, size))]).astype(np.int32)
                    left = pa.ListArray.from_arrays(pa.array(starts), pa.array(x[~known].ravel()))
                    plain = [np.full(n, t, np.int32), np.where(known, -1 - row % _SPREAD, at), np.full(n, _ROW, np.int32), np.full(n, -1, np.int32), np.zeros(n), np.full(n, -1, np.int32), np.full(n, -1, np.int32), low[at], high[at], row]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, plain), left], names=["tree", "at", "k", "feature", "threshold", "left", "right", "low", "high", "row", "x"])

        return run

    # --- storage ---

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, forest: StoredForest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:  # noqa: N802
        spark, source = self.forest._spark, self.forest.path
        spark.read.text(f"{source}/metadata").coalesce(1).write.text(f"{path}/metadata")
        for part in ("treesMetadata", "data", "above", "below"):
            spark.read.parquet(f"{source}/{part}").write.parquet(f"{path}/{part}")


class _Reader(MLReader):
    def load(self, path: str) -> StoredForest:
        return StoredForest(path)


def _walk(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Votes of rows that come after the nodes of their subtree."""
    names = ["feature", "threshold", "left", "right", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, shape = None, [], None
        for batch in batches:
            tree, at, k, row, *plain = (batch.column(c).to_numpy() for c in ("tree", "at", "k", "row", *names))
            if not len(tree):
                continue
            edges = (np.flatnonzero((tree[1:] != tree[:-1]) | (at[1:] != at[:-1])) + 1).tolist()
            low, high = plain[4].copy(), plain[5].copy()
            for a, b in zip([0, *edges], [*edges, len(tree)], strict=True):
                if at[a] < 0:
                    continue
                if (tree[a], at[a]) != key:
                    key, pieces, shape = (tree[a], at[a]), [], None
                cut = a + int(np.searchsorted(k[a:b], _ROW))
                if cut > a:
                    pieces.append([c[a:cut].copy() for c in plain])
                if cut < b:
                    if shape is None:
                        shape = [np.concatenate(c) for c in zip(*pieces, strict=True)]
                    leaf = value_place(matrix(batch.column("x").slice(cut, b - cut), size), shape[:4], len(shape[0]))
                    low[cut:b], high[cut:b] = shape[4][leaf], shape[5][leaf]
            rows = k == _ROW
            yield pa.RecordBatch.from_arrays([pa.array(c[rows]) for c in (row, tree, low, high)], names=["row", "tree", "low", "high"])

    return run


def keep(nodes: DataFrame, above: DataFrame, below: DataFrame, trees: int, features: int, columns: dict[str, str], impurity: str) -> StoredForest:
    """Write a forest: its nodes in Spark's format, and the same nodes as a prediction reads them."""
    path = scratch_dir(nodes.sparkSession)
    named = f"{StoredForest.__module__}.{StoredForest.__qualname__}"
    write_ensemble(path, RandomForestClassificationModel, nodes, trees, features, columns, impurity, {"class": named})
    above.write.parquet(f"{path}/above")
    below.write.parquet(f"{path}/below")
    return StoredForest(path)
