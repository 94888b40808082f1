"""Tree ensembles that are grown here, as Spark ML models.

Trees come as rows of Spark's own storage format for ensembles, which names the node, its children, its split and its
statistics. Written beside the metadata of a model of that class, they load as a Spark model: prediction, leaves,
importances and storage are Spark's. Depth has no limit in that format.
"""

from __future__ import annotations

import json
from functools import cache
from typing import Any

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession

from fieldpanel.sources.io import freed_shuffles, scratch_dir

#: Rows of a tree: children have larger ids than their parent, ids of a tree have no gaps, a leaf has children -1.
NODE_SCHEMA = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
    "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)
NO_SPLIT = (-1, [], -1)
_CLASSES = {GBTClassificationModel: GBTClassifier, RandomForestClassificationModel: RandomForestClassifier}


def node(number: int, prediction: float, impurity: float, stats: list[float], rows: int, gain: float = -1.0, children: tuple[int, int] = (-1, -1), split: tuple[int, float] | None = None) -> tuple:
    """One ``nodeData`` value; ``split`` is (feature, threshold), and rows up to the threshold go left."""
    cut = NO_SPLIT if split is None else (split[0], [split[1]], -1)
    return (number, prediction, impurity, stats, rows, gain, *children, cut)


@cache
def _template(application: str, kind: type) -> tuple[str, str]:
    """Metadata of a model with a single tree, and of that tree."""
    spark = SparkSession.active()
    rows = spark.createDataFrame([(0.0, Vectors.dense([0.0])), (1.0, Vectors.dense([1.0]))], ["label", "features"])
    maker = _CLASSES[kind]
    made = maker(maxIter=1, maxDepth=1) if maker is GBTClassifier else maker(numTrees=1, maxDepth=1)
    path = scratch_dir(spark)
    made.fit(rows).write().save(path)
    return spark.read.text(f"{path}/metadata").first()[0], spark.read.parquet(f"{path}/treesMetadata").first()[1]


def assemble(kind: type, nodes: DataFrame, trees: int, features: int, columns: dict[str, str], impurity: str | None = None) -> Any:
    """The Spark model ``kind`` of ``nodes`` (:data:`NODE_SCHEMA`), each tree with weight 1; ``columns`` are its column parameters."""
    path = scratch_dir(nodes.sparkSession)
    write_ensemble(path, kind, nodes, trees, features, columns, impurity)
    return kind.load(path)


def write_ensemble(path: str, kind: type, nodes: DataFrame, trees: int, features: int, columns: dict[str, str], impurity: str | None = None, named: dict[str, str] | None = None) -> None:
    """Write such a model without loading it; ``named`` replaces entries of its metadata."""
    spark = nodes.sparkSession
    model, tree = map(json.loads, _template(spark.sparkContext.applicationId, kind))
    model |= {"numFeatures": features, "numTrees": trees}
    set_here = {"numTrees": trees} if kind is RandomForestClassificationModel else {"maxIter": trees}
    model["paramMap"] = {**columns, **set_here, **({"impurity": impurity} if impurity else {})}
    tree["paramMap"] = {"impurity": impurity} if impurity else {}
    model |= named or {}
    spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    about = [(t, json.dumps({**tree, "uid": f"{tree['uid']}_{t}"}), 1.0) for t in range(trees)]
    spark.createDataFrame(about, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    with freed_shuffles(spark):
        nodes.write.parquet(f"{path}/data")
