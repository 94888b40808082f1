"""Permutation importance, additive contributions of fitted models, and the importance selector."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldpanel.ml.evaluate import score_expression
from fieldpanel.ml.kernels import Forest, matrix, swapped_answers
from fieldpanel.ml.models import FittedModel, ModelSpec, fit_on_features, kept_for_fit, slicer, weighted
from fieldpanel.ml.prep import LABEL
from fieldpanel.operators.importance import top_features
from fieldpanel.operators.metrics import COUNTS, confusion
from fieldpanel.operators.ordering import hash_rank
from fieldpanel.schemas import SURVEY_KEY
from fieldpanel.sources.io import materialise, scratch_dir, ship


#: Pairs of rows that a task goes through the trees at once.
SLICE_ROWS = 256
#: Nodes of a forest that a task takes in for :func:`swapped_counts`; larger forests are left to Spark's own prediction.
MOST_NODES = 2_000_000


def forest_nodes(model: RandomForestClassificationModel) -> Forest | None:
    """The nodes of a forest of two classes; None for more classes, wider categories, or too many nodes.

    The finished model is in the driver's memory, as any Spark ensemble is.
    """
    if model.numClasses != 2 or model.totalNumNodes > MOST_NODES or model.isDefined("thresholds"):
        return None
    spark = SparkSession.active()
    path = scratch_dir(spark)
    model.write().save(path)
    split = F.col("nodeData.split")
    saved = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.impurityStats",
        split.featureIndex.alias("feature"), split.numCategories.alias("categories"), split.leftCategoriesOrThreshold.alias("cut"),
    )
    nodes = saved.toPandas().sort_values(["tree", "id"], ignore_index=True)
    inner = nodes["leftChild"].to_numpy() >= 0
    # A feature of two categories, 0 and 1, is cut between them; if 1 goes left, the sides are exchanged.
    categories = nodes["categories"].to_numpy()
    if (inner & (categories > 2)).any():
        return None
    two = inner & (categories == 2)
    cut = np.array([c[0] if i else np.inf for i, c in zip(inner, nodes["cut"])], np.float64)
    size = np.bincount(nodes["tree"].to_numpy(), minlength=model.getNumTrees)
    roots = np.cumsum(size) - size
    first, own = roots[nodes["tree"].to_numpy()], np.arange(len(nodes))
    left, right = (np.where(inner, first + nodes[c].to_numpy(), own) for c in ("leftChild", "rightChild"))
    turned = two & (cut == 1.0)
    left, right = np.where(turned, right, left), np.where(turned, left, right)
    stats = np.stack(nodes["impurityStats"].to_numpy()).astype(np.float64)
    total = stats[:, 0] + stats[:, 1]
    share = np.divide(stats.T, total, out=np.zeros((2, len(nodes))), where=total != 0)
    depth, level = 0, roots
    while (level := level[inner[level]]).size:
        depth, level = depth + 1, np.concatenate([left[level], right[level]])
    return Forest(np.where(inner, nodes["feature"].to_numpy(), 0), np.where(two, 0.5, cut), left, right, share, roots, depth)


def swapped_counts(forest: Forest, paired: DataFrame, size: int) -> DataFrame:
    """``repeat, _j, tp, fn, fp, tn`` of rows ``_own`` that take feature ``_j`` from ``_donor``."""
    ship(paired.sparkSession)
    names = ["repeat", "_j", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                high = swapped_answers(forest, matrix(part.column("_own"), size), matrix(part.column("_donor"), size))
                repeat, truth = part.column("repeat").to_numpy(), part.column("truth").to_numpy(zero_copy_only=False)
                for r in np.unique(repeat).tolist():
                    cells = [((repeat == r) & (truth == actual))[:, None] & (high == answer) for actual, answer in ((0, 0), (0, 1), (1, 0), (1, 1))]
                    totals[r] = totals.get(r, 0) + np.stack([c.sum(0) for c in cells])
        for r, counts in totals.items():
            cols = [np.full(size, r), np.arange(size), *counts]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    taken = paired.select("repeat", F.col(LABEL).cast("double").alias("truth"), "_own", "_donor")
    parts = taken.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    summed = parts.groupBy("repeat", "_j").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return summed.withColumns({c: F.col(c).cast("int") for c in ("repeat", "_j")})


def permutation_scores(
    model: Any,
    prepared: DataFrame,
    names: Sequence[str],
    repeats: int = 5,
    scoring: str = "accuracy",
    seed: int = 591,
    keys: Sequence[str] = tuple(SURVEY_KEY),
    features: str = "features",
) -> DataFrame:
    """(feature, repeat, importance): drop of the score when one feature is shuffled among the rows.

    Two seeded orders of the rows, matched by rank, give each row a donor row per repeat; every feature of that
    repeat is taken from the same donor. Predictions are counted where they are made, so only counts are shuffled.
    Forests go down again only where the donor's value changes a row's way; other models predict every copy.
    """
    keys = list(keys)
    rows = prepared.select(*keys, LABEL, vector_to_array(F.col(features)).alias("_own"))
    base = hash_rank(rows, keys, f"{seed}:base", rank="_i")
    donors = [
        hash_rank(rows, keys, f"{seed}:{r}", rank="_i").select(
            "_i", F.col("_own").alias("_donor"), F.lit(r).alias("repeat")
        )
        for r in range(repeats)
    ]
    paired = base.join(reduce(DataFrame.unionByName, donors), "_i", "inner")
    forest = forest_nodes(model) if isinstance(model, RandomForestClassificationModel) else None
    if forest is not None:
        counted = swapped_counts(forest, paired, len(names))
    else:
        shuffled = paired.withColumn("_j", F.explode(F.array(*[F.lit(j) for j in range(len(names))])))
        swapped = F.transform("_own", lambda x, i: F.when(i == F.col("_j"), F.get("_donor", F.col("_j"))).otherwise(x))
        scored = model.transform(shuffled.select("repeat", "_j", LABEL, array_to_vector(swapped).alias(features)))
        counted = confusion(scored, ["repeat", "_j"], LABEL, "prediction")
    score = score_expression(scoring)
    after = counted.select("repeat", "_j", score.alias("_after"))
    before = confusion(model.transform(prepared), (), LABEL, "prediction").select(score.alias("_before"))
    feature = F.array(*[F.lit(n) for n in names])[F.col("_j")]
    return after.crossJoin(F.broadcast(before)).select(
        feature.alias("feature"), "repeat", (F.col("_before") - F.col("_after")).alias("importance")
    )


def permutation_summary(scores: DataFrame) -> DataFrame:
    """(feature, importance, std) over the repeats, population deviation."""
    return scores.groupBy("feature").agg(
        F.avg("importance").alias("importance"), F.stddev_pop("importance").alias("std")
    )


def leaf_paths(model: Any, size: int) -> DataFrame:
    """Stored ``tree, leaf, value, phi``: contributions of the features on the way to every leaf, as a table.

    On the way from the root to a leaf every split credits its feature with the change of the node value: the probability
    of class 0 in a forest, the margin of class 1 in boosting. Nodes are read from the saved model. Every node knows its
    parent; in each round it adds what its ancestor has gathered and takes over that one's ancestor, so the rounds grow
    with the logarithm of the depth. ``leaf`` counts from the left, as Spark's own leaf column does, and ``value`` is the
    one at the tree's root.
    """
    spark = SparkSession.active()
    path = scratch_dir(spark)
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    boosted = isinstance(model, GBTClassificationModel)
    weights = [2.0 * w for w in model.treeWeights] if boosted else [1.0 / model.getNumTrees] * model.getNumTrees
    scale = spark.createDataFrame(list(enumerate(map(float, weights))), "tree int, scale double")
    raw = F.col("prediction") if boosted else F.col("impurityStats")[0] / F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    nodes = materialise(saved.join(scale, "tree").select("tree", "id", (raw * F.col("scale")).alias("value"), "leftChild", "rightChild", F.col("split.featureIndex").alias("feature")))
    sides = F.explode(F.array(F.struct(F.col("leftChild").alias("id"), F.lit("0").alias("side")), F.struct(F.col("rightChild").alias("id"), F.lit("1").alias("side"))))
    parents = nodes.filter("leftChild >= 0").select("tree", F.col("id").alias("up"), F.col("value").alias("before"), "feature", sides.alias("child")).select("tree", "up", "before", "feature", "child.*")
    hung = nodes.select("tree", "id", "value", (F.col("leftChild") < 0).alias("is_leaf")).join(parents, ["tree", "id"], "left")
    step = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.when(j == F.col("feature"), F.col("value") - F.col("before")).otherwise(0.0))
    # ``path`` is the way down from ``up`` to the node; the root has no ``up``.
    way = materialise(hung.select("tree", "id", "is_leaf", "up", step.alias("phi"), F.coalesce("side", F.lit("")).alias("path"), F.when(F.col("up").isNull(), F.col("value")).alias("top")))
    while not way.filter(F.col("up").isNotNull()).isEmpty():
        over = way.select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("phi").alias("phi_up"), F.col("path").alias("path_up"), F.col("top").alias("top_up"))
        joined = way.join(over, ["tree", "up"], "left")
        added = F.when(F.col("phi_up").isNull(), F.col("phi")).otherwise(F.zip_with("phi", "phi_up", lambda a, b: a + b))
        way = materialise(joined.select("tree", "id", "is_leaf", F.col("next").alias("up"), added.alias("phi"), F.concat(F.coalesce("path_up", F.lit("")), "path").alias("path"), F.coalesce("top", "top_up").alias("top")))
    order = Window.partitionBy("tree").orderBy("path")
    return materialise(way.filter("is_leaf").select("tree", (F.row_number().over(order) - 1).cast("int").alias("leaf"), F.col("top").alias("value"), "phi"))


def tree_contributions(model: Any, prepared: DataFrame, size: int, features: str = "features") -> DataFrame:
    """Add ``phi`` (array by feature) and ``base``; their sum is the explained value of the row.

    Spark finds the leaf of each tree. Rows meet the paths of their leaves in a join, whose kind Spark picks by the size of
    the stored paths, and are summed by row; no node reaches the driver, and nothing is broadcast unchecked.
    """
    paths = leaf_paths(model, size)
    rows = materialise(prepared.withColumn("_row", F.monotonically_increasing_id()))
    placed = model.copy({model.leafCol: "_leaf"}).transform(rows.select("_row", features))
    each = placed.select("_row", F.posexplode(vector_to_array(F.col("_leaf"))).alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))
    # Partial sums by row are made before the shuffle wherever the join leaves a row's trees together.
    summed = each.join(paths, ["tree", "leaf"]).groupBy("_row").agg(*[F.sum(F.col("phi")[j]).alias(f"p{j}") for j in range(size)], F.sum("value").alias("base"))
    found = summed.select("_row", F.array(*[F.col(f"p{j}") for j in range(size)]).alias("phi"), "base")
    return rows.join(found, "_row").select(*prepared.columns, "phi", "base")


def linear_phi(model: LogisticRegressionModel, prepared: DataFrame, features: str = "features") -> DataFrame:
    """Add ``phi`` = coefficient * (value - mean) by feature, and ``base``, the margin at the mean (class 1)."""
    beta = F.array(*[F.lit(float(b)) for b in model.coefficients])
    centre = prepared.agg(vector_to_array(Summarizer.mean(F.col(features))).alias("_mean"))
    joined = prepared.crossJoin(F.broadcast(centre))
    gap = F.zip_with(vector_to_array(F.col(features)), "_mean", lambda x, m: x - m)
    phi = F.zip_with(beta, gap, lambda b, d: b * d)
    at_mean = F.aggregate(F.zip_with(beta, "_mean", lambda b, m: b * m), F.lit(float(model.intercept)), lambda a, x: a + x)
    return joined.withColumns({"phi": phi, "base": at_mean}).drop("_mean")


def contributions(model: Any, prepared: DataFrame, size: int, features: str = "features") -> DataFrame:
    if isinstance(model, LogisticRegressionModel):
        return linear_phi(model, prepared, features)
    return tree_contributions(model, prepared, size, features)


def mean_absolute_phi(explained: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, importance): mean absolute contribution."""
    row = explained.agg(*[F.avg(F.abs(F.col("phi")[i])).alias(f"i{i}") for i in range(len(names))])
    entries = [F.struct(F.lit(n).alias("feature"), F.col(f"i{i}").alias("importance")) for i, n in enumerate(names)]
    return row.select(F.inline(F.array(*entries)))


class ImportanceSelector:
    """Fit, rate the features, keep the best and the forced ones, fit again.

    ``method`` is ``"SHAP"`` (mean absolute additive contribution) or ``"permute"`` (permutation importance).
    """

    def __init__(
        self,
        spec: ModelSpec,
        method: str | None = None,
        num_feats: int = 5,
        drop_features: list[str] | None = None,
        keep_features: list[str] | None = None,
        scaler: bool = False,
        scoring: str = "accuracy",
        repeats: int = 5,
    ):
        drop_features = [] if drop_features is None else drop_features
        keep_features = [] if keep_features is None else keep_features
        if method not in ("SHAP", "permute"):
            raise ValueError('method must be "SHAP" or "permute"')
        for name, value in (("drop_features", drop_features), ("keep_features", keep_features)):
            if not isinstance(value, list):
                raise ValueError(f"{name} must be a list, got {type(value).__name__}")
        if isinstance(num_feats, bool) or not isinstance(num_feats, int) or num_feats <= 0:
            raise ValueError(f"num_feats must be an integer above 0, got {num_feats!r}")
        if not isinstance(scaler, bool):
            raise ValueError(f"scaler must be a bool, got {type(scaler).__name__}")
        prep = replace(
            spec.prep,
            drop_features=tuple(drop_features),
            scaled="all" if scaler else (),
            category_first=True,
            unknown="ignore",
        )
        self.spec = replace(spec, prep=prep)
        self.method, self.num_feats, self.keep_features = method, num_feats, keep_features
        self.scoring, self.repeats = scoring, repeats

    def fit(self, df: DataFrame, weight_col: str | None = None, keys: Sequence[str] = tuple(SURVEY_KEY)) -> SelectorModel:
        spec, complete = self.spec, df.dropna()
        reserved = tuple({*spec.prep.reserved, *([weight_col] if weight_col else [])})
        prep = replace(spec.prep, reserved=reserved).fit(complete)
        missing = [c for c in self.keep_features if c not in prep.names]
        if missing:
            raise ValueError(f"keep_features are not encoded features: {missing}")
        prepared = kept_for_fit(weighted(prep.transform(complete), spec.params, weight_col))
        try:
            full = fit_on_features(spec.kind, spec.params, spec.seed, prepared)
            if self.method == "SHAP":
                values = materialise(contributions(full, prepared, len(prep.names)))
                importance = mean_absolute_phi(values, prep.names)
            else:
                values = materialise(permutation_scores(full, prepared, prep.names, self.repeats, self.scoring, spec.seed, keys))
                importance = permutation_summary(values).select("feature", "importance")
            # One row per feature.
            rated = {r["feature"]: r["importance"] for r in importance.collect()}
            rating = df.sparkSession.createDataFrame(list(rated.items()), "feature string, importance double")
            chosen = top_features(rating, self.num_feats, self.keep_features).orderBy("position").collect()
            selected = [r["feature"] for r in chosen]
            cut = slicer([prep.names.index(n) for n in selected])
            model = fit_on_features(spec.kind, spec.params, spec.seed, cut.transform(prepared), "chosen")
        finally:
            prepared.unpersist()
        fitted = FittedModel(
            spec.kind, dict(spec.params), PipelineModel(stages=[prep.pipeline, cut, model]), prep.names, selected
        )
        return SelectorModel(fitted, values, rating)


@dataclass
class SelectorModel:
    """The refitted model with the values behind its choice (``values``) and the rating (``rating``)."""

    fitted: FittedModel
    values: DataFrame
    rating: DataFrame

    @property
    def selected_features(self) -> list[str]:
        return self.fitted.selected

    def get_feature_names(self) -> list[str]:
        return self.fitted.names

    def get_params(self) -> dict[str, Any]:
        return self.fitted.get_params()

    def save(self, path: str) -> None:
        """The model, its values and its rating below one folder."""
        self.fitted.save(f"{path}/model")
        self.values.write.mode("overwrite").parquet(f"{path}/values")
        self.rating.write.mode("overwrite").parquet(f"{path}/rating")

    @classmethod
    def load(cls, path: str) -> SelectorModel:
        read = SparkSession.active().read
        return cls(FittedModel.load(f"{path}/model"), read.parquet(f"{path}/values"), read.parquet(f"{path}/rating"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Chosen features as plain columns, next to the input columns that are not features."""
        out = self.fitted.features(df)
        parts = vector_to_array(F.col("chosen"))
        others = [c for c in df.columns if c not in self.selected_features]
        return out.select(*others, *[parts[i].alias(n) for i, n in enumerate(self.selected_features)])

    def predict(self, df: DataFrame) -> DataFrame:
        return self.fitted.transform(df)

    def score(self, df: DataFrame, weight_col: str | None = None) -> float:
        return self.fitted.score(df, weight_col)
