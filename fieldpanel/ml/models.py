"""Model builders and the fitted model, on Spark ML estimators."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpanel.ml.boosting import BoostedTrees
from fieldpanel.ml.deep_forest import DeepForest
from fieldpanel.ml.prep import LABEL, SCALED, Prep
from fieldpanel.operators.metrics import rate
from fieldpanel.operators.split import add_class_weights

LR, RF, GBT = "logistic_regression", "random_forest", "gradient_boosting"
MAX_TREE_DEPTH = 30  # the deepest tree that Spark's own forest grows


@dataclass(frozen=True)
class ModelSpec:
    """An unfitted model: kind, hyperparameters, preparation and feature selection."""

    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    prep: Prep = Prep()
    feat_select: str | None = None
    step: int | float = 1
    num_feats: int = 4
    min_num_feats: int = 4
    num_folds: int = 5
    scoring: Any = "f1"
    seed: int = 591


@dataclass(frozen=True)
class Selection:
    """Feature elimination: ``method`` None, "RFE" (down to ``features``) or "RFECV" (at least ``features``)."""

    method: str | None = None
    features: int | None = None
    step: int | float = 1
    folds: int = 5
    scoring: Any = "f1"

    def __post_init__(self) -> None:
        if self.method not in (None, "RFE", "RFECV"):
            raise ValueError(f"unknown elimination method {self.method!r}: use RFE, RFECV or None")


def _spec(kind: str, selection: Selection | None, drop_features: Sequence[str] | None, seed: int, params: dict[str, Any]) -> ModelSpec:
    """An unfitted model of a kind; linear models are scaled, weighted by class and keep six features by default."""
    if isinstance(drop_features, str):
        raise ValueError("drop_features takes several column names, not one string")
    chosen, dropped = selection or Selection(), tuple(drop_features or ())
    if kind == LR:
        params = {"max_iter": 500, "class_weight": "balanced", **params}
        prep = Prep(dropped, scaled=tuple(SCALED), category_first=False)
    else:
        prep = Prep(dropped, unknown="error") if kind == RF else Prep(dropped)
    least = chosen.features or (6 if kind == LR else 4)
    return ModelSpec(kind, params, prep, chosen.method, chosen.step, least, least, chosen.folds, chosen.scoring, seed)


def build_gradient_boosting(selection: Selection | None = None, drop_features: Sequence[str] | None = None, seed: int = 591, **params: Any) -> ModelSpec:
    return _spec(GBT, selection, drop_features, seed, params)


def build_random_forest(selection: Selection | None = None, drop_features: Sequence[str] | None = None, seed: int = 591, **params: Any) -> ModelSpec:
    return _spec(RF, selection, drop_features, seed, params)


def build_logistic_regression(selection: Selection | None = None, drop_features: Sequence[str] | None = None, seed: int = 591, **params: Any) -> ModelSpec:
    return _spec(LR, selection, drop_features, seed, params)


BUILDERS = {LR: build_logistic_regression, RF: build_random_forest, GBT: build_gradient_boosting}


def estimator(kind: str, params: dict[str, Any], seed: int, total_weight: float) -> Estimator:
    """The Spark estimator for familiar hyperparameter names.

    The linear penalty is given per sample in Spark, hence ``1 / (C * total weight)``. Forests without a depth limit
    (``max_depth=None``, the default) are grown by :class:`DeepForest`, others by Spark up to its own limit. Boosting is
    :class:`BoostedTrees`, with L1 and L2 penalties on the leaves.
    """
    known = {"n_jobs", "class_weight", "eval_metric"}
    common = {"featuresCol": "features", "labelCol": LABEL, "weightCol": "weight"}
    p = {k: v for k, v in params.items() if k not in known}
    if kind == LR:
        penalty = p.pop("penalty", "l2")
        ratio = {"l2": 0.0, "l1": 1.0, "elasticnet": p.pop("l1_ratio", 0.5), None: 0.0}[penalty]
        strength = 0.0 if penalty is None else 1.0 / (p.pop("C", 1.0) * total_weight)
        p.pop("C", None), p.pop("l1_ratio", None), p.pop("solver", None)
        made = LogisticRegression(
            regParam=strength,
            elasticNetParam=ratio,
            standardization=False,
            maxIter=p.pop("max_iter", 100),
            tol=p.pop("tol", 1e-6),
            **common,
        )
    elif kind == RF:
        criterion, subset = p.pop("criterion", "gini"), p.pop("max_features", "sqrt")
        trees, depth = p.pop("n_estimators", 100), p.pop("max_depth", None)
        bootstrap, least = p.pop("bootstrap", True), p.pop("min_samples_leaf", 1)
        if depth is None:
            made = DeepForest(trees, criterion, subset, bootstrap, least, seed=seed)
        elif 0 <= depth <= MAX_TREE_DEPTH:
            made = RandomForestClassifier(
                numTrees=trees,
                maxDepth=depth,
                impurity="gini" if criterion == "gini" else "entropy",
                featureSubsetStrategy="all" if subset is None else str(subset),
                bootstrap=bootstrap,
                minInstancesPerNode=least,
                # Rows keep the number of their node in every tree, rather than go down from the root on every level.
                cacheNodeIds=True,
                seed=seed,
                **common,
            )
        else:
            raise ValueError(f"max_depth must be None or from 0 to {MAX_TREE_DEPTH}, got {depth}")
    elif kind == GBT:
        names = {f.name for f in fields(BoostedTrees)} - {"features", "losses", "best_round", "seed"}
        made = BoostedTrees(**{name: p.pop(name) for name in sorted(names & set(p))}, seed=seed)
    else:
        raise ValueError(f"kind must be one of {sorted(BUILDERS)}, got {kind}")
    if p:
        raise ValueError(f"unknown parameters for {kind}: {sorted(p)}")
    return made


def weighted(df: DataFrame, params: dict[str, Any], weight_col: str | None = None) -> DataFrame:
    """Add ``weight``: balanced class weights where asked for, times a given sample weight, kept as ``_given``."""
    given = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    marked = df.withColumn("_given", given)
    if params.get("class_weight") == "balanced":
        marked = add_class_weights(marked, weight="weight")
        return marked.withColumn("weight", F.col("weight") * F.col("_given"))
    return marked.withColumn("weight", given)


#: Rows of a part that a fit reads at the least, and parts for each core at the most.
PART_ROWS, PARTS_PER_CORE = 10_000, 4


def kept_for_fit(prepared: DataFrame) -> DataFrame:
    """Persist rows for an iterative fit, dealt evenly.

    Stored rows are read in about as many parts as there are cores, or fewer, and not of one size; every pass of a fit
    would wait for the largest.
    """
    cores = prepared.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(PARTS_PER_CORE * cores, -(-prepared.count() // PART_ROWS)))
    return prepared.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)


def slicer(indices: list[int], source: str = "features", target: str = "chosen") -> VectorSlicer:
    return VectorSlicer(inputCol=source, outputCol=target, indices=list(indices))


def fit_on_features(
    kind: str, params: dict[str, Any], seed: int, prepared: DataFrame, features: str = "features"
) -> Any:
    """Fit the classifier on a frame with the feature vector, label and ``weight``."""
    total = prepared.agg(F.sum("weight")).first()[0] if kind == LR else 1.0
    made = estimator(kind, params, seed, total)
    return made.setFeaturesCol(features).fit(prepared)


@dataclass
class FittedModel:
    """Preparation, chosen features and classifier behind one ``transform``."""

    spec_kind: str
    params: dict[str, Any]
    pipeline: PipelineModel
    names: list[str]
    selected: list[str]

    @property
    def classifier(self) -> Any:
        return self.pipeline.stages[-1]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``y_pred`` (0/1), ``y_prob`` (class 0), ``y_prob_high`` and the log-probabilities."""
        out = self.pipeline.transform(df)
        p = vector_to_array(F.col("probability"))
        return out.select(
            *df.columns,
            F.col("prediction").cast("int").alias("y_pred"),
            p[0].alias("y_prob"),
            p[1].alias("y_prob_high"),
            F.log(p[0]).alias("log_prob_low"),
            F.log(p[1]).alias("log_prob_high"),
        )

    def features(self, df: DataFrame) -> DataFrame:
        """The reduced feature vector, as ``chosen``."""
        stages = PipelineModel(stages=self.pipeline.stages[:-1])
        return stages.transform(df).select(*df.columns, "chosen")

    def score(self, df: DataFrame, weight_col: str | None = None) -> float:
        """Accuracy, weighted where a weight column is given."""
        weight = F.col(weight_col) if weight_col else F.lit(1.0)
        hit = F.when(F.col("y_pred") == F.col(LABEL), weight).otherwise(0.0)
        return self.transform(df).agg(rate(F.sum(hit), F.sum(weight))).first()[0]

    def get_params(self) -> dict[str, Any]:
        model = self.classifier
        return {p.name: v for p, v in model.extractParamMap().items()}

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        about = {"kind": self.spec_kind, "params": self.params, "names": self.names, "selected": self.selected}
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/about"
        )

    @classmethod
    def load(cls, path: str) -> FittedModel:
        about = json.loads(SparkSession.active().read.text(f"{path}/about").first()[0])
        pipeline = PipelineModel.load(f"{path}/pipeline")
        return cls(about["kind"], about["params"], pipeline, about["names"], about["selected"])


def fit(spec: ModelSpec, df: DataFrame, weight_col: str | None = None, key: str = "ID") -> FittedModel:
    """Prepare, select features where asked for, and fit on complete rows."""
    from fieldpanel.ml.select import choose_features

    complete = df.dropna()
    reserved = tuple({*spec.prep.reserved, *([weight_col] if weight_col else [])})
    prep = replace(spec.prep, reserved=reserved).fit(complete)
    prepared = kept_for_fit(weighted(prep.transform(complete), spec.params, weight_col))
    try:
        indices = choose_features(spec, prepared, len(prep.names), key)
        cut = slicer(indices)
        model = fit_on_features(spec.kind, spec.params, spec.seed, cut.transform(prepared), "chosen")
    finally:
        prepared.unpersist()
    pipeline = PipelineModel(stages=[prep.pipeline, cut, model])
    return FittedModel(spec.kind, dict(spec.params), pipeline, prep.names, [prep.names[i] for i in indices])
