"""Random and grid search with folds by group."""

from __future__ import annotations

import itertools
import math
import random
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpanel.ml.evaluate import SIDE_BY_SIDE, in_threads, scorer
from fieldpanel.ml.models import GBT, LR, RF, ModelSpec, fit, fit_on_features, slicer, weighted
from fieldpanel.ml.select import choose_features
from fieldpanel.operators.split import group_folds
from fieldpanel.sources.io import materialise


@dataclass(frozen=True)
class RandInt:
    """Integers from ``low`` up to but not including ``high``."""

    low: int
    high: int

    def sample(self, rng: random.Random) -> int:
        return rng.randrange(self.low, self.high)


@dataclass(frozen=True)
class Uniform:
    """Floats from ``start`` to ``start + width``."""

    start: float
    width: float

    def sample(self, rng: random.Random) -> float:
        return self.start + self.width * rng.random()


@dataclass(frozen=True)
class LogUniform:
    """Floats whose logarithm is uniform."""

    low: float
    high: float

    def sample(self, rng: random.Random) -> float:
        return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))


Space = Mapping[str, Any]
DISTRIBUTIONS = (RandInt, Uniform, LogUniform)


def default_space(kind: str) -> dict[str, Any]:
    """Search space of each model."""
    # The ranges and choices searched by default.
    spaces = {
        GBT: {
            "max_depth": RandInt(2, 10),
            "learning_rate": Uniform(0.01, 0.3),
            "n_estimators": RandInt(500, 2000),
        },
        RF: {
            "criterion": ["gini", "entropy", "log_loss"],
            "max_depth": RandInt(1, 20),
            "bootstrap": [True, False],
            "class_weight": ["balanced", None],
            "n_estimators": RandInt(100, 1000),
            "max_features": ["sqrt", "log2", None],
            "n_jobs": [-1],
        },
        LR: {
            "C": LogUniform(1e-4, 1e2),
            "penalty": ["l2", "l1", "elasticnet", None],
            "class_weight": ["balanced", None],
            "max_iter": RandInt(5000, 10000),
        },
    }
    if kind not in spaces:
        raise ValueError(f"kind must be one of {sorted(spaces)}, got {kind}")
    return spaces[kind]


def grid_configs(space: Space) -> list[dict[str, Any]]:
    """All combinations of the listed values."""
    for name, values in space.items():
        if isinstance(values, (*DISTRIBUTIONS, str)) or not isinstance(values, Sequence):
            raise TypeError(f"grid search needs a list of values for {name!r}, got {values!r}")
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def sample_configs(space: Space, count: int, seed: int) -> list[dict[str, Any]]:
    """Seeded draws; without repeats where every entry is a list."""
    rng = random.Random(seed)
    if not any(isinstance(v, DISTRIBUTIONS) for v in space.values()):
        grid = grid_configs(space)
        return rng.sample(grid, min(count, len(grid)))
    return [
        {k: v.sample(rng) if isinstance(v, DISTRIBUTIONS) else rng.choice(list(v)) for k, v in space.items()}
        for _ in range(count)
    ]


def cross_validate(
    spec: ModelSpec,
    df: DataFrame,
    configs: Sequence[dict[str, Any]],
    num_folds: int = 5,
    scoring: Any = "f1",
    seed: int = 591,
    key: str = "ID",
    parallelism: int = SIDE_BY_SIDE,
    weight_col: str | None = None,
) -> list[dict[str, Any]]:
    """One record per (config, fold) with score, fit and score seconds.

    Rows are prepared once per fold and shared by all configurations. Fits run side by side, whatever their fold: most of
    their jobs are too small to fill the executors. Features are
    selected and classes weighted inside each fit, as in the refit of the best configuration.
    """
    reserved = tuple({*spec.prep.reserved, *([weight_col] if weight_col else [])})
    folded = materialise(group_folds(df.dropna(), num_folds, seed, key))

    def prepared(f: int) -> tuple[Any, DataFrame, DataFrame]:
        train = folded.filter(F.col("fold") != f).drop("fold")
        prep = replace(spec.prep, reserved=reserved).fit(train)
        seen = prep.transform(train).persist(StorageLevel.MEMORY_AND_DISK)
        return prep, seen, prep.transform(folded.filter(F.col("fold") == f)).persist(StorageLevel.MEMORY_AND_DISK)

    sides = in_threads([lambda f=f: prepared(f) for f in range(num_folds)], parallelism)

    def one(f: int, i: int) -> dict[str, Any]:
        prep, seen, held = sides[f]
        params = {**spec.params, **configs[i]}
        start = time.time()
        rows = weighted(seen, params, weight_col)
        cut = slicer(choose_features(replace(spec, params=params), rows, len(prep.names), key))
        model = fit_on_features(spec.kind, params, spec.seed, cut.transform(rows), "chosen")
        fitted = time.time()
        score = scorer(scoring).evaluate(model.transform(cut.transform(held)))
        return {
            "config": i, "fold": f, "score": float(score),
            "fit_time": fitted - start, "score_time": time.time() - fitted,
        }

    try:
        return in_threads([lambda f=f, i=i: one(f, i) for f in range(num_folds) for i in range(len(configs))], parallelism)
    finally:
        for _, seen, held in sides:
            seen.unpersist()
            held.unpersist()


def experiment_table(df: DataFrame, records: Sequence[dict[str, Any]], configs: Sequence[dict[str, Any]]) -> DataFrame:
    """(config, params, fold, score, fit_time, score_time), one row per fit."""
    rows = [
        (r["config"], {k: str(v) for k, v in configs[r["config"]].items()}, r["fold"], r["score"], r["fit_time"], r["score_time"])
        for r in records
    ]
    schema = "config int, params map<string,string>, fold int, score double, fit_time double, score_time double"
    return df.sparkSession.createDataFrame(rows, schema)


def search_log(experiments: DataFrame, names: Sequence[str], digits: int = 3) -> DataFrame:
    """Mean and population deviation over the folds of each configuration, best first."""
    means = experiments.groupBy("config").agg(
        F.avg("fit_time").alias("mean_fit_time"),
        F.stddev_pop("fit_time").alias("std_fit_time"),
        F.avg("score_time").alias("mean_score_time"),
        F.stddev_pop("score_time").alias("std_score_time"),
        F.first("params").alias("params"),
        F.avg("score").alias("mean_test_score"),
        F.stddev_pop("score").alias("std_test_score"),
    )
    # Sorted by the exact mean, shown rounded.
    ranked = means.orderBy(F.desc("mean_test_score"), "config").select(
        "config",
        *[F.round(c, digits).alias(c) for c in ("mean_fit_time", "std_fit_time", "mean_score_time", "std_score_time")],
        *[F.col("params")[n].alias(n) for n in names],
        *[F.round(c, digits).alias(c) for c in ("mean_test_score", "std_test_score")],
    )
    return ranked


def search(
    spec: ModelSpec,
    df: DataFrame,
    space: Space,
    method: str = "random",
    num_iter: int = 10,
    num_folds: int = 5,
    scoring: Any = "f1",
    return_results: bool = False,
    seed: int = 591,
    key: str = "ID",
    parallelism: int = SIDE_BY_SIDE,
    weight_col: str | None = None,
) -> dict[str, Any]:
    """Best configuration over group folds, refitted on all rows: best_model, best_score, best_params, results."""
    if method not in ("random", "grid"):
        raise ValueError(f"unknown search method {method!r}: use random or grid")
    configs = grid_configs(space) if method == "grid" else sample_configs(space, num_iter, seed)
    records = cross_validate(spec, df, configs, num_folds, scoring, seed, key, parallelism, weight_col)
    sums = [0.0] * len(configs)
    for r in records:
        sums[r["config"]] += r["score"]
    larger = scorer(scoring).isLargerBetter()
    best = min(range(len(configs)), key=lambda i: (-sums[i] if larger else sums[i], i))
    out = {
        "best_model": fit(replace(spec, params={**spec.params, **configs[best]}), df, weight_col, key),
        "best_score": sums[best] / num_folds,
        "best_params": configs[best],
    }
    if return_results:
        experiments = experiment_table(df, records, configs)
        out["experiments"] = experiments
        out["results"] = search_log(experiments, list(space))
    return out
