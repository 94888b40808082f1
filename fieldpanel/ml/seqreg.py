"""Regression of the survey value on sequence summaries, with optional site columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpanel.functions.scalar import below_threshold_label
from fieldpanel.ml.models import kept_for_fit
from fieldpanel.operators.history import summarise_steps
from fieldpanel.operators.ordering import hash_cutoffs, hash_order, with_cutoffs
from fieldpanel.schemas import INDEX_COLS, RECORD_KEY

SITE_COLS = ["Age", "Density", "Type_Conifer", "Type_Decidous"]


def sequence_features(lookup: DataFrame, steps: DataFrame, value_cols: Sequence[str] = tuple(INDEX_COLS)) -> DataFrame:
    """Lookup rows with the summary of their sequence; undefined slopes count as flat."""
    summary = summarise_steps(steps, value_cols)
    return lookup.join(summary, RECORD_KEY, "inner").na.fill(0.0, [f"{c}_slope" for c in value_cols])


@dataclass(frozen=True)
class SequenceRegressor:
    """Boosted trees on the summaries; stops when the validation sites no longer improve.

    ``concat_features`` adds the site columns to the sequence summary.
    """

    concat_features: bool = False
    max_iter: int = 20
    step_size: float = 0.1
    max_depth: int = 4
    validation_share: float = 0.2
    tolerance: float = 1e-5
    seed: int = 591

    def fit(self, df: DataFrame, value_cols: Sequence[str] = tuple(INDEX_COLS), key: str = "ID") -> SequenceModel:
        inputs = ["seq_len", *[c for c in df.columns if any(c.startswith(f"{v}_") for v in value_cols)]]
        inputs += SITE_COLS if self.concat_features else []
        share = self.validation_share
        cut = hash_cutoffs(df, key, f"{self.seed}:valid", lambda n: F.array(F.floor(F.lit(share) * n)))
        last = F.try_element_at("_cutoffs", F.lit(1))
        held = F.coalesce(hash_order([key], f"{self.seed}:valid") <= last, F.lit(False))
        boosting = GBTRegressor(
            featuresCol="_x",
            labelCol="target",
            predictionCol="_raw",
            maxIter=self.max_iter,
            stepSize=self.step_size,
            maxDepth=self.max_depth,
            seed=self.seed,
            validationIndicatorCol="_valid",
            validationTol=self.tolerance,
        )
        assembler = VectorAssembler(inputCols=inputs, outputCol="_x")
        # The fit reads the rows many times, but of all columns only these.
        narrow = assembler.transform(df).select(key, "_x", "target")
        assembled = kept_for_fit(with_cutoffs(narrow, cut).select("_x", "target", held.alias("_valid")))
        try:
            return SequenceModel(PipelineModel(stages=[assembler, boosting.fit(assembled)]))
        finally:
            assembled.unpersist()


@dataclass(frozen=True)
class SequenceModel:
    pipeline: PipelineModel

    def predict(self, df: DataFrame, threshold: float = 0.7) -> DataFrame:
        """Record key, age, raw and thresholded truth and prediction (0..100)."""
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("_raw")))
        out = self.pipeline.transform(df).select(
            *RECORD_KEY, "Age", F.col("target").alias("raw_y_true"), clamped.alias("raw_y_pred")
        )
        return out.withColumns(
            {
                "y_true": below_threshold_label(F.col("raw_y_true"), threshold),
                "y_pred": below_threshold_label(F.col("raw_y_pred"), threshold),
            }
        )

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> SequenceModel:
        return cls(PipelineModel.load(path))
