"""Feature preparation as Spark ML stages, with the encoded feature names."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldpanel.schemas import INDEX_COLS

# Identifiers that never become features, and the columns the linear model standardises.
IDENTIFIERS = ["ID", "PixelID", "Season", "SrvvR_Date", "record_no"]
SCALED = [*INDEX_COLS, "Density"]
CATEGORY = "Type"
LABEL = "target"


@dataclass(frozen=True)
class FittedPrep:
    pipeline: PipelineModel
    names: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the ``features`` vector; helper columns are removed."""
        out = self.pipeline.transform(df)
        return out.select(*df.columns, "features")


@dataclass(frozen=True)
class Prep:
    """Drop identifiers, one-hot the category, standardise or pass the numeric columns.

    ``scaled`` lists columns to standardise (population deviation), or is ``"all"``. ``unknown`` decides about
    category levels not seen in fitting: ``"ignore"`` encodes them as zeros, ``"error"`` fails.
    """

    drop_features: tuple[str, ...] = ()
    scaled: tuple[str, ...] | str = ()
    category_first: bool = True
    unknown: str = "ignore"
    reserved: tuple[str, ...] = ("weight", "fold")

    def numeric_columns(self, df: DataFrame) -> list[str]:
        skipped = {*IDENTIFIERS, *self.drop_features, *self.reserved, CATEGORY, LABEL}
        return [f.name for f in df.schema.fields if f.name not in skipped and isinstance(f.dataType, T.NumericType)]

    def fit(self, df: DataFrame) -> FittedPrep:
        numeric = self.numeric_columns(df)
        scaled = numeric if self.scaled == "all" else [c for c in numeric if c in self.scaled]
        passed = [c for c in numeric if c not in scaled]
        stages = [
            StringIndexer(
                inputCol=CATEGORY,
                outputCol="_level",
                stringOrderType="alphabetAsc",
                handleInvalid="keep" if self.unknown == "ignore" else "error",
            ),
            # Under "keep" the last index stands for unknown levels, and dropping it leaves zeros for them.
            OneHotEncoder(inputCol="_level", outputCol="_types", dropLast=self.unknown == "ignore"),
        ]
        if scaled:
            rows = df.count()
            spread = math.sqrt(rows / (rows - 1)) if rows > 1 else 1.0
            stages += [
                VectorAssembler(inputCols=scaled, outputCol="_plain"),
                StandardScaler(inputCol="_plain", outputCol="_sample", withMean=True, withStd=True),
                ElementwiseProduct(
                    scalingVec=Vectors.dense([spread] * len(scaled)), inputCol="_sample", outputCol="_scaled"
                ),
            ]
        parts = ["_types", *(["_scaled"] if scaled else [])]
        parts = parts if self.category_first else parts[::-1]
        stages.append(VectorAssembler(inputCols=[*parts, *passed], outputCol="features"))
        model = Pipeline(stages=stages).fit(df)
        types = [f"{CATEGORY}_{level}" for level in model.stages[0].labels]
        blocks = {"_types": types, "_scaled": scaled}
        return FittedPrep(model, [n for p in parts for n in blocks[p]] + passed)
