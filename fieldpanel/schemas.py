"""Column names, declared table schemas and the schema check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the survey / observation tables.
BOUNDED_INDICES = ["NDVI", "SAVI", "MSAVI", "EVI", "EVI2", "NDWI", "NBR"]
TASSELED_CAP = ["TCB", "TCG", "TCW"]
INDEX_COLS = BOUNDED_INDICES + TASSELED_CAP
PIXEL_KEY = ["ID", "PixelID"]
SURVEY_KEY = ["ID", "PixelID", "Age"]
RECORD_KEY = ["ID", "PixelID", "SrvvR_Date"]
AGES = list(range(1, 8))
RATE_COLS = [f"SrvvR_{k}" for k in AGES]
DATE_COLS = [f"AsssD_{k}" for k in AGES]
# Levels of the composition class, default label thresholds, land uses that count as agricultural.
TYPE_LEVELS = ["Conifer", "Decidous", "Mixed"]
THRESHOLDS = [0.5, 0.6, 0.7, 0.8]
AGRICULTURAL_USES = ["AG", "Fallow", "Cash crop rotation", "Pasture / hay production"]

RAW_SCHEMA = T.StructType(
    [
        T.StructField("ID", T.LongType(), False),
        T.StructField("PixelID", T.StringType(), False),
        T.StructField("Area_ha", T.DoubleType()),
        T.StructField("Season", T.IntegerType()),
        T.StructField("PlantDt", T.DateType()),
        T.StructField("prevUse", T.StringType()),
        T.StructField("Planted", T.DoubleType()),
        T.StructField("SpcsCmp", T.StringType()),
        T.StructField("Type", T.StringType()),
        T.StructField("NmbrPlO", T.DoubleType()),
        T.StructField("NmbrPlR", T.DoubleType()),
        T.StructField("NmbrPlT", T.DoubleType()),
        *[T.StructField(c, T.DoubleType()) for c in RATE_COLS],
        *[T.StructField(c, T.DateType()) for c in DATE_COLS],
        T.StructField("ImgDate", T.DateType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("DOY", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in INDEX_COLS],
    ]
)

STATS_SCHEMA = T.StructType(
    [
        T.StructField("mean", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("std", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Raise ``ValueError`` unless every declared column is present with its declared type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    wrong = [
        f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}"
        for f in schema.fields
        if have[f.name] != f.dataType
    ]
    if wrong:
        raise ValueError(f"column types differ: {wrong}")
    return df


def require_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail the job on a row whose key is null (joins here use SQL equality, which skips null keys)."""
    for key in keys:
        message = F.lit(f"null key column {key}")
        df = df.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(message)).otherwise(F.col(key)))
    return df
