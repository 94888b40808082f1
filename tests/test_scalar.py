import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldpanel.functions import scalar


def classes(spark, strings, **options):
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    return [r[0] for r in df.select(scalar.composition_class(F.col("s"), **options)).collect()]


def test_composition_classes(spark):
    strings = [f"HW {a}, SW {100 - a}" for a in (100, 80, 70, 50, 30, 20, 0)]
    assert classes(spark, strings) == ["Decidous", "Decidous", "Mixed", "Mixed", "Mixed", "Conifer", "Conifer"]


@pytest.mark.parametrize("bad", ["an invalid string", "HW 0, SW 0", None])
def test_composition_errors(spark, bad):
    with pytest.raises(PySparkException):
        classes(spark, [bad])
    assert classes(spark, [bad], strict=False) == [None]


def test_threshold_label(spark):
    df = spark.createDataFrame([(x,) for x in (100.0, 95.6, 80.0, 74.6, 40.3, 0.0, None, math.nan)], "target double")
    got = [r[0] for r in df.select(scalar.below_threshold_label(F.col("target"), 0.8)).collect()]
    assert got == [1, 1, 1, 0, 0, 0, 1, 1]


@pytest.mark.parametrize("threshold", [None, 80, -0.1])
def test_threshold_must_be_a_share(threshold):
    with pytest.raises(ValueError):
        scalar.below_threshold_label(F.col("target"), threshold)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, math.nan), (2, 0.5)], "k int, v double")
    assert [tuple(r) for r in scalar.nan_to_null(df).collect()] == [(1, None), (2, 0.5)]


def test_ratio_and_zscore_of_zero(spark):
    df = spark.createDataFrame([(5.0, 0.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        scalar.ratio(a, b), scalar.zscore(a, a, b), scalar.zscore(a, a, b, "zero")
    ).first()
    assert tuple(got) == (None, None, 0.0)


def test_names_and_labels(spark):
    df = spark.createDataFrame([("random_forest", 70)], "m string, t int")
    got = df.select(scalar.title_label(F.col("m")), scalar.percent_label(F.col("t"))).first()
    assert tuple(got) == ("Random Forest", "70%")
    renamed = scalar.strip_prefix(df.withColumnRenamed("m", "step__model"))
    assert renamed.columns == ["model", "t"]
