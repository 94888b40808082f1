import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException

import frames
from fieldpanel.operators import clean, reshape
from fieldpanel.schemas import AGES, BOUNDED_INDICES, DATE_COLS, INDEX_COLS, RATE_COLS, RAW_SCHEMA, check_schema
from fieldpanel.sources import io

def ids(df):
    return sorted(r.ID for r in df.select("ID").collect())


def test_columns_after_cleaning(spark):
    out = clean.clean_rows(frames.raw(spark))
    order = ["ID", "PixelID", "Area_ha", "Season", "Planted", "Type", *RATE_COLS, *DATE_COLS, "ImgDate", "DOY"]
    assert out.columns == [*order, *INDEX_COLS]
    dense = clean.add_density(out)
    assert {r.Density for r in dense.collect()} == {10.0}
    assert not {"Planted", "Area_ha"} & set(dense.columns)


@pytest.mark.parametrize("index", BOUNDED_INDICES)
def test_range_rule(spark, index):
    """Both ends belong to the range; what lies just outside goes, and so do null and NaN."""
    above = math.nextafter(1.0, 2.0)
    out = clean.clean(frames.raw(spark, **{index: [-1.0, -above, 1.0, above, None, math.nan]}))
    assert ids(out) == [1, 3]


@pytest.mark.parametrize("index", INDEX_COLS)
def test_missing_index(spark, index):
    out = clean.clean(frames.raw(spark, **{index: [None, 0.5, None, 0.5, 0.5, None]}))
    assert ids(out) == [2, 4, 5]


def test_before_planting_and_replanted(spark):
    assert ids(clean.clean(frames.raw(spark, Year=[1995, 1998, 2001, 2004, 2007, 2010]))) == [4, 5, 6]
    assert ids(clean.clean(frames.raw(spark, NmbrPlR=[None, 0.0, 5.0, None, 0.0, 1.0]))) == [1, 2, 4, 5]


def test_type_is_recomputed_only_without_replanting_number(spark):
    raw = frames.raw(spark, NmbrPlR=[None, 0.0] * 3, SpcsCmp=["HW 0, SW 100"] * 6, Type=["Mixed"] * 6)
    assert {(r.ID % 2, r.Type) for r in clean.clean(raw).collect()} == {(1, "Conifer"), (0, "Mixed")}
    broken = frames.raw(spark, SpcsCmp=["nothing"] * 6)
    with pytest.raises(PySparkException):
        clean.clean(broken).collect()
    assert {r.Type for r in clean.clean(broken, strict=False).collect()} == {None}


def test_rule_counts(spark):
    counts = clean.rule_counts(frames.raw(spark, NmbrPlR=[1.0, None, None, None, None, None], NDVI=[9.0, 9.0, None, 0.1, 0.1, 0.1]))
    assert [(r.rule, r.kept, r.removed) for r in counts.collect()] == [
        ("not_replanted", 5, 1), ("indices_present", 4, 1), ("not_before_planting", 4, 0), ("indices_in_range", 3, 1),
    ]


def test_survey_long(spark):
    rows = reshape.survey_long(frames.wide_sites(spark))
    assert rows.columns == ["ID", "PixelID", "Density", "Type", "Season", "Age", "target", "SrvvR_Date"]
    got = sorted((r.Age, r.SrvvR_Date.year, r.ID) for r in rows.collect())
    assert got == [(1, 2009, 2), (2, 2010, 1), (2, 2010, 2), (4, 2012, 1), (4, 2012, 2), (5, 2013, 2), (6, 2014, 1)]


def test_survey_long_pairs_all_values_with_all_dates(spark):
    """A pixel listed with two values and three dates for one age gives six rows, as a join does."""
    base = frames.wide_sites(spark).filter("ID = 1").drop("SrvvR_2", "AsssD_2")
    variants = [(50.0, dt.date(2010, 7, 1)), (60.0, dt.date(2010, 8, 1)), (None, dt.date(2010, 9, 1))]
    extra = spark.createDataFrame(variants, "SrvvR_2 double, AsssD_2 date")
    wide = base.crossJoin(extra)
    one_pass = reshape.survey_long(wide)
    sites = reshape.site_rows(wide)
    joined = reshape.pair_rates_dates(reshape.survey_rates(sites), reshape.survey_dates(sites))
    assert sorted(one_pass.collect()) == sorted(joined.collect())
    assert one_pass.filter("Age = 2").count() == 6


def test_melted_matrix_and_one_hot(spark):
    df = spark.createDataFrame([("Conifer",), ("Mixed",)], "Type string")
    out = reshape.add_one_hot(df, "Type", ["Conifer", "Decidous"])
    assert [tuple(r) for r in out.collect()] == [(1, 0), (0, 0)]


def test_ingest(spark, tmp_path):
    raw = frames.raw(spark, NDVI=[math.nan, 0.1, 0.2, 0.3, 0.4, 0.5])
    raw.write.parquet(str(tmp_path / "p"))
    out = io.ingest_raw(spark, str(tmp_path / "p"))
    assert out.columns == RAW_SCHEMA.fieldNames()
    assert [r.NDVI for r in out.orderBy("ID").collect()][:2] == [None, 0.1]
    raw.write.option("header", True).csv(str(tmp_path / "c"))
    assert io.ingest_raw(spark, str(tmp_path / "c"), file_format="csv").count() == 6
    with pytest.raises(ValueError):
        check_schema(raw.drop("NDVI"), RAW_SCHEMA)
    with pytest.raises(ValueError):
        check_schema(raw.withColumn("DOY", raw.DOY.cast("string")), RAW_SCHEMA)
    raw.withColumn("ID", raw.ID + 0).selectExpr("nullif(ID, 1) as ID", *RAW_SCHEMA.fieldNames()[1:]).write.parquet(str(tmp_path / "n"))
    with pytest.raises(PySparkException):
        io.ingest_raw(spark, str(tmp_path / "n")).collect()


def test_ages_are_complete():
    assert AGES == [1, 2, 3, 4, 5, 6, 7]
