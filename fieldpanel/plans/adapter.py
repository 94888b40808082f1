"""Raw wide survey table derived from the star-schema test tables, in Spark and as SQL text.

customer gives the sites, orders the surveys and lineitem the observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpanel.schemas import AGES, RAW_SCHEMA

# SQL expressions shared by both engines; every index is a linear form of a lineitem column.
OBSERVED = {
    "NDVI": "l_discount * 22 - 1",
    "SAVI": "l_tax * 26 - 1",
    "MSAVI": "l_discount * 10 - 0.5e0",
    "EVI": "l_tax * 10 - 0.4e0",
    "EVI2": "(l_quantity - 25) / 25",
    "NDWI": "1 - l_discount * 20",
    "NBR": "l_tax * 20 - 0.8e0",
    "TCB": "nullif(l_quantity, 13e0)",
    "TCG": "l_extendedprice / 1000",
    "TCW": "l_quantity - l_tax * 100",
}
SITE = {
    "ID": "c_custkey",
    "Area_ha": "cast(1 + c_nationkey as double)",
    "Season": "cast(1995 + c_custkey % 3 as int)",
    "PlantDt": "cast(null as date)",
    "prevUse": "case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'Forest' else 'AG' end",
    "Planted": "cast(1000 + c_custkey % 500 as double)",
    "SpcsCmp": "concat('HW ', (c_custkey * 7) % 101, ', SW ', 100 - (c_custkey * 7) % 101)",
    "Type": "case c_custkey % 3 when 0 then 'Conifer' when 1 then 'Decidous' else 'Mixed' end",
    "NmbrPlO": "cast(1000 + c_custkey % 500 as double)",
    "NmbrPlR": "cast(case when c_custkey % 10 = 0 then 25 when c_custkey % 10 < 4 then 0 end as double)",
    "NmbrPlT": "cast(null as double)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.year("o_orderdate") - 1994
    rate = (F.floor("o_totalprice") % 111).cast("double")
    pairs = [F.max(F.when(age == k, rate)).alias(f"SrvvR_{k}") for k in AGES]
    pairs += [F.min(F.when(age == k, F.col("o_orderdate"))).cast("date").alias(f"AsssD_{k}") for k in AGES]
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ID")).agg(*pairs)


def raw_wide(spark: SparkSession, sf_dir: str, together: bool = True) -> DataFrame:
    """One row per observation with the attributes and surveys of its site.

    ``together`` leaves the rows of a site in one place, for queries that group by it. Queries that take row by row go
    without: the orders, a quarter as many, are moved to their site instead of the observations.
    """
    site = table(spark, sf_dir, "customer").selectExpr(*[f"{e} as {c}" for c, e in SITE.items()])
    site = site.join(_surveys(spark, sf_dir), "ID", "inner")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem")
    # Indices are computed last: the few columns that they come from are moved, not the many that come from them.
    if together:
        seen = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner").join(site, F.col("o_custkey") == F.col("ID"), "inner")
    else:
        orders = orders.join(site, F.col("o_custkey") == F.col("ID"), "inner")
        seen = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner")
    return seen.selectExpr(
        "o_custkey as ID",
        "concat(o_custkey, '_', l_linenumber % 2) as PixelID",
        "cast(l_shipdate as date) as ImgDate",
        "year(l_shipdate) as Year",
        "dayofyear(l_shipdate) as DOY",
        *[f"{e} as {c}" for c, e in OBSERVED.items()],
        *[c for c in site.columns if c != "ID"],
    ).select(*RAW_SCHEMA.fieldNames())


def _sql() -> str:
    site = ", ".join(f"{e} AS {c}" for c, e in SITE.items())
    observed = ", ".join(f"{e} AS {c}" for c, e in OBSERVED.items())
    rates = ", ".join(
        f"max(CASE WHEN year(o_orderdate) - 1994 = {k} "
        f"THEN CAST(CAST(floor(o_totalprice) AS bigint) % 111 AS double) END) AS SrvvR_{k}"
        for k in AGES
    )
    dates = ", ".join(
        f"CAST(min(CASE WHEN year(o_orderdate) - 1994 = {k} THEN o_orderdate END) AS date) AS AsssD_{k}" for k in AGES
    )
    columns = ", ".join(RAW_SCHEMA.fieldNames())
    return f"""
WITH site_attr AS (SELECT {site} FROM customer),
survey_pairs AS (SELECT o_custkey AS ID, {rates}, {dates} FROM orders GROUP BY o_custkey),
seen AS (SELECT o_custkey AS ID, concat(o_custkey, '_', l_linenumber % 2) AS PixelID,
  CAST(l_shipdate AS date) AS ImgDate, CAST(year(l_shipdate) AS int) AS Year,
  CAST(dayofyear(l_shipdate) AS int) AS DOY, {observed}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
raw AS (SELECT {columns} FROM seen JOIN site_attr USING (ID) JOIN survey_pairs USING (ID))"""


RAW_SQL = _sql()
