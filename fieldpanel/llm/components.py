"""Connected components of a stored list of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpanel.llm import common


def _least(links: DataFrame) -> DataFrame:
    """``u, least``: the least of a node and what it is linked to. Partial minima meet in the shuffle, never all links of a node."""
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least one."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), "u")
    return joined.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them; links run from larger to smaller nodes here."""
    joined = links.join(_least(links), "u")
    hung = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(joined.select("u", F.col("least").alias("v")))
    return hung.filter("u <> v")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has a link to another; ``root`` is the least node of its component.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round at most.
    The rounds end when the links no longer change; their number grows with the logarithm of the component size.
    Self links and repeated links are allowed, links with a null end are left out.
    """
    first = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    now, mark = common.stored(first.distinct()), None
    while True:
        now = common.stored(_small_star(_large_star(now)).distinct())
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
