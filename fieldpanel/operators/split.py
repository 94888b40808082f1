"""Splits and folds by group, without leakage between the sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpanel.operators.ordering import hash_cutoffs, hash_order, hash_rank, with_cutoffs
from fieldpanel.sources.io import materialise


def mark_train(df: DataFrame, seed: int = 591, prop_train: float = 0.7, key: str = "ID") -> DataFrame:
    """Add ``is_train``: true for the rows of exactly ``int(prop_train * n)`` of the n distinct keys."""
    if not 0 < prop_train < 1:
        raise ValueError(f"the training share must lie inside (0, 1), got {prop_train}")

    def wanted(total: Column) -> Column:
        return F.array(F.floor(F.lit(float(prop_train)) * total))

    marked = with_cutoffs(df, hash_cutoffs(df, key, seed, wanted))
    last = F.try_element_at("_cutoffs", F.lit(1))
    return marked.withColumn("is_train", F.coalesce(hash_order([key], seed) <= last, F.lit(False))).drop("_cutoffs")


def group_split(
    df: DataFrame, seed: int = 591, prop_train: float = 0.7, key: str = "ID"
) -> tuple[DataFrame, DataFrame]:
    """(train, rest): every key is wholly on one side."""
    marked = mark_train(df, seed, prop_train, key)
    return marked.filter("is_train").drop("is_train"), marked.filter("NOT is_train").drop("is_train")


def group_folds(df: DataFrame, folds: int = 5, seed: int = 591, key: str = "ID", fold: str = "fold") -> DataFrame:
    """Add a fold number 0..folds-1; keys are shuffled and fold sizes differ by at most one key."""
    if folds < 2:
        raise ValueError("at least two folds are required")

    def wanted(total: Column) -> Column:
        base, extra = F.floor(total / folds), total % folds
        return F.array(*[i * base + F.least(F.lit(i), extra) for i in range(1, folds)])

    cutoffs = hash_cutoffs(df, key, seed, wanted)
    # The cutoff row is checked where it is attached, so no job runs while the plan is built.
    enough = F.size("_cutoffs") == folds - 1
    marked = with_cutoffs(df, cutoffs.withColumn("_cutoffs", F.when(enough & (F.size(F.array_distinct("_cutoffs")) == folds - 1), F.col("_cutoffs")).otherwise(F.raise_error(F.lit("fewer keys than folds")))))
    value = hash_order([key], seed)
    passed = F.size(F.filter("_cutoffs", lambda c: c < value))
    return marked.withColumn(fold, passed.cast("int")).drop("_cutoffs")


def _spread(count: int, groups: int, loads: list[int]) -> list[int]:
    """How many of ``groups`` equal groups each fold gets when the lightest fold always takes the next one."""
    folds = len(loads)
    low, high = min(loads), max(loads) + count * groups + 1
    while low < high:  # highest level that at most `groups` placements stay below
        middle = (low + high + 1) // 2
        if sum(max(0, -(-(middle - load) // count)) for load in loads) <= groups:
            low = middle
        else:
            high = middle - 1
    taken = [max(0, -(-(low - load) // count)) for load in loads]
    left = groups - sum(taken)
    for f in sorted(range(folds), key=lambda f: (loads[f] + count * taken[f], f))[:left]:
        taken[f] += 1
    return taken


def balanced_folds(df: DataFrame, folds: int = 5, seed: int = 591, key: str = "ID", fold: str = "fold") -> DataFrame:
    """Add a fold number; larger keys first, each to the fold with the fewest rows so far.

    The assignment depends only on how many keys have each row count, so the driver sees that histogram (the
    number of distinct row counts, below the square root of twice the rows) and never the keys. Which key of
    equal size goes where follows the seeded order.
    """
    spark = df.sparkSession
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    histogram = sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("_groups")).collect()
    if sum(r["_groups"] for r in histogram) < folds:
        raise ValueError("fewer keys than folds")
    loads = [0] * folds
    spans = []
    for row in sorted(histogram, key=lambda r: -r["_size"]):
        start = 1
        for f, n in enumerate(_spread(row["_size"], row["_groups"], loads)):
            loads[f] += n * row["_size"]
            if n:
                spans.append((row["_size"], f, start, start + n - 1))
            start += n
    plan = spark.createDataFrame(spans, f"_size long, {fold} int, _from long, _to long")
    ranked = hash_rank(sizes, [key], seed, within=["_size"], rank="_rank")
    # The plan has a line per size and fold at most; Spark broadcasts it if it is small.
    placed = ranked.join(plan, "_size", "inner").filter(F.col("_rank").between(F.col("_from"), F.col("_to")))
    # One line per key, stored: Spark knows its size, so it is broadcast only if small, and rows are not moved then.
    return df.join(materialise(placed.select(key, fold)), key, "inner")


def class_weights(df: DataFrame, label: str = "target", weight: str = "weight") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_classes"))
    return counts.crossJoin(F.broadcast(whole)).select(
        label, "n", (F.col("_rows") / (F.col("_classes") * F.col("n"))).alias(weight)
    )


def add_class_weights(df: DataFrame, label: str = "target", weight: str = "weight") -> DataFrame:
    """Rows with their class weight; the two class sums come from one aggregation."""
    totals = df.agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("_n0"), F.count(F.when(F.col(label) == 1, 1)).alias("_n1")
    )
    rows = F.col("_n0") + F.col("_n1")
    classes = (F.col("_n0") > 0).cast("int") + (F.col("_n1") > 0).cast("int")
    own = F.when(F.col(label) == 0, F.col("_n0")).when(F.col(label) == 1, F.col("_n1"))
    return df.crossJoin(F.broadcast(totals)).withColumn(weight, F.try_divide(rows, classes * own)).drop("_n0", "_n1")
