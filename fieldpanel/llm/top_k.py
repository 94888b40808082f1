"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are dealt into shards. A shard keeps, for every dimension, the list of its vectors sorted by that component.
A query goes down all lists at once, from the end that its own component favours, and scores every vector that it
meets. The components at the current depth bound the score of all vectors not met yet; once that bound lies below the
k-th best score found so far, no vector of the shard is missing and the shard is left. The k-th best score of a first
shard bounds the search in the others from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpanel.llm import common

#: Vectors per shard, about; a task holds one shard, and queries pass by it in a stream. Queries per block, about: a shard
#: with more queries goes to several tasks, one for each block.
SHARD, BLOCK = 8192, 1 << 16
#: Queries that a task answers before it hands the results on.
ASKED_ROWS = 256
#: Entries of each list that are read between two looks at the bound, at first; the step doubles while the bound holds.
STEP = 16


def whole_numbers(vector: Column, factor: int = 1024) -> Column:
    """``floor(factor * x)`` of every component as a double; null if a component is null or not finite."""
    values = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(values, lambda x: F.floor(x * factor)))


class Lists:
    """The vectors of a shard by row and id, and per dimension their numbers in the order of the component."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((rows, ids, *vectors.T[::-1]))
        rows, ids, vectors = rows[order], ids[order], vectors[order]
        first = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)])
        # Of equal vectors, the first k + 1 by id are enough: one of them may be the query itself.
        nth = np.arange(len(ids)) - np.nonzero(first)[0][np.cumsum(first) - 1]
        few = nth <= k
        self.rows, self.ids, self.vectors = rows[few], ids[few], vectors[few]
        self.sorted = np.argsort(self.vectors, axis=0, kind="stable").T

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """``ids, scores`` of the best ``k`` by score, then least id, without the row ``own``; vectors below ``floor`` may be left out."""
        n, dims = self.vectors.shape
        used = np.nonzero(query)[0]
        if not len(used):
            best = np.argsort(self.ids)[: k + 1]
            best = best[self.rows[best] != own][:k]
            return self.ids[best], np.zeros(len(best), np.int64)
        up, down = used[query[used] > 0], used[query[used] < 0]
        met = np.zeros(n, bool)
        depth, step, best, scores = 0, STEP, np.empty(0, np.int64), np.empty(0, np.int64)
        while depth < n:
            to, before = min(n, depth + step), met.copy()
            met[self.sorted[up, n - to : n - depth]] = True
            met[self.sorted[down, depth:to]] = True
            new = np.nonzero(met & ~before)[0]
            new = new[self.rows[new] != own]
            best, scores = np.concatenate([best, new]), np.concatenate([scores, self.vectors[new] @ query])
            order = np.lexsort((self.ids[best], -scores))[:k]
            best, scores = best[order], scores[order]
            depth, step = to, step * 2
            bound = int(query[up] @ self.vectors[self.sorted[up, n - to], up] + query[down] @ self.vectors[self.sorted[down, to - 1], down])
            # Vectors not met score the bound at most. An equal score could still win by its id.
            if bound < max(floor, scores[-1] if len(scores) == k else -math.inf):
                break
        return self.ids[best], scores


def search(vectors: DataFrame, asked: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of each row for which ``asked`` holds; ties to smaller ids.

    The table holds ids and arrays of whole numbers. Every row is a candidate of every query but of its own, so repeated ids
    are several candidates, and several queries with ranks of their own. Rows with a null id or vector, or a null in it, take
    no part. Vectors of different lengths have no inner product: each length is searched by itself.
    Every query meets every shard once, in a stream; that is the exact search asked for, and no pair of rows is emitted.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    wanted = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    wanted = wanted.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
    # Numbers that tell rows apart, fixed by writing them.
    whole = common.stored(wanted.withColumn("row", F.monotonically_increasing_id()))
    sizes = whole.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("q")).filter("dims > 0 and q > 0").collect()
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for dims, size, queries in sorted(sizes):
        part = _search_length(whole.filter(F.size("vector") == dims), dims, size, queries, k)
        found = part if len(sizes) == 1 else found.unionByName(part)
    return found


def _search_length(whole: DataFrame, dims: int, size: int, queries: int, k: int) -> DataFrame:
    shards, blocks = math.ceil(size / SHARD), math.ceil(queries / BLOCK)
    spread = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("int")
    each_block = F.sequence(F.lit(0), F.lit(blocks - 1))
    none = F.lit(None).cast("long")
    there = whole.select(spread(shards, 2).alias("shard"), F.explode(each_block).alias("block"), F.lit(0).alias("kind"), "row", "id", "vector", none.alias("floor"))
    here = whole.filter("asked").select("row", "id", "vector", spread(blocks, 1).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of a shard come first and make its lists; its queries follow."""
        at, held, lists = None, [], None
        for batch in common.slices(batches, ASKED_ROWS):
            shard, block, kind, row, ids, floors = (batch.column(c).to_pylist() for c in ("shard", "block", "kind", "row", "id", "floor"))
            values = batch.column("vector").flatten().to_numpy().reshape(-1, dims)
            found: list[tuple] = []
            for n in range(batch.num_rows):
                if (shard[n], block[n]) != at:
                    at, held, lists = (shard[n], block[n]), [], None
                if not kind[n]:
                    held.append((row[n], ids[n], values[n].copy()))
                    continue
                if lists is None:
                    lists = Lists(np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64), np.stack([h[2] for h in held]), k) if held else ()
                    held = []
                if lists:
                    best, scores = lists.search(values[n], row[n], k, -math.inf if floors[n] is None else floors[n])
                    found += zip([row[n]] * len(best), [ids[n]] * len(best), best.tolist(), scores.tolist(), strict=True)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query", "query_id", "vec_id", "score"])

    def meet(asked: DataFrame, each: Column) -> DataFrame:
        """Search the shards that ``each`` names for every query."""
        met = there.unionByName(asked.select(F.explode(each).alias("shard"), "block", F.lit(1).alias("kind"), "row", "id", "vector", "floor"))
        return met.repartition("shard", "block").sortWithinPartitions("shard", "block", "kind").mapInArrow(run, "query long, query_id long, vec_id long, score long")

    own = F.array(F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(shards)).cast("int"))
    first = common.stored(meet(here.withColumn("floor", none), own))
    bounds = first.groupBy("query").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == k)
    bounded = here.join(bounds.select(F.col("query").alias("row"), "floor"), "row", "left")
    rest = meet(bounded, F.array_except(F.sequence(F.lit(0), F.lit(shards - 1)), own))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
