import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fieldpanel.operators import split
from fieldpanel.operators.ordering import hash_rank


def panel(spark, sites=57, seed=1):
    """Sites of very different size; the first owns a third of the rows."""
    rng = random.Random(seed)
    rows = [(0, i) for i in range(300)] + [(rng.randrange(1, sites), i) for i in range(600)]
    rows += [(s, -1) for s in range(1, sites)]
    return spark.createDataFrame(rows, "ID long, v int")


def order(ids, seed):
    return sorted(ids, key=lambda i: hashlib.md5(f"{i}:{seed}".encode()).hexdigest())


@pytest.mark.parametrize("share", [0.7, 0.5, 0.01])
def test_split_takes_the_first_sites(spark, share):
    df = panel(spark)
    train, rest = split.group_split(df, 591, share)
    a, b = ({r.ID for r in side.select("ID").distinct().collect()} for side in (train, rest))
    assert not a & b and len(a | b) == 57
    assert a == set(order(range(57), 591)[: int(share * 57)])
    assert train.count() + rest.count() == df.count()
    assert sorted(split.group_split(df.repartition(7), 591, share)[0].collect()) == sorted(train.collect())


@pytest.mark.parametrize("share", [0, 1, -0.5, 2])
def test_share_is_checked(spark, share):
    with pytest.raises(ValueError):
        split.group_split(panel(spark), prop_train=share)


@pytest.mark.parametrize("folds", [2, 5, 10])
def test_folds(spark, folds):
    rows = split.group_folds(panel(spark), folds).select("ID", "fold").distinct().collect()
    assert len(rows) == 57
    sizes = [sum(r.fold == f for r in rows) for f in range(folds)]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    ranked = order(range(57), 591)
    fold_of = {r.ID: r.fold for r in rows}
    assert [fold_of[i] for i in ranked] == sorted(fold_of.values())


@pytest.mark.parametrize("folds", [2, 3, 7])
def test_balanced_folds_match_greedy(spark, folds):
    df = panel(spark, seed=folds)
    out = split.balanced_folds(df, folds)
    assert out.count() == df.count()
    rows = out.groupBy("ID", "fold").count().collect()
    assert len(rows) == 57
    loads = [0] * folds
    for n in sorted((r["count"] for r in rows), reverse=True):
        loads[loads.index(min(loads))] += n
    got = [sum(r["count"] for r in rows if r.fold == f) for f in range(folds)]
    assert got == loads
    with pytest.raises(ValueError):
        split.balanced_folds(df, 58)


def test_spread_is_greedy():
    rng = random.Random(2)
    for _ in range(300):
        folds = rng.randrange(1, 6)
        loads = [rng.randrange(0, 30) for _ in range(folds)]
        count, groups = rng.randrange(1, 9), rng.randrange(1, 40)
        want, now = [0] * folds, list(loads)
        for _ in range(groups):
            f = now.index(min(now))
            want[f] += 1
            now[f] += count
        assert split._spread(count, groups, loads) == want


def test_rank_within_groups(spark):
    df = spark.createDataFrame([(g, i) for g in "ab" for i in range(200)], "g string, k long")
    ranked = hash_rank(df, ["k"], 7, within=["g"], digits=1, total="n")
    for g in "ab":
        rows = ranked.filter(F.col("g") == g).orderBy("rank").collect()
        assert [r["rank"] for r in rows] == list(range(1, 201)) and {r.n for r in rows} == {200}
        assert [r.k for r in rows] == order(range(200), 7)


def test_split_does_not_move_the_table(spark):
    """The rows only meet one cutoff row; what is shuffled are distinct keys."""
    plan = split.mark_train(panel(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" in plan


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 2 + [(1,)] * 6, "target int")
    assert {r.target: r.weight for r in split.class_weights(df).collect()} == {0: 2.0, 1: pytest.approx(2 / 3)}
    assert split.add_class_weights(df).agg(F.sum("weight")).first()[0] == pytest.approx(8.0)


def test_fewer_keys_than_folds(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(12)], "ID long, v long")
    with pytest.raises(Exception, match="fewer keys than folds"):
        split.group_folds(df, 5).collect()
    assert split.group_folds(df, 3).select("ID", "fold").distinct().count() == 3
