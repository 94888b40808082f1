"""Every query with SQL against DuckDB, and the pipelines end to end."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import oracle
from fieldpanel.ml import evaluate, models
from fieldpanel.plans import adapter, catalog, pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    error, rows, _ = oracle.compare(spark, con, entry_points.queries()[name], entry_points.oracle_sql()[name], SF)
    assert not error and rows > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1201


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", ["train_rows", "rest_rows"])
def test_sides_read_observations_once(spark, name):
    """The cutoff and the rows come from rows that are written once, not from the source tables twice."""
    files = entry_points.queries()[name](spark, SF).inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "orders" in f]


def test_rows_are_the_same_wherever_sites_are_joined(spark):
    plain, spread = adapter.raw_wide(spark, SF), adapter.raw_wide(spark, SF, together=False)
    assert plain.schema == spread.schema and plain.exceptAll(spread).isEmpty() and spread.exceptAll(plain).isEmpty()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_indices_are_computed_after_the_joins(spark):
    """What is moved to the sites are columns of the source tables, not the more numerous indices made of them."""
    for together in (True, False):
        plan = plan_of(adapter.raw_wide(spark, SF, together).select("ID", "NDVI", "Planted"))
        assert plan.index("AS NDVI") < plan.index("Join Inner")


def test_surveys_are_unpivoted_once(spark):
    """Records, and the surveys of a match, are read from where they were written, not made anew by each reader."""
    assert "Window" not in plan_of(catalog.features(spark, SF))
    records, _ = catalog.sequence_inputs(spark, SF)
    assert records.inputFiles() and not [f for f in records.inputFiles() if "lineitem" in f or "orders" in f]


def test_padded_joins_the_sources_once(spark, monkeypatch):
    """Batches and steps come from the same written records and observations."""
    made, whole = [], catalog.raw_wide
    monkeypatch.setattr(catalog, "raw_wide", lambda *a, **k: made.append(a) or whole(*a, **k))
    files = entry_points.queries()["padded"](spark, SF).inputFiles()
    assert len(made) == 1 and not [f for f in files if "lineitem" in f or "orders" in f]


def test_sequence_inputs_are_written(spark):
    """Statistics and histories don't join the sources anew."""
    for df in catalog.sequence_inputs(spark, SF):
        assert df.inputFiles() and not [f for f in df.inputFiles() if "lineitem" in f or "orders" in f]


def test_pipelines(spark, tmp_path):
    raw = str(tmp_path / "raw")
    adapter.raw_wide(spark, SF).write.parquet(raw)
    out = str(tmp_path / "out")
    pipeline.build_classical_data(spark, raw, out)
    features = spark.read.parquet(f"{out}/features")
    assert features.groupBy("threshold").count().agg(F.count_distinct("count"), F.max("count")).first()[:] == (1, 1201)
    assert features.select("ID", "side").distinct().groupBy("ID").count().filter("count > 1").count() == 0
    rows = features.filter("threshold = 70").drop("threshold", "side")
    predicted = evaluate.out_of_fold(models.build_random_forest(n_estimators=3, max_depth=2), rows, 2)
    pipeline.write_evaluation(predicted, out, "random_forest")
    roc = spark.read.option("header", True).csv(f"{out}/random_forest_roc_curve")
    assert roc.columns == ["threshold", "fpr", "tpr"] and roc.count() >= 3
    pipeline.build_sequence_data(spark, f"{out}/clean", out)
    sides = {s: spark.read.parquet(f"{out}/{s}_lookup") for s in ("train", "test", "valid")}
    counts = {s: df.count() for s, df in sides.items()}
    assert sum(counts.values()) == 934 and min(counts.values()) > 0
    assert sides["test"].join(sides["valid"], "ID").count() == 0
    assert spark.read.json(f"{out}/norm_stats").columns == ["mean", "std"]
