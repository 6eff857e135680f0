"""Every query against its SQL, and the shape of every plan."""

import pytest

import __spark_entry__ as contract
import compare
from hearthline.plans import catalogue
from hearthline.checks.sql import ORACLES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(catalogue.QUERIES) <= set(contract.queries())
    assert ORACLES.items() <= contract.oracle_sql().items()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.run(name, spark, SF)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    spark_columns, ours = compare.spark_rows(df)
    sql_columns, theirs = compare.oracle_rows(duck, name)
    assert spark_columns == sql_columns
    assert len(ours) == len(theirs) > 0
    assert compare.differences(ours, theirs) == []


@pytest.mark.parametrize("name", ["monthly_rate", "price_features", "savgol_smooth", "gradient_2", "stride_12"])
def test_series_with_natural_gaps_equal_their_sql(spark, name):
    """At the smallest scale places have months without an order."""
    small = "/root/testdata/sf0.001"
    _, ours = compare.spark_rows(catalogue.run(name, spark, small))
    _, theirs = compare.oracle_rows(compare.connect(small), name)
    assert len(ours) == len(theirs) > 0 and compare.differences(ours, theirs) == []


def test_building_a_query_runs_nothing(spark):
    tracker = spark.sparkContext.statusTracker()
    lazy = set(catalogue.QUERIES) - catalogue.STORED
    for name in lazy:
        catalogue.run(name, spark, SF)  # reads the tables' footers, which is no job of the group
    spark.sparkContext.setJobGroup("building", "")
    try:
        for name in lazy:
            catalogue.run(name, spark, SF)
        jobs = tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    schemas = len(lazy) * 4  # Spark may read a Parquet footer with a job of one task
    assert all(sum(tracker.getStageInfo(s).numTasks for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)) <= 1 for j in jobs)
    assert len(jobs) <= schemas


def formatted(spark, df) -> str:
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_scans_read_only_the_columns_used(spark):
    text = formatted(spark, catalogue.run("monthly_rate", spark, SF))
    assert "ReadSchema: struct<l_discount:double,l_shipdate:timestamp_ntz>" in text
    text = formatted(spark, catalogue.run("index_series", spark, SF))
    assert "lineitem" not in text
    assert "struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text


def test_first_panel_year_reaches_the_order_scan(spark):
    text = formatted(spark, catalogue.run("filter_year", spark, SF))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00" in text


@pytest.mark.parametrize("name", ["monthly_rate", "index_series", "filter_year"])
def test_facts_are_combined_before_they_are_shuffled(spark, name):
    """Reading a plan bottom up: each fact scan meets a partial aggregate before an exchange by its group."""
    lines = plan(catalogue.run(name, spark, SF)).splitlines()
    finals = [i for i, line in enumerate(lines) if "HashAggregate(" in line and "partial_" not in line]
    for i in finals:
        below = lines[i + 1 :]
        exchange = next(j for j, line in enumerate(below) if "Exchange hashpartitioning" in line)
        assert "functions=[partial_" in below[exchange + 1]


def test_entry_runs(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) > 70 and set(rows[0].asDict()) == {"month_end", "apr"}



def test_stored_panels_skip_the_folders_of_other_years(spark):
    text = formatted(spark, catalogue.run("stored_panel_since", spark, SF))
    assert "PartitionFilters: [isnotnull(year" in text and ">= 1999)" in text
    df = catalogue.run("stored_panel_years", spark, SF)
    assert "dynamicpruning" in formatted(spark, df).lower()
    read = df.collect()
    assert 0 < len({r["Date"].year for r in read}) < 7


def test_a_stored_model_is_found_in_its_own_folder(spark, tmp_path):
    from hearthline.plans.models import PRICE
    from hearthline.plans.store import ModelStore

    model = catalogue.Inputs(spark, SF).market.price_model
    store = ModelStore(spark, str(tmp_path / "models"), PRICE.columns)
    fitted = model.fit_all().cache()
    store.write(fitted, 1)
    store.write(fitted.withColumn("r2", fitted.r2 + 1), 2)
    names = [c for c in fitted.columns if c != "fold_r2"]
    assert sorted(map(str, store.read(1).select(names).collect())) == sorted(map(str, fitted.select(names).collect()))
    one = store.model(2, 2, 4)
    assert "PartitionFilters: [isnotnull(version" in formatted(spark, one) and "urban_code" in formatted(spark, one).split("PartitionFilters")[1]
    old = fitted.where("urban_code = 2 AND rooms = 4").first()
    assert [r["r2"] for r in one.collect()] == [old["r2"] + 1]
    assert store.model(1, 9, 9).count() == 0
    with pytest.raises(Exception, match="exist"):
        store.write(fitted, 1)
