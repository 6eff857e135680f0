"""Lowest lines against trying every line at many places, and against the grid of dips."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hearthline.operators.envelope import lower_envelope, on_grid
from hearthline.plans import catalogue

SF = "/root/testdata/sf0.01"


def envelope(spark, lines, low=0.0, high=10.0):
    df = spark.createDataFrame(lines, "g string, name int, a double, b double")
    return lower_envelope(df, keys=["g"], label="name", at_low="a", slope="b", low=low, high=high)


def stretches(df):
    return [(r["name"], r["low"], r["high"]) for r in df.orderBy("g", "low").collect()]


@pytest.mark.parametrize("seed", range(6))
def test_every_place_has_its_lowest_line(spark, seed):
    deal = random.Random(seed)
    whole = seed % 2  # whole numbers make parallel, equal and concurrent lines
    draw = (lambda: float(deal.randrange(-4, 5))) if whole else (lambda: deal.uniform(-5, 5))
    lines = [(g, n, draw() + 20, draw()) for g in "xyz" for n in range(deal.choice([1, 2, 30]))]
    rows = envelope(spark, lines, -3.0, 7.0).collect()
    for g in "xyz":
        own = sorted((r for r in rows if r["g"] == g), key=lambda r: r["low"])
        assert own[0]["low"] == -3 and own[-1]["high"] == 7
        assert all(a["high"] == b["low"] and a["low"] < a["high"] for a, b in zip(own, own[1:]))
        for r in own:
            for t in (0.0, 0.3, 0.5, 1.0):
                x = r["low"] + t * (r["high"] - r["low"])
                best = min(a + b * (x + 3) for k, _, a, b in lines if k == g)
                assert r["value_low"] + t * (r["value_high"] - r["value_low"]) == pytest.approx(best, abs=1e-9)


def test_equal_lines_count_once_and_the_first_by_name(spark):
    lines = [("g", 3, 1.0, 1.0), ("g", 2, 1.0, 1.0), ("g", 4, 2.0, 1.0), ("g", 5, 4.0, 0.0)]
    assert stretches(envelope(spark, lines)) == [(2, 0.0, 3.0), (5, 3.0, 10.0)]


def test_missing_lines_and_groups(spark):
    lines = [("g", 1, None, 1.0), ("g", 2, 1.0, None), ("g", 3, float("nan"), 0.0), ("h", 1, None, None), ("i", 7, 1.0, 0.0)]
    assert stretches(envelope(spark, lines)) == [(7, 0.0, 10.0)]
    assert envelope(spark, [("g", 1, 1.0, 1.0)]).where("false").count() == 0
    with pytest.raises(ValueError):
        envelope(spark, lines, 1.0, 1.0)


def test_lines_that_meet_in_one_point_and_at_the_ends(spark):
    through = [("g", n, 5.0 + 4 * (2 - n), float(n - 2)) for n in range(5)]  # all meet at 4
    assert stretches(envelope(spark, through)) == [(4, 0.0, 4.0), (0, 4.0, 10.0)]
    assert stretches(envelope(spark, [("g", 1, 0.0, 0.0), ("g", 2, 10.0, -1.0)])) == [(1, 0.0, 10.0)]


def test_whole_places_of_stretches(spark):
    rows = on_grid(envelope(spark, [("g", 1, 0.0, 1.0), ("g", 2, 2.5, 0.0)]), "x", first=0, last=10, value="cost").orderBy("x").collect()
    assert [(r["x"], r["name"], r["cost"]) for r in rows] == [(float(x), 1 if x <= 2 else 2, min(float(x), 2.5)) for x in range(11)]


def test_best_dates_agree_with_every_dip_of_the_grid(spark):
    """Two frames against one frame per dip: the same date and cost in all 131 x 144 choices."""
    grid = catalogue.run("scenario_grid", spark, SF)
    lines = on_grid(catalogue.run("best_date_by_dip", spark, SF), "dip", first=0, last=130, value="by_line")
    choice = ["buy_code", "buy_rooms", "rent_code", "rent_rooms", "dip"]
    both = grid.join(lines.withColumnRenamed("best_date", "line_date"), choice, "full")
    found = both.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("best_date") == F.col("line_date")).alias("same"),
        F.max(F.abs(F.col("by_line") - F.col("total_cost_kusd"))).alias("apart"),
    ).first()
    assert found["n"] == 131 * 144 == grid.count()
    assert found["same"] == found["n"] and found["apart"] < 1e-4


def test_work_does_not_depend_on_the_dips(spark):
    """The envelope scores two dips, whatever the range."""
    inputs = catalogue.Inputs(spark, SF)
    outlook = inputs.outlook(0, 130)
    few, many = (outlook.prices.select("dip").distinct().count(), len(catalogue.DIP_GRID))
    assert few == 2 and many == 131
    found = inputs.market.best_date_by_dip(outlook, dt.date(2001, 8, 31), low=0, high=130)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
