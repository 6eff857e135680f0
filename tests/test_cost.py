import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthline.operators import cost
from hearthline.plans import scenario as sc
from helpers import month_ends

D = dt.date
START = D(2018, 1, 31)


def rates(spark, values, start="2017-06-30", market=(1, 1)):
    rows = [(*market, d, v) for d, v in zip(month_ends(start, len(values)), values)]
    return spark.createDataFrame(rows, "urban_code int, rooms int, month_end date, y_hat double")


def paid(df, start=START):
    out = cost.rent_paid(df, start, keys=["urban_code", "rooms"])
    return {r.month_end: r.rent_paid for r in out.collect()}


def by_loop(by_date, t):
    """Rent paid until t, year by year, as the definition reads."""
    total, at = 0.0, START
    while at < t:
        days = (t - at).days
        total += by_date[at] * (12 if days > 365 else days / 30)
        at = month_ends(at.replace(day=1).isoformat(), 13)[-1]
    return total


def test_constant_rent_charges_365_days_by_the_day_and_366_as_a_year(spark):
    got = paid(rates(spark, [1000.0] * 60))
    assert got[D(2017, 6, 30)] == 0 and got[START] == 0
    assert got[D(2019, 1, 31)] == pytest.approx(365 / 30 * 1000)
    assert got[D(2020, 1, 31)] - 12000 == pytest.approx(365 / 30 * 1000)
    assert got[D(2021, 1, 31)] - 24000 == pytest.approx(12000)


def test_running_total_equals_the_loop(spark):
    values = [1000.0 + 7 * i - (i % 5) * 31 for i in range(139)]
    df = rates(spark, values)
    by_date = {r.month_end: r.y_hat for r in df.collect()}
    got = paid(df)
    assert len(got) == 139
    for t, v in got.items():
        assert v == pytest.approx(by_loop(by_date, t), abs=1e-6)


def test_markets_do_not_mix(spark):
    both = rates(spark, [1000.0] * 30).union(rates(spark, [500.0] * 30, market=(2, 3)))
    out = cost.rent_paid(both, START, keys=["urban_code", "rooms"])
    at = {r.urban_code: r.rent_paid for r in out.filter(F.col("month_end") == D(2018, 12, 31)).collect()}
    assert at[1] == pytest.approx(2 * at[2])


@pytest.mark.parametrize("drop", [True, False])
def test_a_renewal_without_a_rate_leaves_no_total_from_then_on(spark, drop):
    df = rates(spark, [1000.0] * 60)
    missing = F.col("month_end") == D(2019, 1, 31)
    df = df.filter(~missing) if drop else df.withColumn("y_hat", F.when(~missing, F.col("y_hat")))
    got = paid(df)
    assert got[D(2018, 12, 31)] is not None
    assert got[D(2019, 2, 28)] is None and got[D(2021, 6, 30)] is None


def test_lease_must_start_on_a_month_end(spark):
    with pytest.raises(ValueError):
        cost.rent_paid(rates(spark, [1.0]), D(2018, 1, 30), keys=["urban_code", "rooms"])


def costs(spark, values, start="2020-01-31"):
    rows = list(zip(month_ends(start, len(values)), values))
    return spark.createDataFrame(rows, "month_end date, total_cost_kusd double")


def test_best_date_is_the_cheapest_after_the_day_and_skips_missing(spark):
    df = costs(spark, [1.0, 5.0, None, 4.0, 6.0])
    (r,) = cost.best_date(df, "2020-01-31").collect()
    assert (r.best_date, r.total_cost_kusd) == (D(2020, 4, 30), 4.0)


def test_equal_costs_go_to_the_earlier_date(spark):
    (r,) = cost.best_date(costs(spark, [3.0, 2.0, 2.0, 2.0]).repartition(4), "2019-12-31").collect()
    assert r.best_date == D(2020, 2, 29)


def test_nothing_after_the_day_gives_no_row(spark):
    assert cost.best_date(costs(spark, [1.0, 2.0]), "2020-02-29").collect() == []


def test_missing_part_leaves_the_sum_missing(spark):
    prices = costs(spark, [100.0, None]).withColumnRenamed("total_cost_kusd", "y_hat")
    rents = costs(spark, [2000.0, 3000.0]).withColumnRenamed("total_cost_kusd", "rent_paid")
    got = cost.total_cost(prices, rents).orderBy("month_end").collect()
    assert got[0].total_cost_kusd == 102.0 and got[0].rent_kusd == 2.0
    assert got[1].total_cost_kusd is None


def test_grid_equals_one_choice_at_a_time(spark):
    months = month_ends("2018-01-31", 48)
    rows = [
        (float(dip), u, r, d, 100.0 * u + 40 * r - abs(i - 17 - 3 * u) * (dip + 1) * 0.1, 900.0 + 100 * r + i)
        for dip in (0, 65) for u in (1, 2) for r in (1, 2) for i, d in enumerate(months)
    ]
    schema = "dip double, urban_code int, rooms int, month_end date, y_hat double, rate double"
    prices = spark.createDataFrame(rows, schema).drop("rate")
    scores = spark.createDataFrame(rows, schema).drop("y_hat").withColumnRenamed("rate", "y_hat")
    rents = sc.rents_until(scores, sc.Scenario())
    grid = {tuple(r)[:5]: (r.best_date, r.total_cost_kusd) for r in sc.scenario_grid(prices, rents, "2018-06-30").collect()}
    assert len(grid) == 2 * 4 * 4
    for buy, rent in (((1, 1), (2, 2)), ((2, 1), (1, 1))):
        chosen = sc.choice_costs(prices, rents, buy=buy, rent=rent)
        for r in cost.best_date(chosen, "2018-06-30", by=["dip"]).collect():
            assert grid[(r.dip, *buy, *rent)] == (r.best_date, pytest.approx(r.total_cost_kusd))
