import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthline.functions import calendar as cal
from hearthline.functions.numbers import fixed
from hearthline.operators.trend import months_since

D = dt.date


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("given", [D(2018, 10, 1), D(2018, 10, 31)])
def test_previous_month_end_from_any_day(spark, given):
    assert one(spark, cal.previous_month_end(F.lit(given))) == D(2018, 9, 30)


def test_twelve_month_ends_reach_the_leap_day(spark):
    assert one(spark, cal.shift_month_ends(F.lit(D(2019, 2, 28)), 12)) == D(2020, 2, 29)


def test_month_end_from_parts_and_from_a_timestamp(spark):
    assert one(spark, cal.month_end_of(F.lit(2020), F.lit(2))) == D(2020, 2, 29)
    assert one(spark, cal.month_end(F.lit(dt.datetime(2001, 4, 30, 23, 59)))) == D(2001, 4, 30)


@pytest.mark.parametrize("d", [D(1999, 12, 31), D(2000, 1, 31), D(2000, 2, 29), D(2015, 6, 30)])
def test_month_index_round_trip(spark, d):
    assert one(spark, cal.month_end_at(cal.month_index(F.lit(d)))) == d


def test_month_index_steps_by_one_over_a_year_end(spark):
    a, b = (one(spark, cal.month_index(F.lit(d))) for d in (D(1999, 12, 31), D(2000, 1, 31)))
    assert b - a == 1


def test_year_bounds_are_date_ranges(spark):
    days = spark.createDataFrame([(D(2010, 12, 31),), (D(2011, 1, 1),), (D(2011, 12, 31),), (D(2012, 1, 1),)], "d date")
    kept = days.filter(cal.from_year("d", 2011) & cal.before_year("d", 2012)).collect()
    assert [r.d for r in kept] == [D(2011, 1, 1), D(2011, 12, 31)]


def test_epoch_days(spark):
    assert one(spark, cal.epoch_days(F.lit(D(1970, 1, 11)))) == 10


@pytest.mark.parametrize("days, months", [(75, 2.0), (105, 4.0), (74, 2.0), (76, 3.0), (-75, -2.0)])
def test_half_months_round_to_even(spark, days, months):
    first = "DATE'2018-01-31'"
    assert one(spark, F.expr(months_since(f"date_add({first}, {days})", first))) == months


def test_report_rounding_has_no_negative_zero(spark):
    df = spark.createDataFrame([(-1e-17,), (2.00125,), (None,)], "x double").select(fixed("x", 4))
    values = [r.x for r in df.collect()]
    assert str(values[0]) == "0.0" and values[1] == 2.0013 and values[2] is None
