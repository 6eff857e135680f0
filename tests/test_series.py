import datetime as dt

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hearthline.operators import series
from helpers import column, month_ends, monthly

D = dt.date


def test_months_without_rows_stay_as_missing(spark):
    weekly = spark.createDataFrame(
        [(D(2000, 1, 3), 1.0), (D(2000, 1, 31), 3.0), (D(2000, 4, 10), 5.0), (D(2000, 4, 11), None)],
        "d date, v double",
    )
    out = series.resample_monthly(weekly, "d", ["v"])
    assert column(out, "month_end") == month_ends("2000-01-31", 4)
    assert column(out, "v") == [2.0, None, None, 5.0]


def test_gaps_are_filled_per_series(spark):
    df = spark.createDataFrame(
        [("a", D(2000, 1, 31), 1.0), ("a", D(2000, 3, 31), 2.0), ("b", D(2001, 1, 31), 3.0)],
        "k string, month_end date, v double",
    )
    out = series.fill_month_gaps(df, keys=["k"]).orderBy("k", "month_end").collect()
    assert [(r.k, r.v) for r in out] == [("a", 1.0), ("a", None), ("a", 2.0), ("b", 3.0)]


@pytest.mark.parametrize(
    "known, expected",
    [
        ([1, None, None, 4, None], [1, 2, 3, 4, 4]),
        ([None, 1, None, 3, None], [None, 1, 2, 3, 3]),
        ([1, None, None, 4, None, None, None, 0, None], [1, 2, 3, 4, 3, 2, 1, 0, 0]),
        ([None, None], [None, None]),
        ([7], [7]),
    ],
)
def test_interpolation_by_position(spark, known, expected):
    df = monthly(spark, [None if v is None else float(v) for v in known])
    assert column(series.interpolate_monthly(df, "v"), "v") == expected


def test_absent_months_are_opened_between_points(spark):
    df = spark.createDataFrame(
        [(1, D(1999, 9, 30), 10.0), (1, D(2000, 9, 30), 22.0), (2, D(2000, 9, 30), 5.0)],
        "code int, month_end date, v double",
    )
    out = series.interpolate_monthly(df, "v", keys=["code"])
    assert column(out.filter("code = 1"), "v") == [10.0 + i for i in range(13)]
    assert column(out.filter("code = 2"), "v") == [5.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=2, max_size=25))
def test_interpolation_equals_pandas(spark, values):
    values = [None if v is None else float(v) for v in values]
    ours = column(series.interpolate_monthly(monthly(spark, values), "v"), "v")
    theirs = pd.Series(values, dtype=float).interpolate(method="linear")
    assert [None if pd.isna(x) else pytest.approx(x) for x in theirs] == ours


def test_every_nth_row_counts_rows_not_months(spark):
    df = monthly(spark, [float(i) for i in range(30)]).filter("month_end <> DATE'2000-05-31'")
    assert column(series.every_nth(df, 12), "v") == [0.0, 13.0, 25.0]


def test_month_ends_after_a_short_month(spark):
    start = spark.createDataFrame([(D(2018, 2, 28),)], "start date")
    out = series.month_ends_after(start, "start", 14)
    assert column(out, "month_end") == month_ends("2018-02-28", 14)
