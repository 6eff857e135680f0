import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import trend
from hearthline.operators.series import month_ends_after
from hearthline.plans import scenario as sc
from helpers import column, month_ends, monthly


def dip_at(spark, xs, height=-85.0):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    curve = trend.dip("x", start=0, end=120, centre=60, height=height)
    return [r.y for r in df.select(curve.alias("y")).collect()]


def test_trend_equals_least_squares(spark):
    values = np.random.default_rng(5).normal(size=40).cumsum()
    df = monthly(spark, values.tolist()).withColumn("series", F.lit("s"))
    fit = trend.fit_trends(df, "v", keys=["series"]).first()
    days = [(d - dt.date(1970, 1, 1)).days for d in month_ends("2000-01-31", 40)]
    slope, intercept = np.polyfit(days, values, 1)
    assert fit.slope == pytest.approx(slope, rel=1e-9)
    assert fit.intercept == pytest.approx(intercept, rel=1e-9)
    assert fit.points == 40


def test_known_values_of_the_dip(spark):
    assert dip_at(spark, [0, 1, 119, 120]) == pytest.approx([0, 0, 0, 0], abs=1e-9)
    assert dip_at(spark, [60, 30, 0.5, 121]) == pytest.approx([-85, -41.689645, 0.004502, 0.072034], abs=1e-6)


def test_dip_is_smooth_at_its_knots(spark):
    eps = 1e-4
    for knot in (1, 60, 119):
        left, here, right = dip_at(spark, [knot - eps, knot, knot + eps])
        assert (here - left) / eps == pytest.approx((right - here) / eps, abs=1e-3)
        assert left == pytest.approx(here, abs=1e-2)


def test_spline_passes_through_its_knots_with_flat_ends():
    x, y = [0, 2, 3, 7, 11], [1, -2, 5, 0, 4]
    pieces = trend.clamped_spline_pieces(x, y)
    for i, p in enumerate(pieces):
        h = x[i + 1] - x[i]
        assert np.polyval(p[::-1], 0) == pytest.approx(y[i])
        assert np.polyval(p[::-1], h) == pytest.approx(y[i + 1])
    d = [np.polyder(p[::-1]) for p in pieces]
    c = [np.polyder(p[::-1], 2) for p in pieces]
    assert np.polyval(d[0], 0) == pytest.approx(0) and np.polyval(d[-1], 4) == pytest.approx(0)
    for i in range(3):
        h = x[i + 1] - x[i]
        assert np.polyval(d[i], h) == pytest.approx(np.polyval(d[i + 1], 0))
        assert np.polyval(c[i], h) == pytest.approx(np.polyval(c[i + 1], 0))


def test_knots_must_increase():
    with pytest.raises(ValueError):
        trend.clamped_spline_pieces([0, 1, 1], [0, 0, 0])


def test_months_since_reach_121_and_repeat(spark):
    """Ten years of month-ends, rounded in thirties of days, skip some numbers and repeat others."""
    start = spark.createDataFrame([(dt.date(2018, 1, 1),)], "start date")
    months = month_ends_after(start, "start", 120)
    x = column(months.withColumn("x", F.expr(trend.months_since("month_end", "DATE'2018-01-31'"))), "x")
    days = [(d - dt.date(2018, 1, 31)).days for d in month_ends("2018-01-31", 120)]
    assert x == [float(round(d / 30)) for d in days]
    assert max(x) == 121 and len(set(x)) < 120
    assert sum((d / 30) % 1 == 0.5 for d in days) == 6


def macro(spark, scenario):
    rows = sc.macro_rows(
        *[monthly(spark, [b + s * i for i in range(60)], "1996-01-31", n) for n, b, s in
          (("apr", 0.05, 1e-4), ("hpi_sa", 200.0, 1.0), ("fmr", 900.0, 5.0))]
    )
    return rows, sc.macro_trends(rows, scenario)


SCENARIO = sc.Scenario(
    hpi_after="1996-01-01", fmr_after="1997-01-01", apr_after="1996-01-01",
    start="2001-01-01", lease_start="2001-01-31",
)


def test_no_dip_equals_the_lines(spark):
    _, trends = macro(spark, SCENARIO)
    future = sc.future_macro(trends, SCENARIO, [0]).collect()
    assert len(future) == 120
    assert all(r.hpi_sa == r.hpi_linear and r.fmr == r.fmr_linear for r in future)


def test_dip_hits_hpi_once_and_rents_eightfold_and_not_the_rate(spark):
    _, trends = macro(spark, SCENARIO)
    future = sc.future_macro(trends, SCENARIO, [0, 85]).orderBy("month_end", "dip").collect()
    for flat, dipped in zip(future[::2], future[1::2]):
        assert (flat.dip, dipped.dip) == (0.0, 85.0)
        assert dipped.apr == flat.apr
        assert dipped.fmr - flat.fmr == pytest.approx(8 * (dipped.hpi_sa - flat.hpi_sa), abs=1e-9)
    assert min(b.hpi_sa - a.hpi_sa for a, b in zip(future[::2], future[1::2])) == pytest.approx(-85, abs=0.2)


def test_cut_offs_apply_per_series(spark):
    _, trends = macro(spark, SCENARIO)
    assert {r.series: r.points for r in trends.collect()} == {"apr": 60, "hpi_sa": 60, "fmr": 48}


def test_history_has_no_lines_and_only_shared_months(spark):
    rows, trends = macro(spark, SCENARIO)
    rows = rows.filter("NOT (series = 'fmr' AND month_end = DATE'1996-03-31')")
    frame = sc.history_plus_future(sc.shared_months(rows), sc.future_macro(trends, SCENARIO, [85]), [85])
    history = frame.filter("month_end < DATE'2001-01-01'").collect()
    assert len(history) == 59 and all(r.hpi_linear is None for r in history)
    assert frame.count() == 59 + 120
