import numpy as np
import pytest

from hearthline.operators import smoothing
from hearthline.operators.smoothing import gradient, savgol, savgol_weights
from helpers import column, monthly


def by_polynomials(values, window, order):
    """Fit a polynomial to each window; the ends use the first and the last window."""
    n, half = len(values), window // 2
    out = []
    for i in range(n):
        s = max(0, min(i - half, n - window))
        x = np.linspace(-1, 1, window)
        fit = np.polynomial.Polynomial.fit(x, values[s : s + window], order)
        out.append(fit(x[i - s]))
    return np.array(out)


def test_interior_weights_of_the_cubic_window():
    expected = np.array([-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36]) / 429
    assert np.allclose(savgol_weights(11, 3)[5], expected, atol=1e-14)


@pytest.mark.parametrize("window, order", [(10, 3), (11, 11), (0, 0), (11, -1)])
def test_bad_parameters_fail_when_the_plan_is_built(spark, window, order):
    with pytest.raises(ValueError):
        savgol(monthly(spark, [1.0] * 12), ["v"], window, order)


@pytest.mark.parametrize("n", [11, 12, 17, 40])
def test_a_cubic_is_reproduced_ends_included(spark, n):
    x = np.arange(n, dtype=float)
    cubic = 2 + 3 * x - 0.5 * x**2 + 0.01 * x**3
    out = column(savgol(monthly(spark, cubic.tolist()), ["v"], 11, 3), "v_savgol")
    assert np.allclose(out, cubic, rtol=1e-11)


@pytest.mark.parametrize("window, order, n", [(11, 3, 30), (11, 10, 30), (21, 1, 25), (101, 10, 130)])
def test_equals_a_fit_per_window(spark, window, order, n):
    values = np.random.default_rng(7).normal(size=n)
    out = column(savgol(monthly(spark, values.tolist()), ["v"], window, order), "v_savgol")
    assert np.allclose(out, by_polynomials(values, window, order), atol=1e-8)


def test_one_missing_value_blanks_every_window_that_holds_it(spark):
    values = [float(i) for i in range(40)]
    values[15] = None
    out = column(savgol(monthly(spark, values), ["v"], 11, 3), "v_savgol")
    assert [i for i, v in enumerate(out) if v is None] == list(range(10, 21))


def test_short_series_are_null_and_flagged_and_others_are_not(spark):
    rows = [("long", r.month_end, r.v) for r in monthly(spark, [1.0] * 12).collect()]
    rows += [("short", d, 1.0) for _, d, _ in rows[:10]]
    df = spark.createDataFrame(rows, "k string, month_end date, v double")
    out = savgol(df, ["v"], 11, 3, keys=["k"], short_flag="too_short").collect()
    assert len(out) == 22
    assert all(r.too_short and r.v_savgol is None for r in out if r.k == "short")
    assert all(not r.too_short and r.v_savgol == pytest.approx(1) for r in out if r.k == "long")


def test_rows_are_counted_not_months(spark):
    """A series with a missing month is smoothed as if its rows were neighbours."""
    values = np.random.default_rng(1).normal(size=20)
    gapped = monthly(spark, values.tolist()).filter("month_end <> DATE'2000-06-30'")
    out = column(savgol(gapped, ["v"], 11, 3), "v_savgol")
    assert np.allclose(out, by_polynomials(np.delete(values, 5), 11, 3), atol=1e-12)


def test_other_columns_are_carried_and_the_source_is_dropped(spark):
    df = monthly(spark, [float(i) for i in range(12)]).selectExpr("*", "v * 2 AS w", "'x' AS tag")
    out = savgol(df, ["v"], 11, 3)
    assert sorted(out.columns) == ["month_end", "tag", "v_savgol", "w"]
    assert column(out, "w") == [2.0 * i for i in range(12)]


def test_gradient_of_squares(spark):
    out = gradient(monthly(spark, [1.0, 4.0, 9.0, 16.0]), "v", 1)
    assert column(out, "v_div_1") == [3.0, 4.0, 6.0, 7.0]


def test_repeated_gradient_equals_numpy(spark):
    values = np.random.default_rng(3).normal(size=15)
    out = gradient(monthly(spark, values.tolist()), "v", 3)
    expected = values
    for d in (1, 2, 3):
        expected = np.gradient(expected)
        assert np.allclose(column(out, f"v_div_{d}"), expected, atol=1e-14)


def test_gradient_takes_its_ends_by_place_not_by_missing_neighbours(spark):
    values = [1.0, 2.0, None, 5.0, 7.0]
    out = column(gradient(monthly(spark, values), "v", 1), "v_div_1")
    expected = np.gradient(np.array([1.0, 2.0, np.nan, 5.0, 7.0]))
    assert out == [None if np.isnan(x) else x for x in expected]


def test_gradient_of_a_line_is_constant(spark):
    assert column(gradient(monthly(spark, [3.0 * i for i in range(9)]), "v", 1), "v_div_1") == [3.0] * 9


def by_least_squares(values, window, order):
    """Each output from a fit to its own window."""
    n, half, out = len(values), window // 2, []
    if n < window:
        return [None] * n
    for i in range(n):
        start = max(0, min(i - half, n - window))
        own = values[start : start + window]
        if any(v is None for v in own):
            out.append(None)
            continue
        x = (np.arange(window) - half) / half
        out.append(float(np.polynomial.Chebyshev.fit(x, own, order)((i - start - half) / half)))
    return out


def test_grid_equals_least_squares_in_each_window(spark):
    random = np.random.default_rng(4)
    values = [float(v) for v in random.normal(size=40).cumsum()]
    windows, orders = (11, 13, 21, 39, 41), (1, 2, 5, 10)
    df = smoothing.savgol_grid(monthly(spark, values), "v", windows, orders)
    rows = {(r["window_length"], r["poly_order"], r["month_end"]): r["v_savgol"] for r in df.collect()}
    assert len(rows) == len(windows) * len(orders) * 40
    dates = [r["month_end"] for r in monthly(spark, values).orderBy("month_end").collect()]
    for w in windows:
        for p in orders:
            wanted = by_least_squares(values, w, p)
            assert [rows[w, p, d] for d in dates] == [v if v is None else pytest.approx(v, abs=1e-8) for v in wanted]


def test_grid_keeps_series_apart_and_blanks_windows_with_gaps(spark):
    values = [float(i * i % 17) for i in range(30)]
    holed = [None if i == 8 else v for i, v in enumerate(values)]
    series = monthly(spark, values).selectExpr("'a' AS s", "*").union(monthly(spark, holed).selectExpr("'b' AS s", "*"))
    series = series.union(monthly(spark, values[:5]).selectExpr("'c' AS s", "*"))
    df = smoothing.savgol_grid(series, "v", [11], [3], keys=["s"])
    rows = {s: [r["v_savgol"] for r in df.where(f"s = '{s}'").orderBy("month_end").collect()] for s in "abc"}
    assert rows["a"] == [pytest.approx(v, abs=1e-9) for v in by_least_squares(values, 11, 3)]
    assert rows["b"] == [v if v is None else pytest.approx(v, abs=1e-9) for v in by_least_squares(holed, 11, 3)]
    assert rows["c"] == [None] * 5 and None in rows["b"] and rows["b"][-1] is not None


def test_grid_equals_the_single_smoother(spark):
    values = [float((i * 7) % 11) for i in range(25)]
    one = smoothing.savgol(monthly(spark, values), ["v"], 11, 3).orderBy("month_end").collect()
    grid = smoothing.savgol_grid(monthly(spark, values), "v", [11, 13], [1, 3]).where("window_length = 11 AND poly_order = 3").orderBy("month_end").collect()
    assert [r["v_savgol"] for r in grid] == [pytest.approx(r["v_savgol"], abs=1e-10) for r in one]


def test_grid_reads_its_series_once(spark):
    df = smoothing.savgol_grid(monthly(spark, [1.0] * 20), "v", range(11, 102, 2), range(1, 11))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Union") == 1 and "CartesianProduct" not in text
