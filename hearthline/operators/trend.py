"""Linear trends per series, their continuation, and the dip laid over them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import epoch_days


def fit_trends(df: DataFrame, value: str, *, keys: Sequence[str], date: str = "month_end") -> DataFrame:
    """Least-squares line of ``value`` on the day number, one row per series."""
    x = epoch_days(date).cast("double")
    return df.groupBy(*keys).agg(
        F.regr_slope(F.col(value), x).alias("slope"),
        F.regr_intercept(F.col(value), x).alias("intercept"),
        F.count(value).alias("points"),
    )


def trend_at(date: str = "month_end") -> Column:
    """Value of a fitted line at a date."""
    return F.col("intercept") + F.col("slope") * epoch_days(date)


def clamped_spline_pieces(x: Sequence[float], y: Sequence[float]) -> list[np.ndarray]:
    """Cubic through the knots with zero slope at both ends, as coefficients per interval.

    Coefficients are in ascending powers of the distance from the interval's left knot.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    if np.any(np.diff(x) <= 0):
        raise ValueError("knots must increase")
    h, steepness = np.diff(x), np.diff(y) / np.diff(x)
    # Equal curvature on both sides of each inner knot; the slope is zero at the outer ones.
    system, right = np.eye(len(x)), np.zeros(len(x))
    for i in range(1, len(x) - 1):
        system[i, i - 1 : i + 2] = 1 / h[i - 1], 2 / h[i - 1] + 2 / h[i], 1 / h[i]
        right[i] = 3 * (steepness[i - 1] / h[i - 1] + steepness[i] / h[i])
    slope = np.linalg.solve(system, right)
    return [
        np.array(
            [
                y[i],
                slope[i],
                (3 * steepness[i] - 2 * slope[i] - slope[i + 1]) / h[i],
                (slope[i] + slope[i + 1] - 2 * steepness[i]) / h[i] ** 2,
            ]
        )
        for i in range(len(h))
    ]


def dip(x: str, *, start: float, end: float, centre: float, height: str | float) -> Column:
    """Dip of ``height`` at ``centre`` that leaves zero at ``start`` and returns at ``end``.

    ``x`` and ``height`` are SQL expressions. The curve is flat within one step of either end.
    Beyond the last knot its last piece goes on. It is linear in ``height``, so the pieces are
    solved once, for height one.
    """
    knots = [float(k) for k in (start, start + 1, centre, end - 1, end)]

    def piece(knot: float, coefficients: np.ndarray) -> str:
        u = f"({x} - {knot!r}D)"
        value = f"{float(coefficients[3])!r}D"
        for c in coefficients[2::-1]:
            value = f"({value} * {u} + {float(c)!r}D)"
        return value

    pieces = [piece(k, c) for k, c in zip(knots, clamped_spline_pieces(knots, [0, 0, 1, 0, 0]))]
    branches = " ".join(f"WHEN {x} < {k!r}D THEN {p}" for k, p in zip(knots[1:], pieces[:-1]))
    return F.expr(f"({height}) * CASE {branches} ELSE {pieces[-1]} END")


def months_since(date: str, first: str) -> str:
    """Elapsed months as whole thirties of days, halves to even; SQL in and out."""
    return f"bround(datediff({date}, {first}) / 30)"
