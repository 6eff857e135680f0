"""Savitzky-Golay smoothing and discrete derivatives of ordered series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import number_array
from .series import series_order


def savgol_basis(window_length: int, poly_order: int) -> np.ndarray:
    """Orthonormal polynomials of orders 0..``poly_order`` at the window's points, one per column.

    Points are scaled to [-1, 1] before, which stays accurate for high orders.
    """
    if window_length < 1 or window_length % 2 == 0:
        raise ValueError(f"window_length must be odd and positive, not {window_length}")
    if not 0 <= poly_order < window_length:
        raise ValueError(f"poly_order must be in 0..{window_length - 1}, not {poly_order}")
    x = np.linspace(-1.0, 1.0, window_length)
    return np.linalg.qr(np.polynomial.legendre.legvander(x, poly_order))[0]


def savgol_weights(window_length: int, poly_order: int) -> np.ndarray:
    """Fitted values as weights of the window's values: row r predicts point r.

    The matrix projects onto polynomials of ``poly_order``. Its middle row smooths the
    interior; the other rows evaluate the first or last window's polynomial at the ends.
    """
    basis = savgol_basis(window_length, poly_order)
    return basis @ basis.T


def savgol_grid(
    df: DataFrame,
    column: str,
    windows: Sequence[int],
    orders: Sequence[int],
    *,
    keys: Sequence[str] = (),
    order_by: str = "month_end",
) -> DataFrame:
    """``column`` smoothed with every window length and polynomial order, in one pass: ``keys``, ``order_by``,
    ``window_length``, ``poly_order`` and ``<column>_savgol``.

    A fit of order p is the sum of the first p + 1 orthogonal polynomials, each times its product with the
    window's values. So all orders of a window share one set of products, summed in a hash aggregate keyed by window
    and start; the polynomials are a table with a row per window and point, which meets the values by these keys. Each
    start then gives the outputs that it is the window of: its middle, and at the ends of the series its first or last
    half too. NULL where a window holds a NULL, or the series is shorter than the window. Orders that a window has
    too few points for are an error.
    """
    spark, top = df.sparkSession, max(orders)
    names = [f"b{k}" for k in range(top + 1)]
    rows = [(w, j, *map(float, b)) for w in sorted(set(windows)) for j, b in enumerate(savgol_basis(w, top))]
    basis = spark.createDataFrame(rows, "w int, j int, " + ", ".join(f"{b} double" for b in names))
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    numbered = df.selectExpr(
        *keys,
        order_by,
        column,
        f"cast(row_number() OVER ({series_order(keys, order_by)}) - 1 AS int) AS pos",
        f"cast(count(1) OVER ({part}) AS int) AS n",
    )
    lengths = f"array({', '.join(map(str, sorted(set(windows))))})"
    opened = numbered.selectExpr("*", f"explode({lengths}) AS w")
    # Each value takes part in the windows that hold it.
    fitting = opened.filter("w <= n").selectExpr(
        *keys, column, "pos", "n", "w", "explode(sequence(greatest(0, pos - w + 1), least(pos, n - w))) AS start"
    )
    products = (
        fitting.selectExpr(*keys, column, "n", "w", "start", "pos - start AS j")
        .join(basis, ["w", "j"])
        .groupBy(*keys, "n", "w", "start")
        .agg(F.count(column).alias("known"), *[F.expr(f"sum({b} * {column}) AS c{k}") for k, b in enumerate(names)])
    )
    # The middle; the first window also the points before it, the last one those after it.
    points = products.selectExpr(
        "*",
        "explode(sequence(CASE WHEN start = 0 THEN 0 ELSE w div 2 END, CASE WHEN start = n - w THEN w - 1 ELSE w div 2 END)) AS j",
    ).join(basis, ["w", "j"])
    terms = ["c0 * b0"]
    for k in range(1, top + 1):
        terms.append(f"{terms[-1]} + c{k} * b{k}")
    each = ", ".join(f"struct({p} AS poly_order, CASE WHEN known = w THEN {terms[p]} END AS {column}_savgol)" for p in orders)
    smooth = points.selectExpr(*keys, "cast(start + j AS int) AS pos", "w AS window_length", f"inline(array({each}))")
    none = ", ".join(f"struct({p} AS poly_order, cast(NULL AS double) AS {column}_savgol)" for p in orders)
    short = opened.filter("w > n").selectExpr(*keys, "pos", "w AS window_length", f"inline(array({none}))")
    dated = numbered.select(*keys, "pos", order_by)
    return smooth.unionByName(short).join(dated, [*keys, "pos"]).drop("pos")


def savgol(
    df: DataFrame,
    columns: Sequence[str],
    window_length: int,
    poly_order: int,
    *,
    keys: Sequence[str] = (),
    order_by: str = "month_end",
    short_flag: str | None = None,
) -> DataFrame:
    """Replace each column ``c`` by ``c_savgol``.

    Each row adds its weighted value to the outputs whose window holds it, and one
    grouped sum collects them: no self-join, and since rows are already partitioned by
    series the sum needs no further shuffle. A NULL blanks every window that holds it.
    Series shorter than the window get NULL, and True in ``short_flag`` if it is named.
    """
    w, half = window_length, window_length // 2
    weights = number_array(savgol_weights(w, poly_order).ravel())
    carried = [c for c in df.columns if c not in {*keys, *columns}]
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""

    # Outputs a row takes part in: those whose window holds it; short series only themselves.
    first = f"CASE WHEN __n < {w} THEN __pos WHEN __pos < {w} THEN 0 ELSE __pos - {half} END"
    last = f"CASE WHEN __n < {w} THEN __pos WHEN __pos >= __n - {w} THEN __n - 1 ELSE __pos + {half} END"
    start = f"greatest(0, least(__out - {half}, __n - {w}))"
    scattered = (
        df.selectExpr(
            "*",
            f"row_number() OVER ({series_order(keys, order_by)}) - 1 AS __pos",
            f"cast(count(1) OVER ({part}) AS int) AS __n",
        )
        .selectExpr("*", f"explode(sequence({first}, {last})) AS __out")
        .withColumn("__weight", F.get(weights, F.expr(f"(__out - {start}) * {w} + __pos - {start}")))
    )
    own = "CASE WHEN __out = __pos THEN {} END"
    flag = [F.expr(f"max(__n) < {w} AS {short_flag}")] if short_flag else []
    smoothed = scattered.groupBy(*keys, "__out").agg(
        *[F.expr(f"first({own.format(c)}, true) AS {c}") for c in carried],
        *[
            F.expr(f"CASE WHEN count({c}) = {w} THEN sum(__weight * {c}) END AS {c}_savgol")
            for c in columns
        ],
        *flag,
    )
    return smoothed.drop("__out")


def gradient(
    df: DataFrame,
    column: str,
    order: int,
    *,
    keys: Sequence[str] = (),
    order_by: str = "month_end",
) -> DataFrame:
    """Add ``<column>_div_1`` .. ``_div_<order>``, each the derivative of the one before.

    Central differences inside, one-sided at both ends. The end rows are found by their
    place in the series, not by a missing neighbour value.
    """
    over = f"OVER ({series_order(keys, order_by)})"
    source = column
    for d in range(1, order + 1):
        name = f"{column}_div_{d}"
        df = df.selectExpr(
            "*",
            f"CASE WHEN lag(1) {over} IS NULL THEN lead({source}) {over} - {source} "
            f"WHEN lead(1) {over} IS NULL THEN {source} - lag({source}) {over} "
            f"ELSE (lead({source}) {over} - lag({source}) {over}) / 2 END AS {name}",
        )
        source = name
    return df
