"""Calendar operators on monthly series.

A series is identified by ``keys`` and has at most one row per month once it has been
resampled, so a window over one series holds no more rows than the calendar has months,
however large the source is. The facts behind a series are reduced by a grouped
aggregate (combined before the shuffle) first, and only then ordered. With no keys the
whole table is one such series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_end, shift_month_ends

# A month as a whole number, and the month-end of such a number in column ``__at``.
_MONTH = "year(month_end) * 12 + month(month_end) - 1"
_MONTH_END = "last_day(make_date(__at div 12, cast(__at % 12 AS int) + 1, 1)) AS month_end"
# Every month from a row's own up to the one before the next row's.
_OPEN = "explode(sequence(__own, coalesce(__next - 1, __own))) AS __at"


def series_order(keys: Sequence[str], order_by: str = "month_end") -> str:
    """Window specification of one series in time order, without its frame."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"{part}ORDER BY {order_by}"


def fill_month_gaps(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Add a row with NULL measures for each month missing between two present ones.

    Each row opens the months up to the next row, so no calendar table has to be
    built and joined and the input is read once.
    """
    measures = [c for c in df.columns if c not in {*keys, "month_end"}]
    order = series_order(keys)
    return (
        df.selectExpr(*keys, *measures, f"{_MONTH} AS __own", f"lead({_MONTH}) OVER ({order}) AS __next")
        .selectExpr(*keys, *measures, "__own", _OPEN)
        .selectExpr(*keys, _MONTH_END, *[f"CASE WHEN __at = __own THEN {c} END AS {c}" for c in measures])
    )


def resample_monthly(
    df: DataFrame, date: str, values: Sequence[str], *, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean per calendar month labelled by its last day; empty months stay, as NULL."""
    monthly = df.groupBy(*keys, month_end(date).alias("month_end")).agg(
        *[F.avg(v).alias(v) for v in values]
    )
    return fill_month_gaps(monthly, keys=keys)


def interpolate_monthly(
    df: DataFrame, value: str, *, keys: Sequence[str] = ()
) -> DataFrame:
    """Spread sparse points over every month from the first row of a series to its last.

    Months between two known values are linear in their position. Months before the
    first known value stay NULL; months after the last repeat it.
    """
    order = series_order(keys)
    point = f"CASE WHEN {value} IS NOT NULL THEN struct({_MONTH} AS m, {value} AS v) END"
    return (
        df.selectExpr(
            *keys,
            f"{_MONTH} AS __own",
            f"lead({_MONTH}) OVER ({order}) AS __next",
            f"last({point}, true) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __a",
            f"first({point}, true) OVER ({order} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS __b",
        )
        .selectExpr(*keys, "__a", "__b", _OPEN)
        .selectExpr(
            *keys,
            _MONTH_END,
            f"CASE WHEN __b IS NULL THEN __a.v "
            f"ELSE __a.v + (__b.v - __a.v) / (__b.m - __a.m) * (__at - __a.m) END AS {value}",
        )
    )


def every_nth(df: DataFrame, n: int, *, keys: Sequence[str] = ()) -> DataFrame:
    """Every ``n``-th row of each series, starting with its first."""
    return (
        df.selectExpr("*", f"row_number() OVER ({series_order(keys)}) AS __row")
        .filter((F.col("__row") - 1) % n == 0)
        .drop("__row")
    )


def month_ends_after(df: DataFrame, start: str, periods: int, name: str = "month_end") -> DataFrame:
    """For each row, ``periods`` month-ends beginning with the month of column ``start``."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("__step")
    return (
        df.select("*", steps)
        .withColumn(name, shift_month_ends(F.trunc(start, "MM"), F.col("__step")))
        .drop("__step")
    )
