"""Small tables and series for the tests."""

from __future__ import annotations

import calendar
import datetime as dt


def month_ends(start: str, periods: int) -> list[dt.date]:
    first = dt.date.fromisoformat(start)
    out = []
    for i in range(periods):
        y, m = divmod(first.year * 12 + first.month - 1 + i, 12)
        out.append(dt.date(y, m + 1, calendar.monthrange(y, m + 1)[1]))
    return out


def monthly(spark, values, start="2000-01-31", name="v"):
    """A series with one value per month; None is a missing value."""
    rows = list(zip(month_ends(start, len(values)), values))
    return spark.createDataFrame(rows, f"month_end date, {name} double")


def column(df, name, order="month_end"):
    return [r[name] for r in df.orderBy(order).collect()]
