"""Month-end arithmetic as column expressions.

Every series lives on a month-end grid. Steps by month are taken on whole months
and then moved to the last day: stepping a date such as the 28th of February by
months would stay on the 28th.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(value: dt.date | str | Column) -> Column:
    """A date literal from ``'YYYY-MM-DD'`` or ``datetime.date``; columns pass through."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = dt.date.fromisoformat(value)
    return F.lit(value)


def month_end(c: ColumnOrName) -> Column:
    """Last day of the month of a date or timestamp."""
    return F.last_day(_col(c).cast("date"))


def shift_month_ends(c: ColumnOrName, months: int | Column) -> Column:
    """Month-end ``months`` months away; 2019-02-28 plus 12 is 2020-02-29."""
    return F.last_day(F.add_months(_col(c), months))


def previous_month_end(c: ColumnOrName) -> Column:
    """Month-end before the month of ``c``, also when ``c`` is itself a month-end."""
    return shift_month_ends(c, -1)


def month_end_of(year: ColumnOrName, month: ColumnOrName) -> Column:
    """Month-end from a year and a month number."""
    return F.last_day(F.make_date(_col(year), _col(month), F.lit(1)))


def month_index(c: ColumnOrName) -> Column:
    """Months since year 0: neighbouring months differ by one."""
    return F.year(_col(c)) * 12 + F.month(_col(c)) - 1


def month_end_at(index: ColumnOrName) -> Column:
    """Inverse of ``month_index`` on the month-end grid."""
    i = _col(index)
    return month_end_of(F.floor(i / 12).cast("int"), (i % 12 + 1).cast("int"))


def epoch_days(c: ColumnOrName) -> Column:
    """Days since 1970-01-01, the regressor of the trend fits."""
    return F.unix_date(_col(c))


def from_year(c: ColumnOrName, year: int) -> Column:
    """``year(c) >= year`` as a date range, which the scan can use to skip data."""
    return _col(c) >= day(dt.date(year, 1, 1))


def before_year(c: ColumnOrName, year: int) -> Column:
    """``year(c) < year`` as a date range."""
    return _col(c) < day(dt.date(year, 1, 1))
