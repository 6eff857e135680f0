"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing_as_null(c: Column) -> Column:
    """NaN to NULL, so that ``avg`` and ``count`` skip it."""
    return F.when(~F.isnan(c), c)


def exact(column: str) -> str:
    """SQL of an amount as a decimal: the shortest number that reads as the same double, to eight places.

    Sums of decimals are exact, so results do not depend on the order in which tasks finish. What is
    not a number becomes NULL, and so does an amount of 1e20 or more.
    """
    return f"try_cast({column} AS decimal(28, 8))"


def fixed(column: str, digits: int) -> Column:
    """Report rounding to ``digits`` decimals, under the same name.

    The offset sits just above one half: averages of few two-decimal amounts often end
    on an exact half, and the last bit of a sum must not decide its direction. NaN stays NaN, and
    numbers so large that a double has no such decimals stay as they are.
    """
    rounded = f"floor(`{column}` * 1e{digits} + 0.5001D) / 1e{digits}"
    return F.expr(f"CASE WHEN abs(`{column}`) < 1e{15 - digits} THEN {rounded} ELSE `{column}` END AS `{column}`")


def number_array(values) -> Column:
    """A constant array of doubles; ``repr`` keeps every bit of each number.

    Spark folds the expression to one literal when it plans the query.
    """
    return F.split(F.lit(" ".join(repr(float(v)) for v in values)), " ").cast("array<double>")
