"""Rent paid until each date, cost of buying then, and the cheapest date."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import day


def rent_paid(
    rates: DataFrame, start: dt.date | str, *, keys: Sequence[str], rate: str = "y_hat"
) -> DataFrame:
    """Add ``rent_paid``: rent from ``start`` until each month-end of each market.

    A lease is renewed every twelve month-ends at that month's rate. A lease year of more than
    365 days by the target date costs twelve months, a shorter one its days over thirty. So
    every year but the last has been paid in full, and a running total over the renewals does
    it without looking the rates up again. NULL where a renewal has no rate; zero up to ``start``.
    """
    start = dt.date.fromisoformat(start) if isinstance(start, str) else start
    if start.day != calendar.monthrange(start.year, start.month)[1]:
        raise ValueError(f"the lease must start on a month-end, not {start}")
    first = f"DATE'{start}'"
    renewal = f"month_end >= {first} AND month(month_end) = {start.month}"
    earlier = (
        f"OVER (PARTITION BY {', '.join(keys)} ORDER BY month_end "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    months_in = f"(year(month_end) - {start.year}) * 12 + month(month_end) - {start.month}"
    return (
        rates.selectExpr(
            "*",
            f"sum(CASE WHEN {renewal} THEN {rate} END) {earlier} AS __total",
            f"count(CASE WHEN {renewal} THEN {rate} END) {earlier} AS __known",
            f"last(CASE WHEN {renewal} THEN struct(month_end AS since, {rate} AS rate) END, true) "
            f"{earlier} AS __last",
        )
        .selectExpr("*", "datediff(month_end, __last.since) AS __days")
        .selectExpr(
            *rates.columns,
            f"""CASE WHEN month_end <= {first} THEN 0D
                     WHEN __known = ceil(({months_in}) / 12) THEN
                       (__total - __last.rate) * 12
                       + __last.rate * CASE WHEN __days > 365 THEN 12D ELSE __days / 30 END
                END AS rent_paid""",
        )
    )


def total_cost(prices: DataFrame, rents: DataFrame, *, on: Sequence[str] = ("month_end",)) -> DataFrame:
    """Price in thousands plus rent paid in thousands, at each date both sides have.

    Filter each side to its market first, or give the two market keys different names.
    """
    return (
        prices.withColumnRenamed("y_hat", "price_kusd")
        .join(rents, list(on))
        .withColumn("rent_kusd", F.col("rent_paid") / 1000)
        .drop("rent_paid")
        .withColumn("total_cost_kusd", F.col("price_kusd") + F.col("rent_kusd"))
    )


def best_date(costs: DataFrame, as_of: dt.date | str, *, by: Sequence[str] = ()) -> DataFrame:
    """Cheapest month-end after ``as_of``; the earlier one if costs are equal.

    Dates without a cost are left out. Nothing left gives no row.
    """
    cost = F.col("total_cost_kusd")
    return (
        costs.filter(cost.isNotNull() & (F.col("month_end") > day(as_of)))
        .groupBy(*by)
        .agg(
            F.min_by("month_end", F.struct(cost, "month_end")).alias("best_date"),
            F.min(cost).alias("total_cost_kusd"),
        )
        .filter(F.col("best_date").isNotNull())
    )
