"""The macro series continued under a dip, priced for every market."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import day
from ..operators.cost import best_date, rent_paid, total_cost
from ..operators.envelope import lower_envelope
from ..operators.relational import market
from ..operators.reshape import append_rows
from ..operators.series import month_ends_after
from ..operators.trend import dip, fit_trends, months_since, trend_at
from .models import MARKET


@dataclass(frozen=True)
class Scenario:
    """Where trends start, how far they are continued, and the shape of the dip."""

    hpi_after: str = "2016-01-01"
    fmr_after: str = "2012-01-01"
    apr_after: str = "2013-01-01"
    start: str = "2018-01-01"
    periods: int = 120
    centre: int = 60
    fmr_factor: float = 8.0
    lease_start: str = "2018-01-31"


# The macro series, and the name of each one's line without a dip.
MACRO = ("apr", "hpi_sa", "fmr")
LINES = {"hpi_sa": "hpi_linear", "fmr": "fmr_linear"}


def macro_rows(*series: DataFrame) -> DataFrame:
    """Long table of the macro series: ``series, month_end, value``; one value column each."""
    parts = []
    for df in series:
        (name,) = [c for c in df.columns if c != "month_end"]
        parts.append(df.selectExpr(f"'{name}' AS series", "month_end", f"{name} AS value"))
    return reduce(DataFrame.unionByName, parts)


def _wide(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.groupBy("month_end").agg(
        F.count(F.lit(1)).alias("present"),
        *[F.expr(f"any_value(value) FILTER (WHERE series = '{s}') AS {c}") for s, c in names.items()],
    )


def shared_months(rows: DataFrame) -> DataFrame:
    """Months every macro series has a row for, one column per series."""
    wide = _wide(rows, {s: s for s in MACRO})
    return wide.filter(F.col("present") == len(MACRO)).drop("present")


def macro_trends(rows: DataFrame, scenario: Scenario) -> DataFrame:
    """Line of each macro series after its own cut-off, one row per series."""
    after = {"hpi_sa": scenario.hpi_after, "fmr": scenario.fmr_after, "apr": scenario.apr_after}
    recent = " OR ".join(f"(series = '{s}' AND month_end > DATE'{d}')" for s, d in after.items())
    return fit_trends(rows.filter(recent), "value", keys=["series"])


def project(trends: DataFrame, scenario: Scenario) -> DataFrame:
    """Every line on every projected month-end: ``series, month_end, value``."""
    spine = month_ends_after(trends.withColumn("start", day(scenario.start)), "start", scenario.periods)
    return spine.select("series", "month_end", trend_at().alias("value"))


def dip_column(scenario: Scenario, height: str | float):
    """Value of the dip at ``month_end``, in whole thirties of days from the first projected month."""
    x = months_since("month_end", f"last_day(DATE'{scenario.start}')")
    return dip(x, start=0, end=scenario.periods, centre=scenario.centre, height=height)


def future_macro(trends: DataFrame, scenario: Scenario, dips: Sequence[float]) -> DataFrame:
    """Projected series with each dip, and the lines without it alongside."""
    lines = _wide(project(trends, scenario), {"apr": "apr", **LINES}).drop("present")
    drop = dip_column(scenario, "-dip")
    return with_dips(lines, dips).withColumns(
        {
            "hpi_sa": F.col("hpi_linear") + drop,
            "fmr": F.col("fmr_linear") + drop * scenario.fmr_factor,
        }
    )


def with_dips(df: DataFrame, dips: Sequence[float]) -> DataFrame:
    """Repeat each row for each dip of the grid."""
    return df.withColumn("dip", F.explode(F.array(*[F.lit(float(d)) for d in dips])))


def history_plus_future(history: DataFrame, future: DataFrame, dips: Sequence[float]) -> DataFrame:
    """One frame per dip: observed months, then projected ones (lines are NULL in history)."""
    return append_rows(with_dips(history, dips), future)


def rents_until(scores: DataFrame, scenario: Scenario) -> DataFrame:
    """Rent paid by each month-end, for every dip and market."""
    return rent_paid(scores, scenario.lease_start, keys=["dip", *MARKET])


def choice_costs(
    prices: DataFrame, rents: DataFrame, *, buy: tuple[int, int], rent: tuple[int, int]
) -> DataFrame:
    """Cost of buying in one market while renting in another, per dip and month-end."""
    bought = prices.filter(market(*buy)).select("dip", "month_end", "y_hat")
    rented = rents.filter(market(*rent)).select("dip", "month_end", "rent_paid")
    return total_cost(bought, rented, on=["dip", "month_end"])


CHOICE = ["buy_code", "buy_rooms", "rent_code", "rent_rooms"]


def all_costs(prices: DataFrame, rents: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Cost after ``as_of`` of each market to buy in and market to rent in, per dip and month-end.

    Both sides are at most twelve markets per dip and month and meet on (dip, month).
    """
    later = F.col("month_end") > day(as_of)
    bought = prices.filter(later).select(
        "dip", "month_end", F.col("urban_code").alias("buy_code"), F.col("rooms").alias("buy_rooms"), "y_hat"
    )
    rented = rents.filter(later).select(
        "dip", "month_end", F.col("urban_code").alias("rent_code"), F.col("rooms").alias("rent_rooms"), "rent_paid"
    )
    return total_cost(bought, rented, on=["dip", "month_end"])


def scenario_grid(prices: DataFrame, rents: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Best date for every dip, market to buy in and market to rent in; combined before the shuffle."""
    return best_date(all_costs(prices, rents, as_of), as_of, by=["dip", *CHOICE])


def best_date_by_dip(prices: DataFrame, rents: DataFrame, as_of: dt.date | str, low: float, high: float) -> DataFrame:
    """Best date of every market to buy in and market to rent in, for every real dip from ``low`` to ``high``.

    ``prices`` and ``rents`` hold these two dips. Smoothing, lines, the dip and linear scores all are linear in the
    dip, and so is the rent paid: the cost of buying at a month-end is a line over the dip, and two of its values
    give it. The best date is the lowest line; work doesn't depend on how many dips are asked for.
    """
    at = lambda dip: F.max(F.when(F.col("dip") == float(dip), F.col("total_cost_kusd")))
    lines = all_costs(prices, rents, as_of).groupBy(*CHOICE, "month_end").agg(at(low).alias("at_low"), at(high).alias("at_high"))
    lines = lines.withColumn("slope", (F.col("at_high") - F.col("at_low")) / (float(high) - float(low)))
    found = lower_envelope(lines, keys=CHOICE, label="month_end", at_low="at_low", slope="slope", low=low, high=high)
    return found.withColumnRenamed("month_end", "best_date")
