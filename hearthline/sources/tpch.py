"""The source tables derived from a TPC-H style star schema.

Orders stand in for listings: nations are counties, the order priority's first digit is the
bedroom count (5 is left out of every measure), order totals are prices and the price per
unit of an order's lines is its rent. Discounts are the weekly mortgage rate.

The facts are reduced to *cells* (nation and month) in one pass, with exact sums, and every order-based source is read off the cells.
"""

from __future__ import annotations

import datetime as dt
import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import month_end
from ..functions.numbers import exact, missing_as_null
from ..operators.relational import ROOMS
from .buckets import BucketStore

# Nations without rents, so that the eligibility test has something to drop.
NATIONS_WITHOUT_RENT = (6, 20)

# Columns the sources use, so that opening a table needs no look at its files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_quantity double, l_extendedprice double, l_discount double, "
        "l_shipdate timestamp_ntz"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


LINE_SUMS = "l_orderkey bigint, amount decimal(38, 8), quantity double"


def line_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and quantity of each order's lines, in the columns of ``LINE_SUMS``."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.expr(f"sum({exact('l_extendedprice')}) AS amount"),
            F.sum(missing_as_null(F.col("l_quantity"))).alias("quantity"),
        )
    )


def unit_prices(sums: DataFrame) -> DataFrame:
    """Price per unit of each order."""
    return sums.select("l_orderkey", F.expr("try_divide(cast(amount AS double), quantity) AS unit_price"))


def store_facts(spark: SparkSession, sf_dir: str, path: str, rows_per_bucket: int = 10_000_000) -> BucketStore:
    """Orders and the sums of their lines, both dealt to buckets by order once; cells read off them shuffle neither."""
    orders = table(spark, sf_dir, "orders")
    buckets = max(8, math.ceil(orders.count() / rows_per_bucket))
    store = BucketStore(spark, path, buckets, {"orders": SCHEMAS["orders"], "line_sums": LINE_SUMS})
    store.write("orders", orders, "o_orderkey")
    store.write("line_sums", line_sums(spark, sf_dir), "l_orderkey")
    return store


def order_cells(
    spark: SparkSession, sf_dir: str, *, rents: bool = True, since: dt.date | None = None, stored: BucketStore | None = None
) -> DataFrame:
    """Priced orders and their totals per nation and month: of all, and for each room count.

    Orders are combined per customer, month and priority before they meet the customer table, so
    a customer with a large share of all orders is a few rows by then. Lines are combined per
    order. ``since`` is a filter the order scan can use to skip data. ``stored``: facts of ``store_facts``.
    """
    orders = stored.read("orders", "o_orderkey") if stored else table(spark, sf_dir, "orders")
    if since is not None:
        orders = orders.filter(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz"))
    price = exact("o_totalprice")
    sums = {"orders": f"count({price})", "amount": f"sum({price})"}
    if rents:
        lines = stored.read("line_sums", "l_orderkey") if stored else line_sums(spark, sf_dir)
        orders = orders.join(unit_prices(lines), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        sums |= {"rents": "count(unit_price)", "rent_total": "sum(unit_price)"}
    by_customer = orders.groupBy(
        "o_custkey",
        month_end("o_orderdate").alias("month_end"),
        F.expr("try_cast(substring(o_orderpriority, 1, 1) AS int)").alias("rooms"),
    ).agg(*[F.expr(f"{total} AS {name}") for name, total in sums.items()])
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    per_room = [
        F.expr(f"sum({c}) FILTER (WHERE rooms = {r}) AS {c}_{r}") for c in sums for r in ROOMS
    ]
    return (
        by_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("nation"), "month_end")
        .agg(F.sum("orders").alias("orders"), F.sum("amount").alias("amount"), *per_room)
    )


def rate_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mortgage rate in percent, one row per week."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("DATE"))
        .agg(
            F.expr(f"try_divide(cast(sum({exact('l_discount')}) AS double) * 100, count({exact('l_discount')})) AS MORTGAGE30US")
        )
    )


def county_panel(cells: DataFrame) -> DataFrame:
    """Wide panel: one row per month-end and region, eight measures; empty cells are NULL."""
    unrented = ", ".join(str(n) for n in NATIONS_WITHOUT_RENT)
    return cells.selectExpr(
        "month_end AS Date",
        "nation AS RegionName",
        *[f"try_divide(cast(amount_{r} AS double), orders_{r}) AS MedianListingPrice_{r}Bedroom" for r in ROOMS],
        *[
            f"CASE WHEN nation NOT IN ({unrented}) THEN try_divide(rent_total_{r}, rents_{r}) END "
            f"AS MedianRentalPrice_{r}Bedroom"
            for r in ROOMS
        ],
    )


def county_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code table under its original column names."""
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS `FIPS code`",
        "n_nationkey % 4 + 1 AS `2013 code`",
        "CASE WHEN n_regionkey < 3 THEN 'AA' ELSE 'BB' END AS `State Abr.`",
        "n_name AS `County name`",
    )


def price_index(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    """Index per place and period: monthly and quarterly rows, and a second flavour."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("r_name").alias("place_name")
    )
    kinds = """inline(array(
        struct('monthly' AS frequency, 'purchase-only' AS hpi_flavor, month(month_end) AS period),
        struct('quarterly' AS frequency, 'purchase-only' AS hpi_flavor, quarter(month_end) AS period),
        struct('monthly' AS frequency, 'all-transactions' AS hpi_flavor, month(month_end) AS period)))"""
    return (
        cells.join(places, F.col("nation") == F.col("n_nationkey"))
        .selectExpr(
            "place_name", "'traditional' AS hpi_type", "year(month_end) AS yr", "orders", "amount", kinds
        )
        .groupBy("hpi_type", "hpi_flavor", "frequency", "place_name", "yr", "period")
        .agg(
            F.expr("try_divide(cast(sum(amount) AS double), sum(orders)) / 1000 AS index_sa"),
            F.expr("cast(sum(amount) AS double) / 1000000 AS index_nsa"),
        )
    )


def fair_rent(cells: DataFrame) -> DataFrame:
    """Fair rent per year, dated 1 October, and county."""
    date = F.expr("make_date(year(month_end), 10, 1) AS Date")
    return cells.groupBy(date, F.col("nation").alias("fips_simple")).agg(
        *[F.expr(f"try_divide(cast(sum(amount_{r}) AS double), sum(orders_{r})) / 100 AS fmr_{r}") for r in ROOMS]
    )


class TpchSources:
    """The five source tables, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, cells: DataFrame):
        self.spark, self.sf_dir, self.cells = spark, sf_dir, cells

    @cached_property
    def weekly_rate(self) -> DataFrame:
        return rate_weekly(self.spark, self.sf_dir)

    @cached_property
    def index(self) -> DataFrame:
        return price_index(self.spark, self.sf_dir, self.cells)

    @cached_property
    def panel(self) -> DataFrame:
        return county_panel(self.cells)

    @cached_property
    def codes(self) -> DataFrame:
        return county_codes(self.spark, self.sf_dir)

    @cached_property
    def fair_rent(self) -> DataFrame:
        return fair_rent(self.cells)


# Fixed rules: coefficients of the stand-in models by density code u and bedroom count r;
# coefficients not named are zero.
PRICE_COEFFICIENTS = {
    "intercept": "20.0 * r - 10.0 * u",
    "apr_savgol": "-100.0 * u",
    "hpi_sa_savgol": "0.5 + 0.1 * r - 0.05 * u",
    "apr_savgol_div_1": "50.0 * r",
    "apr_savgol_div_2": "-20.0 * (r + u)",
    "sin1_month": "1.0 * u",
    "cos1_month": "0.5 * r",
    "cos3_month": "-0.25 * u",
}
RENT_COEFFICIENTS = {
    "intercept": "100.0 * r - 25.0 * u",
    "fmr": "0.3 + 0.05 * r - 0.02 * u",
    "apr_savgol": "500.0 * u",
    "apr_savgol_div_1": "-250.0 * r",
    "sin1_month": "4.0 * u",
    "cos2_month": "2.0 * r",
}


def fixed_models(spark: SparkSession, coefficients: dict[str, str], terms: list[str]) -> DataFrame:
    """Twelve models with known coefficients, in the shape of fitted ones."""
    markets = spark.range(12).selectExpr("cast(id % 3 + 1 AS int) u", "cast(id div 3 + 1 AS int) r")
    return markets.selectExpr(
        "u AS urban_code",
        "r AS rooms",
        f"cast({coefficients['intercept']} AS double) AS intercept",
        *[f"cast({coefficients.get(t, '0.0')} AS double) AS coef_{t}" for t in terms],
    )


# Fixed rules of the planted targets: what carries the signal, the season's height, and how much of the actual
# target is laid over it, by density code. Orders alone hold no signal that a model could find.
PLANTED = {
    "price": ("3.0 * hpi_sa_savgol", 40.0, (0.1, 0.6, 4.0)),
    "rent": ("fmr", 200.0, (0.02, 0.1, 2.0)),
}


def planted(kind: str, training_set: DataFrame) -> DataFrame:
    """Targets with a known signal: a macro series, as many cosines of the month as the market has by its codes,
    and the actual target as noise, which is small in urban and large in rural markets."""
    signal, height, noise = PLANTED[kind]
    waves = "(urban_code + 3 * rooms) % 6 + 1"
    season = " + ".join(
        f"CASE WHEN {waves} >= {h} THEN cos(month(month_end) * {h * 2 * math.pi / 12!r}D) ELSE 0D END" for h in range(1, 7)
    )
    share = f"CASE urban_code WHEN 1 THEN {noise[0]}D WHEN 2 THEN {noise[1]}D ELSE {noise[2]}D END"
    target = f"{signal} + {height}D * ({season}) + {share} * target AS target"
    return training_set.selectExpr("month_end", "urban_code", "rooms", target)
