"""Every query over the TPC-H stand-in tables, by name.

A query is a function of ``Inputs`` and builds one lazy plan; nothing runs before an action, but for queries of
stored tables, which write these to the shared folder first.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar as cal
from ..functions.numbers import fixed
from ..functions.seasonal import MAX_HARMONICS, with_harmonics
from ..operators import gram, relational, series, smoothing, trend
from ..operators.envelope import on_grid
from ..sources import files, tpch
from ..sources.shared import fresh_path, write_csv
from . import panels
from . import scenario as sc
from .market import MarketData, Outlook, Parameters
from .models import MARKET, PRICE, RENT, MarketModel, fit_keyed, keyed_candidates, score_table as table_of_scores, with_actuals
from .store import ModelStore

# Parameters of the queries on the stand-in tables.
PARAMETERS = Parameters(
    state="AA",
    place="EUROPE",
    min_year=1996,
    features_before=2001,
    excluded_cell={"last_year": 1996, "rooms": 1, "urban_code": 2},
    scenario=sc.Scenario(
        hpi_after="1999-01-01",
        fmr_after="1996-01-01",
        apr_after="1997-01-01",
        start="2001-01-01",
        lease_start="2001-01-31",
    ),
)
SCENARIO = PARAMETERS.scenario
DIP = 85
DIP_GRID = tuple(range(131))
PATH_ALPHAS = (0.01, 0.03, 0.3, 1.0, 3.0, 30.0, 100.0)
STORED_SINCE, STORED_RATE = 1999, 0.0499
AS_OF = "2001-08-31"
BUY, RENT_IN = (1, 1), (1, 1)
SLICE = (1, 3)
# The smoother's windows and orders that can be chosen.
WINDOWS = tuple(range(11, 102, 2))
ORDERS = tuple(range(1, 11))


class Inputs:
    """Source tables of one query, and the market data built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return tpch.table(self.spark, self.sf_dir, name)

    def on(self, cells: DataFrame) -> MarketData:
        """Market data read off these cells."""
        return MarketData(tpch.TpchSources(self.spark, self.sf_dir, cells), PARAMETERS)

    @cached_property
    def market(self) -> MarketData:
        """For queries that read the cells in several places."""
        return self.on(tpch.order_cells(self.spark, self.sf_dir))

    @cached_property
    def prices_only(self) -> MarketData:
        """For queries that read order totals in one place; lines are not looked at."""
        return self.on(tpch.order_cells(self.spark, self.sf_dir, rents=False))

    @cached_property
    def recent(self) -> MarketData:
        """For queries that read the panel in one place; older orders are skipped in the scan."""
        since = dt.date(PARAMETERS.min_year, 1, 1)
        return self.on(tpch.order_cells(self.spark, self.sf_dir, since=since))

    @cached_property
    def places(self) -> DataFrame:
        """Index series of every place."""
        index = panels.index_series(self.prices_only.sources.index)
        return index.select("place_name", "month_end", "hpi_sa")

    @cached_property
    def fixed_price_models(self) -> DataFrame:
        return tpch.fixed_models(self.spark, tpch.PRICE_COEFFICIENTS, PRICE.terms)

    @cached_property
    def fixed_rent_models(self) -> DataFrame:
        return tpch.fixed_models(self.spark, tpch.RENT_COEFFICIENTS, RENT.terms)

    @cached_property
    def planted_models(self) -> dict[str, MarketModel]:
        """Models of targets that hold a known signal."""
        found = {}
        for kind, model in (("price", self.market.price_model), ("rent", self.market.rent_model)):
            found[kind] = MarketModel(model.spec, model.features, tpch.planted(kind, model.training_set))
        return found

    def outlook(self, *dips: float) -> Outlook:
        return self.market.outlook(self.fixed_price_models, self.fixed_rent_models, dips)


Query = Callable[[Inputs], DataFrame]
QUERIES: dict[str, tuple[Query, int]] = {}


#: Queries that write a table to the shared folder when they are built, and read it back.
STORED: set[str] = set()


def query(digits: int = 6, *, stored: bool = False):
    """Register a query; its doubles are reported with ``digits`` decimals."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = (f, digits)
        if stored:
            STORED.add(f.__name__)
        return f

    return register


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    f, digits = QUERIES[name]
    df = f(Inputs(spark, sf_dir))
    return df.select(
        *[
            fixed(c.name, digits) if isinstance(c.dataType, T.DoubleType) else F.col(c.name)
            for c in df.schema.fields
        ]
    )


# Dimensions, projections, filters.


@query()
def county_dim(i: Inputs) -> DataFrame:
    return i.prices_only.dim


@query()
def density_lookup(i: Inputs) -> DataFrame:
    """Urban code and density of every customer; codes without a density stay."""
    codes = tpch.county_codes(i.spark, i.sf_dir).select(
        F.col("FIPS code").alias("c_nationkey"), F.col("2013 code").alias("urban_code")
    )
    located = i.table("customer").select("c_custkey", "c_nationkey").join(codes, "c_nationkey")
    return relational.with_density(located.drop("c_nationkey"))


@query(8)
def select_features(i: Inputs) -> DataFrame:
    return relational.select_features(i.market.features, ["month_end", "apr", "hpi_sa"])


@query(4)
def filter_year(i: Inputs) -> DataFrame:
    return i.recent.panel


@query()
def index_series(i: Inputs) -> DataFrame:
    return panels.index_series(i.prices_only.sources.index, PARAMETERS.place)


@query(4)
def exclude_cell(i: Inputs) -> DataFrame:
    return i.market.rent_targets


@query()
def market_slice(i: Inputs) -> DataFrame:
    rows = i.market.price_model.market_rows(*SLICE)
    return rows.select("month_end", "urban_code", "rooms", "density", "target")


@query()
def head_5(i: Inputs) -> DataFrame:
    return i.market.features.orderBy("month_end").limit(5)


@query()
def date_fns(i: Inputs) -> DataFrame:
    parsed = F.to_date(F.col("o_orderdate").cast("string").substr(1, 10), "yyyy-MM-dd")
    return i.table("orders").select(
        "o_orderkey",
        parsed.alias("parsed"),
        F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1)).alias("first_day"),
        cal.month_end("o_orderdate").alias("month_end"),
        cal.previous_month_end(parsed).alias("previous_month_end"),
        cal.shift_month_ends(parsed, 12).alias("a_year_on"),
        F.year("o_orderdate").cast("bigint").alias("year"),
        F.month("o_orderdate").cast("bigint").alias("month"),
        cal.epoch_days(parsed).cast("bigint").alias("epoch_day"),
    )


# Tables written and read again.


@query(8, stored=True)
def rate_from_csv(i: Inputs) -> DataFrame:
    """The weekly rate through a gzipped CSV file, its dates parsed again, per month."""
    path = fresh_path(i.spark, "rate")
    write_csv(i.prices_only.sources.weekly_rate, path, compression="gzip")
    return panels.monthly_rate(files.mortgage_rate(i.spark, path))


@query(4, stored=True)
def panel_from_csv(i: Inputs) -> DataFrame:
    """The county panel through CSV files, plain and headed."""
    path = fresh_path(i.spark, "panel")
    write_csv(i.market.sources.panel, path)
    return panels.recent_panel(files.county_panel(i.spark, path), PARAMETERS.min_year)


@query(4, stored=True)
def panel_from_buckets(i: Inputs) -> DataFrame:
    """The county panel off orders and line sums that are bucketed by order: the join shuffles neither."""
    facts = tpch.store_facts(i.spark, i.sf_dir, fresh_path(i.spark, "facts"))
    cells = tpch.order_cells(i.spark, i.sf_dir, stored=facts)
    return panels.recent_panel(tpch.county_panel(cells), PARAMETERS.min_year)


def _panel_by_year(i: Inputs) -> str:
    path = fresh_path(i.spark, "panel-by-year")
    files.write_by_year(i.market.sources.panel, path)
    return path


@query(4, stored=True)
def stored_panel_since(i: Inputs) -> DataFrame:
    """The panel written by year and read from a year on: earlier folders are left out when the query is planned."""
    return files.read_since(i.spark, _panel_by_year(i), files.COUNTY_PANEL, STORED_SINCE)


@query(4, stored=True)
def stored_panel_years(i: Inputs) -> DataFrame:
    """The panel of the years whose mean rate is above a bound: folders are left out when the query runs."""
    rate = i.prices_only.rate.groupBy(F.year("month_end").alias("year")).agg(F.avg("apr").alias("apr"))
    return files.read_years(i.spark, _panel_by_year(i), files.COUNTY_PANEL, rate.filter(F.col("apr") > STORED_RATE))


def _stored_models(i: Inputs) -> ModelStore:
    store = ModelStore(i.spark, fresh_path(i.spark, "models"), PRICE.columns)
    store.write(i.market.price_model.fit_all(), 1)
    return store


@query(4, stored=True)
def stored_market_model(i: Inputs) -> DataFrame:
    """One market's model out of the store."""
    return _stored_models(i).model(1, *SLICE)


@query(4, stored=True)
def stored_models_vs_actual(i: Inputs) -> DataFrame:
    """Prices predicted by stored models, beside the actual ones."""
    model = i.market.price_model
    return with_actuals(model.predict(i.market.features, _stored_models(i).read(1)), i.market.price_targets)


# Aggregates and reshaping.


@query()
def region_counts(i: Inputs) -> DataFrame:
    return panels.region_counts(i.recent.panel, i.recent.dim)


@query()
def eligible_regions(i: Inputs) -> DataFrame:
    return i.recent.regions


@query(4)
def region_panel(i: Inputs) -> DataFrame:
    return i.market.means


@query()
def targets_long(i: Inputs) -> DataFrame:
    return i.market.price_targets


@query(4)
def rent_targets_long(i: Inputs) -> DataFrame:
    return panels.rent_targets(i.market.means)


@query(4)
def fmr_index(i: Inputs) -> DataFrame:
    return i.market.fmr


@query(8)
def monthly_rate(i: Inputs) -> DataFrame:
    return i.prices_only.rate


@query()
def chart_feed(i: Inputs) -> DataFrame:
    """Price per month and density for each bedroom count; codes without a density are not drawn."""
    targets = relational.with_density(i.market.price_targets).filter("density IS NOT NULL")
    return targets.groupBy("month_end", "rooms", "density").agg(F.avg("target").alias("mean_target"))


# Time series.


@query(4)
def monthly_interp(i: Inputs) -> DataFrame:
    return i.market.fmr_monthly


def _months_ahead(i: Inputs) -> DataFrame:
    """Month-ends that follow the last observed month of each place, and the first of them."""
    last = i.places.groupBy("place_name").agg(F.max("month_end").alias("last"))
    first = last.withColumn("first", cal.shift_month_ends("last", 1))
    return series.month_ends_after(first, "first", SCENARIO.periods)


@query()
def future_spine(i: Inputs) -> DataFrame:
    return _months_ahead(i).select("place_name", "month_end")


@query()
def stride_12(i: Inputs) -> DataFrame:
    return series.every_nth(i.places, 12, keys=["place_name"])


@query()
def savgol_smooth(i: Inputs) -> DataFrame:
    return smoothing.savgol(i.places, ["hpi_sa"], 11, 3, keys=["place_name"])


@query(7)
def savgol_sweep(i: Inputs) -> DataFrame:
    """The rate smoothed with every window and order that can be chosen."""
    return smoothing.savgol_grid(i.prices_only.rate, "apr", WINDOWS, ORDERS)


@query()
def gradient_1(i: Inputs) -> DataFrame:
    return smoothing.gradient(i.places, "hpi_sa", 1, keys=["place_name"])


@query()
def gradient_2(i: Inputs) -> DataFrame:
    return smoothing.gradient(i.places, "hpi_sa", 2, keys=["place_name"])


@query(8)
def harmonics(i: Inputs) -> DataFrame:
    return with_harmonics(i.prices_only.rate, MAX_HARMONICS)


# Joins and features.


@query(8)
def features_join(i: Inputs) -> DataFrame:
    return i.market.features


@query(8)
def price_features(i: Inputs) -> DataFrame:
    return PRICE.preprocess(panels.join_macro(i.prices_only.rate, i.prices_only.hpi))


@query(8)
def rent_features(i: Inputs) -> DataFrame:
    return RENT.preprocess(i.market.rent_model.features)


@query(8)
def training_set(i: Inputs) -> DataFrame:
    return i.market.price_model.training_set


@query(8)
def rent_training_set(i: Inputs) -> DataFrame:
    return i.market.rent_model.training_set


@query()
def fitted_vs_actual(i: Inputs) -> DataFrame:
    """Price predictions on the combined features beside the actual prices."""
    scores = i.market.price_model.predict(i.market.features, i.fixed_price_models)
    actual = relational.with_density(i.market.price_targets)
    return scores.join(actual, ["month_end", "rooms", "urban_code", "density"])


@query()
def fitted_rent_vs_actual(i: Inputs) -> DataFrame:
    """Rent predictions on the combined features beside the actual rents."""
    scores = i.market.rent_model.predict(i.market.features, i.fixed_rent_models)
    return with_actuals(scores, i.market.rent_targets)


@query(4)
def price_model_vs_actual(i: Inputs) -> DataFrame:
    """Prices predicted by the models fitted on them, beside the actual ones."""
    model = i.market.price_model
    return with_actuals(model.predict(i.market.features, model.fit_all()), i.market.price_targets)


@query(4)
def rent_model_vs_actual(i: Inputs) -> DataFrame:
    """Rents predicted by the models fitted on them, beside the actual ones."""
    model = i.market.rent_model
    return with_actuals(model.predict(i.market.features, model.fit_all()), i.market.rent_targets)


@query()
def history_plus_future(i: Inputs) -> DataFrame:
    return i.market.continued([DIP])


@query()
def future_vs_actual(i: Inputs) -> DataFrame:
    return i.market.prices_with_actuals(i.outlook(DIP))


@query()
def future_rent_vs_actual(i: Inputs) -> DataFrame:
    return i.market.rents_with_actuals(i.outlook(DIP))


# Fit.


@query()
def fold_assign(i: Inputs) -> DataFrame:
    return i.market.price_model.folds.select(*MARKET, "month_end", "fold")


@query(8)
def feature_stats(i: Inputs) -> DataFrame:
    return gram.feature_stats(i.market.price_model.folds, ["target", *PRICE.terms], MARKET)


@query()
def gram_stats(i: Inputs) -> DataFrame:
    """Sums of products of the standardised terms, one row per pair."""
    terms = [gram.ONE, "target", *PRICE.terms]
    products = i.market.price_model.products.select(*MARKET, "fold", "term", *terms)
    return products.unpivot([*MARKET, "fold", "term"], terms, "other_term", "total")


@query()
def cv_scores(i: Inputs) -> DataFrame:
    return i.market.price_model.candidates().select(*MARKET, "alpha", "harmonics", "r2")


@query()
def best_candidate(i: Inputs) -> DataFrame:
    return i.market.price_model.fit_all().select(*MARKET, "density", "alpha", "harmonics", "r2")


@query(4)
def lasso_models(i: Inputs) -> DataFrame:
    return i.market.price_model.fit_all().drop("fold_r2")


@query(4)
def rent_lasso_models(i: Inputs) -> DataFrame:
    return i.market.rent_model.fit_all().drop("fold_r2")


@query()
def score_table(i: Inputs) -> DataFrame:
    return i.market.scores()


@query()
def score_markets(i: Inputs) -> DataFrame:
    return i.market.price_model.predict(i.market.features, i.fixed_price_models)


# Fits of targets with a planted signal, which can succeed and fail.


@query()
def planted_targets(i: Inputs) -> DataFrame:
    parts = [m.targets.select(F.lit(kind).alias("kind"), "*") for kind, m in i.planted_models.items()]
    return parts[0].unionByName(parts[1])


@query()
def planted_cv_scores(i: Inputs) -> DataFrame:
    return keyed_candidates(i.planted_models, by_path=True).select("kind", *MARKET, "alpha", "harmonics", "r2")


@query(4)
def planted_models(i: Inputs) -> DataFrame:
    """The best model of each kind and market, read off the exact paths."""
    return fit_keyed(i.planted_models, by_path=True).drop("fold_r2")


@query()
def planted_score_table(i: Inputs) -> DataFrame:
    return table_of_scores(fit_keyed(i.planted_models, by_path=True))


@query(2)
def lasso_path(i: Inputs) -> DataFrame:
    """Fits of the planted prices at alphas between the grid's, each harmonics, from one path."""
    return i.planted_models["price"].candidates(PATH_ALPHAS, by_path=True).drop("fold_r2")


@query(3)
def planted_best_date_by_dip(i: Inputs) -> DataFrame:
    """From which dip to which a date is the best, for every choice, with models that fit."""
    prices, rents = (m.fit_all() for m in i.planted_models.values())
    return _best_by_dip(i, prices, rents)


# Scenario.


@query(8)
def trend_fit(i: Inputs) -> DataFrame:
    return i.market.trends


@query()
def trend_project(i: Inputs) -> DataFrame:
    return sc.project(i.market.trends, SCENARIO)


@query()
def correction_curve(i: Inputs) -> DataFrame:
    """The dip over the months that follow the last observed month of each place."""
    x = trend.months_since("month_end", "first")
    curve = trend.dip(x, start=0, end=SCENARIO.periods, centre=SCENARIO.centre, height=-DIP)
    months = _months_ahead(i)
    return months.select("place_name", "month_end", F.expr(x).alias("x"), curve.alias("correction"))


@query()
def scenario_macro(i: Inputs) -> DataFrame:
    return sc.future_macro(i.market.trends, SCENARIO, [DIP])


@query(4)
def rent_paid(i: Inputs) -> DataFrame:
    paid = i.market.rents_until(i.outlook(DIP))
    return paid.select("dip", *MARKET, "month_end", "rent_paid")


@query()
def total_cost(i: Inputs) -> DataFrame:
    return i.market.costs(i.outlook(DIP), buy=BUY, rent=RENT_IN)


@query()
def best_date(i: Inputs) -> DataFrame:
    best = i.market.best_date(i.outlook(DIP), AS_OF, buy=BUY, rent=RENT_IN)
    return best.drop("dip")


@query()
def scenario_grid(i: Inputs) -> DataFrame:
    return i.market.scenario_grid(i.outlook(*DIP_GRID), AS_OF)


def _best_by_dip(i: Inputs, prices: DataFrame, rents: DataFrame) -> DataFrame:
    low, high = DIP_GRID[0], DIP_GRID[-1]
    return i.market.best_date_by_dip(i.market.outlook(prices, rents, [low, high]), AS_OF, low=low, high=high)


@query()
def best_date_by_dip(i: Inputs) -> DataFrame:
    """From which dip to which a date is the best, for every choice."""
    return _best_by_dip(i, i.fixed_price_models, i.fixed_rent_models)


@query(3)
def fitted_best_date_by_dip(i: Inputs) -> DataFrame:
    """The same with fitted models."""
    return _best_by_dip(i, i.market.price_model.fit_all(), i.market.rent_model.fit_all())


@query(3)
def fitted_scenario_grid(i: Inputs) -> DataFrame:
    """The whole way: both kinds of models fitted, history and future scored, the best date of every choice at every
    dip of the grid, read off the lines of two dips."""
    found = fitted_best_date_by_dip(i)
    return on_grid(found, "dip", first=DIP_GRID[0], last=DIP_GRID[-1], value="total_cost_kusd")
