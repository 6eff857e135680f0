"""From the five source tables to models, outlooks and the best date to buy."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..functions.calendar import before_year
from ..operators.cost import best_date
from ..sources import files
from . import panels
from . import scenario as sc
from .models import PRICE, RENT, MarketModel, fit_keyed, score_table, with_actuals


@dataclass(frozen=True)
class Parameters:
    """What is fixed in the analysis of one area."""

    state: str
    place: str
    min_year: int = 2011
    features_before: int = 2018
    excluded_cell: dict[str, int] = field(
        default_factory=lambda: {"last_year": 2012, "rooms": 1, "urban_code": 2}
    )
    scenario: sc.Scenario = sc.Scenario()


@dataclass(frozen=True)
class Sources:
    """The source tables under their original column names."""

    weekly_rate: DataFrame
    index: DataFrame
    panel: DataFrame
    codes: DataFrame
    fair_rent: DataFrame

    @classmethod
    def from_files(
        cls, spark: SparkSession, *, rate: str, index: str, panel: str, codes: str, fair_rent: str
    ) -> Sources:
        """CSV files (plain or gzipped), and Parquet for the panel if so named and for fair rents."""
        if panel.endswith((".csv", ".csv.gz")):
            counties = files.county_panel(spark, panel)
        else:
            counties = files.read_parquet(spark, panel, files.COUNTY_PANEL)
        return cls(
            files.mortgage_rate(spark, rate),
            files.price_index(spark, index),
            counties,
            files.county_codes(spark, codes),
            files.fair_rent(spark, fair_rent),
        )


@dataclass(frozen=True)
class Outlook:
    """Macro series over history and future, one frame per dip, and every market's scores.

    ``macro`` has the lines without a dip alongside.
    """

    macro: DataFrame
    prices: DataFrame
    rents: DataFrame


class MarketData:
    """Series, targets and models of one area.

    Everything is one lazy plan; Spark reuses the exchanges that branches share. ``keep`` may write the
    reduced tables that several branches read (a row per county, per code and month, or per month) to a
    folder that all executors share, and read them back.
    """

    def __init__(
        self,
        sources: Sources,
        parameters: Parameters,
        *,
        keep: Callable[[DataFrame], DataFrame] = lambda df: df,
    ):
        self.sources, self.parameters, self.keep = sources, parameters, keep

    @cached_property
    def rate(self) -> DataFrame:
        return self.keep(panels.monthly_rate(self.sources.weekly_rate))

    @cached_property
    def hpi(self) -> DataFrame:
        place = panels.index_series(self.sources.index, self.parameters.place)
        return self.keep(place.select("month_end", "hpi_sa"))

    @cached_property
    def dim(self) -> DataFrame:
        return panels.county_dim(self.sources.codes, self.parameters.state)

    @cached_property
    def panel(self) -> DataFrame:
        return panels.recent_panel(self.sources.panel, self.parameters.min_year)

    @cached_property
    def regions(self) -> DataFrame:
        return self.keep(panels.eligible_regions(self.panel, self.dim))

    @cached_property
    def means(self) -> DataFrame:
        return self.keep(panels.region_panel(self.panel, self.regions))

    @cached_property
    def price_targets(self) -> DataFrame:
        return panels.price_targets(self.means)

    @cached_property
    def rent_targets(self) -> DataFrame:
        return panels.rent_targets(self.means, excluded=self.parameters.excluded_cell)

    @cached_property
    def fmr_monthly(self) -> DataFrame:
        return panels.fair_rent_monthly(self.sources.fair_rent, self.regions)

    @cached_property
    def fmr(self) -> DataFrame:
        return self.keep(panels.fair_rent_index(self.fmr_monthly))

    @cached_property
    def fmr_before(self) -> DataFrame:
        """Fair-rent index of the years the combined features cover."""
        return self.fmr.filter(before_year("month_end", self.parameters.features_before))

    @cached_property
    def features(self) -> DataFrame:
        return panels.join_macro(self.rate, self.hpi, self.fmr_before)

    @cached_property
    def macro_rows(self) -> DataFrame:
        """The three macro series as rows, for trends and history alike."""
        return self.keep(sc.macro_rows(self.rate, self.hpi, self.fmr_before))

    @cached_property
    def trends(self) -> DataFrame:
        return sc.macro_trends(self.macro_rows, self.parameters.scenario)

    @cached_property
    def price_model(self) -> MarketModel:
        return MarketModel(PRICE, panels.join_macro(self.rate, self.hpi), self.price_targets)

    @cached_property
    def rent_model(self) -> MarketModel:
        return MarketModel(RENT, panels.join_macro(self.fmr, self.rate), self.rent_targets)

    def scores(self) -> DataFrame:
        return score_table(self.fit_both())

    def fit_both(self) -> DataFrame:
        """The best models of both kinds, told apart by ``kind``, from one fit."""
        return fit_keyed({"price": self.price_model, "rent": self.rent_model})

    def continued(self, dips: Sequence[float]) -> DataFrame:
        """Observed and projected macro series, one frame per dip."""
        scenario = self.parameters.scenario
        future = sc.future_macro(self.trends, scenario, dips)
        return self.keep(sc.history_plus_future(sc.shared_months(self.macro_rows), future, dips))

    def outlook(
        self, price_models: DataFrame, rent_models: DataFrame, dips: Sequence[float]
    ) -> Outlook:
        """History and future scored in every market, for each dip."""
        macro = self.continued(dips)
        return Outlook(
            macro,
            self.price_model.predict(macro, price_models, keys=["dip"]),
            self.rent_model.predict(macro, rent_models, keys=["dip"]),
        )

    def prices_with_actuals(self, outlook: Outlook) -> DataFrame:
        """Predicted prices, with the actual one in months that have it."""
        return with_actuals(outlook.prices, self.price_targets, how="left")

    def rents_with_actuals(self, outlook: Outlook) -> DataFrame:
        """Predicted rents, with the actual one in months that have it."""
        return with_actuals(outlook.rents, self.rent_targets, how="left")

    def rents_until(self, outlook: Outlook) -> DataFrame:
        return sc.rents_until(outlook.rents, self.parameters.scenario)

    def costs(self, outlook: Outlook, *, buy: tuple[int, int], rent: tuple[int, int]) -> DataFrame:
        """Cost of buying at each month-end; markets are (urban code, rooms)."""
        return sc.choice_costs(outlook.prices, self.rents_until(outlook), buy=buy, rent=rent)

    def best_date(
        self,
        outlook: Outlook,
        as_of: dt.date | str,
        *,
        buy: tuple[int, int],
        rent: tuple[int, int],
    ) -> DataFrame:
        """Cheapest month-end after ``as_of`` per dip."""
        return best_date(self.costs(outlook, buy=buy, rent=rent), as_of, by=["dip"])

    def scenario_grid(self, outlook: Outlook, as_of: dt.date | str) -> DataFrame:
        return sc.scenario_grid(outlook.prices, self.rents_until(outlook), as_of)

    def best_date_by_dip(self, outlook: Outlook, as_of: dt.date | str, *, low: float, high: float) -> DataFrame:
        """Best date of every choice for every real dip between the two that ``outlook`` holds."""
        return sc.best_date_by_dip(outlook.prices, self.rents_until(outlook), as_of, low, high)
