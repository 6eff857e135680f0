"""One sparse linear model per market, for prices and for rents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seasonal import MAX_HARMONICS, harmonic_names, with_harmonics
from ..operators.gram import cross_products, standardise, with_folds
from ..operators.lasso import ALPHAS, best_candidates, fit_candidates, path_breakpoints
from ..operators.relational import DENSITIES, market, select_features, with_density
from ..operators.scoring import score_markets
from ..operators.smoothing import gradient, savgol

MARKET = ["urban_code", "rooms"]


@dataclass(frozen=True)
class ModelSpec:
    """What a model reads and how its macro series are prepared."""

    inputs: tuple[str, ...]
    smoothed: tuple[str, ...]
    derivatives: int
    window_length: int = 11
    poly_order: int = 3

    @property
    def columns(self) -> list[str]:
        raw = [c for c in self.inputs if c not in self.smoothed]
        return [
            *raw,
            *[f"{c}_savgol" for c in self.smoothed],
            *[f"apr_savgol_div_{d}" for d in range(1, self.derivatives + 1)],
        ]

    @property
    def terms(self) -> list[str]:
        return [*self.columns, *harmonic_names(MAX_HARMONICS)]

    def preprocess(self, features: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
        """Smooth, then differentiate the rate, over the whole series passed in.

        Values near the end of history therefore change when a future is appended.
        """
        return (
            features.transform(select_features, [*keys, "month_end", *self.inputs])
            .transform(savgol, self.smoothed, self.window_length, self.poly_order, keys=keys)
            .transform(gradient, "apr_savgol", self.derivatives, keys=keys)
        )


PRICE = ModelSpec(inputs=("apr", "hpi_sa"), smoothed=("apr", "hpi_sa"), derivatives=2)
RENT = ModelSpec(inputs=("apr", "fmr"), smoothed=("apr",), derivatives=1)


class MarketModel:
    """Training rows, fitted models and predictions of one kind of target.

    Every member is a DataFrame; nothing is computed before an action. ``fit_all`` returns plain
    rows (scores and coefficients), which can be written and read back as ``models``.
    """

    def __init__(self, spec: ModelSpec, features: DataFrame, targets: DataFrame):
        self.spec, self.features, self.targets = spec, features, targets

    @cached_property
    def training_set(self) -> DataFrame:
        """Targets with the prepared macro series of their month.

        The macro side is one row per calendar month; Spark broadcasts it by its own size check.
        """
        prepared = self.spec.preprocess(self.features)
        return self.targets.join(prepared, "month_end").transform(with_density)

    def market_rows(self, urban_code: int, rooms: int) -> DataFrame:
        return self.training_set.filter(market(urban_code, rooms))

    @cached_property
    def folds(self) -> DataFrame:
        """Training rows of the modelled codes with seasonal columns and a fold number."""
        rows = self.training_set.filter(F.col("urban_code").isin(*DENSITIES)).dropna(
            subset=["target", *self.spec.columns]
        )
        return rows.transform(with_harmonics, MAX_HARMONICS).transform(with_folds, MARKET)

    @cached_property
    def products(self) -> DataFrame:
        terms = ["target", *self.spec.terms]
        return self.folds.transform(standardise, terms, MARKET).transform(
            cross_products, terms, MARKET
        )

    def candidates(self, alphas: Sequence[float] = ALPHAS, *, by_path: bool = False) -> DataFrame:
        """Every grid point of every market."""
        return fit_candidates(self.products, self.spec.columns, MARKET, alphas=alphas, by_path=by_path)

    def fit_all(self) -> DataFrame:
        """The best grid point of every market, refitted on all its rows."""
        return best_candidates(self.candidates(), MARKET).transform(with_density)

    def breakpoints(self) -> DataFrame:
        """The whole path of every market and number of harmonics, fitted on all rows."""
        return path_breakpoints(self.products, self.spec.columns, MARKET)

    def predict(
        self, features: DataFrame, models: DataFrame, *, keys: Sequence[str] = ()
    ) -> DataFrame:
        """``month_end, y_hat, urban_code, rooms, density`` for every market with a model."""
        prepared = self.spec.preprocess(features, keys=keys)
        return score_markets(prepared, models, self.spec.columns)


def with_actuals(scores: DataFrame, targets: DataFrame, *, how: str = "inner") -> DataFrame:
    """Predictions beside actual targets; ``how='left'`` keeps months without one."""
    on = ["month_end", *MARKET]
    return scores.join(targets.select(*on, "target"), on, how)


KEYED = ["kind", *MARKET]


def keyed_products(models: dict[str, MarketModel]) -> tuple[DataFrame, list[str]]:
    """Cross-products of several kinds of models in one table keyed by kind and market, and their macro columns.

    A column that a kind doesn't read is zero in its rows; the solver leaves constant columns out.
    """
    columns = list(dict.fromkeys(c for m in models.values() for c in m.spec.columns))
    terms = ["target", *columns, *harmonic_names(MAX_HARMONICS)]
    parts = []
    for kind, m in models.items():
        given = [t if t in m.folds.columns else f"0D AS {t}" for t in terms]
        parts.append(m.folds.selectExpr(f"'{kind}' AS kind", *MARKET, "fold", *given))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.transform(standardise, terms, KEYED).transform(cross_products, terms, KEYED), columns


def keyed_candidates(models: dict[str, MarketModel], alphas: Sequence[float] = ALPHAS, *, by_path: bool = False) -> DataFrame:
    """Every grid point of every kind and market, from one aggregate and one pass of the solver."""
    products, columns = keyed_products(models)
    return fit_candidates(products, columns, KEYED, alphas=alphas, by_path=by_path)


def fit_keyed(models: dict[str, MarketModel], *, by_path: bool = False) -> DataFrame:
    """The best grid point of every kind and market."""
    return best_candidates(keyed_candidates(models, by_path=by_path), KEYED).transform(with_density)


def score_table(fitted: DataFrame) -> DataFrame:
    """Cross-validated scores of both kinds of models per market, from ``fit_keyed``; weak price fits are flagged.

    Markets that have both kinds.
    """
    r2 = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("r2"))).alias(f"r2_{kind}")
    rows = fitted.groupBy(*MARKET, "density").agg(r2("price"), r2("rent"), F.count_distinct("kind").alias("kinds"))
    return rows.filter("kinds = 2").select(
        "rooms",
        "urban_code",
        "density",
        "r2_price",
        "r2_rent",
        F.format_string("%.2f", "r2_price").alias("r2_price_label"),
        F.format_string("%.2f", "r2_rent").alias("r2_rent_label"),
        (F.col("r2_price") < 0.5).alias("weak_price_fit"),
    )
