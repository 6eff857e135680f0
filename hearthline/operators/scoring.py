"""Scoring feature rows with one linear model per market."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seasonal import MAX_HARMONICS, harmonic_names, with_harmonics
from .lasso import coef_name
from .relational import DENSITIES, ROOMS, every_market, with_density


def linear_value(features: Sequence[str]) -> Column:
    """Intercept plus the weighted features, as one column expression."""
    return F.expr(" + ".join(["intercept", *[f"{coef_name(f)} * {f}" for f in features]]))


def score_markets(features: DataFrame, models: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Predict every feature row in every market that has a model.

    Each feature row opens into the twelve markets and meets its model by key. Models of other
    markets are left out. A market with several models is an error when its rows are computed.
    """
    terms = [*columns, *harmonic_names(MAX_HARMONICS)]
    keys = [c for c in features.columns if c not in columns]
    one = F.when(F.count("*").over(Window.partitionBy("urban_code", "rooms")) > 1, F.raise_error(F.lit("several models of one market"))).otherwise(F.col("intercept"))
    fitted = models.filter(F.col("urban_code").isin(*DENSITIES) & F.col("rooms").isin(*ROOMS)).select(
        "urban_code", "rooms", one.alias("intercept"), *[coef_name(t) for t in terms]
    )
    return (
        every_market(features)
        .join(fitted, ["urban_code", "rooms"])
        .transform(with_harmonics, MAX_HARMONICS)
        .select(*keys, "urban_code", "rooms", linear_value(terms).alias("y_hat"))
        .transform(with_density)
    )
