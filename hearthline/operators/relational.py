"""Counts, means, eligibility tests and lookups over wide panels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Area density by urban code.
DENSITIES = {1: "urban", 2: "suburb", 3: "rural"}
# Bedroom counts that form a market with a density.
ROOMS = (1, 2, 3, 4)


def density_dim(spark: SparkSession) -> DataFrame:
    """The three-row density dimension."""
    rows = ", ".join(f"({code}, '{name}')" for code, name in DENSITIES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS density(urban_code, density)")


def with_density(df: DataFrame) -> DataFrame:
    """Left-join the density label; codes without one keep their rows and get NULL.

    The dimension is a literal of three rows, so broadcasting it is always safe.
    """
    return df.join(F.broadcast(density_dim(df.sparkSession)), "urban_code", "left")


def select_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select(*features)


def non_null_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Count the non-missing values of several columns per group."""
    return df.groupBy(*keys).agg(*[F.count(c).alias(c) for c in columns])


def all_nonzero(columns: Sequence[str]) -> Column:
    """True where every listed column differs from zero."""
    return reduce(and_, [F.col(c) != 0 for c in columns])


def means_through(
    df: DataFrame, dim: DataFrame, key: str, date: str, group: str, measures: Sequence[str]
) -> DataFrame:
    """Mean of each measure per ``date`` and the ``group`` that ``dim`` gives a row's ``key``.

    Rows are summed and counted per date and key before they meet the dimension: a key with very many
    of them is one row per task and date by then. Rows with a missing date or group vanish.
    """
    sums = [F.sum(c).alias(f"{c}__sum") for c in measures] + [F.count(c).alias(f"{c}__n") for c in measures]
    reduced = df.dropna(subset=[date]).groupBy(date, key).agg(*sums)
    joined = reduced.join(dim.select(key, group).dropna(subset=[group]), key)
    return joined.groupBy(date, group).agg(
        *[F.try_divide(F.sum(f"{c}__sum"), F.sum(f"{c}__n")).alias(c) for c in measures]
    )


def without_cell(df: DataFrame, *, last_year: int, rooms: int, urban_code: int) -> DataFrame:
    """Drop one sparse cell: rows of one market up to and including ``last_year``."""
    keep = [
        F.year("month_end") > last_year,
        F.col("rooms") != rooms,
        F.col("urban_code") != urban_code,
    ]
    return df.filter(reduce(or_, keep))


def market(urban_code: int, rooms: int) -> Column:
    """Predicate for the rows of one market."""
    return (F.col("urban_code") == urban_code) & (F.col("rooms") == rooms)


def every_market(df: DataFrame) -> DataFrame:
    """Repeat each row for each of the twelve markets (three densities, four room counts)."""
    pairs = ", ".join(
        f"struct({code} AS urban_code, {r} AS rooms)" for code in DENSITIES for r in ROOMS
    )
    return df.selectExpr("*", f"inline(array({pairs}))")
