"""Folds and cross-products: all that a grid search over linear models needs of the rows.

Training rows are one per market and month. They are partitioned by market once; the
centring windows, the fold numbers, the sums and the solver all use that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ONE = "one"


def with_folds(
    df: DataFrame, keys: Sequence[str], *, folds: int = 5, seed: int = 20, date: str = "month_end"
) -> DataFrame:
    """Add ``fold`` 0..``folds - 1``: near-equal parts of each market in hashed date order."""
    shuffled = F.md5(F.concat(F.col(date).cast("string"), F.lit(f"|{seed}")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(shuffled))
    return df.withColumn("fold", F.pmod(place - 1, F.lit(folds)).cast("int"))


def feature_stats(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of each column per market."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        *[F.expr(f"avg({c}) AS {c}_mean") for c in columns],
        *[F.expr(f"stddev_pop({c}) AS {c}_std") for c in columns],
    )


def standardise(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Centre and scale columns within each market; ``<c>__mean`` and ``<c>__scale`` undo it.

    Sums of products of standardised values lose nothing to cancellation when one fold's
    sums are later taken from the total. A constant column becomes zero.
    """
    market = f"OVER (PARTITION BY {', '.join(keys)})"
    kept = [c for c in df.columns if c not in columns]
    measured = df.selectExpr(
        *kept,
        *columns,
        *[f"avg({c}) {market} AS {c}__mean" for c in columns],
        *[f"stddev_pop({c}) {market} AS {c}__scale" for c in columns],
    )
    return measured.selectExpr(
        *kept,
        *[
            f"CASE WHEN {c}__scale <= 1e-12 * (abs({c}__mean) + 1) THEN 0D "
            f"ELSE ({c} - {c}__mean) / {c}__scale END AS {c}"
            for c in columns
        ],
        *[f"{c}__{part}" for c in columns for part in ("mean", "scale")],
    )


def cross_products(df: DataFrame, terms: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per market and fold, the sums of products of every pair of terms and the count.

    One row per ``term``, one column per term: a row of the cross-product matrix, with the
    ``mean`` and ``scale`` its term was standardised by. The term ``one`` holds plain sums. Each
    training row opens into its terms inside the stage that reads it and is summed there, in hash
    maps, before anything is shuffled.
    """
    names = [ONE, *terms]
    rows = [f"struct('{ONE}' AS term, 1D AS left_value, 0D AS mean, 1D AS scale)"] + [
        f"struct('{t}' AS term, {t} AS left_value, {t}__mean AS mean, {t}__scale AS scale)"
        for t in terms
    ]
    return (
        df.withColumn(ONE, F.lit(1.0))
        .selectExpr(*keys, "fold", *names, f"inline(array({', '.join(rows)}))")
        .groupBy(*keys, "fold", "term")
        .agg(
            *[F.expr(f"sum(left_value * {t}) AS {t}") for t in names],
            F.max("mean").alias("mean"),
            F.max("scale").alias("scale"),
        )
    )
