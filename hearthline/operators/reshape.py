"""Wide panels to long rows, and history joined to its continuation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import ROOMS


def unpivot_rooms(df: DataFrame, ids: Sequence[str], template: str, value: str) -> DataFrame:
    """One row per bedroom count from columns named by ``template`` (``'fmr_{}'``)."""
    named = df.selectExpr(*ids, *[f"{template.format(r)} AS `{r}`" for r in ROOMS])
    return named.unpivot(list(ids), [str(r) for r in ROOMS], "rooms", value).withColumn(
        "rooms", F.col("rooms").cast("int")
    )


def append_rows(history: DataFrame, future: DataFrame) -> DataFrame:
    """All rows of both by column name; a column one side lacks is NULL there."""
    return history.unionByName(future, allowMissingColumns=True)
