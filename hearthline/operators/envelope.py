"""The lowest of many lines, everywhere at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(line: Column, x: Column) -> Column:
    return line["at_low"] + line["slope"] * x


def lower_envelope(
    lines: DataFrame, *, keys: Sequence[str], label: str, at_low: str, slope: str, low: float, high: float
) -> DataFrame:
    """Which line of each group is lowest, between ``low`` and ``high``: one row per stretch.

    A line is its value at ``low`` and its slope. Returns ``keys``, ``label``, ``low``, ``high`` (the stretch's ends),
    ``value_low`` and ``value_high`` (the line there). At a border both neighbours are equal. Of equal lines the
    first by ``label`` counts. Lines with a NULL are left out; a group without lines gives no row.

    Lines come by falling slope, so a new line beats the lowest one so far from some place on and nowhere
    before: stretches that begin beyond that place go, and the new line begins there. A group's lines are
    gathered, so their number must be bounded, as the months of a horizon are.
    """
    width = float(high) - float(low)
    if not width > 0:
        raise ValueError(f"the range must not be empty: {low} to {high}")
    line = F.struct((-F.col(slope)).alias("falling"), F.col(at_low).alias("at_low"), F.col(label).alias("label"))
    known = F.col(slope).isNotNull() & F.col(at_low).isNotNull() & ~F.isnan(slope) & ~F.isnan(at_low)
    grouped = lines.where(known).groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    given = F.transform("lines", lambda e: F.struct(e["label"].alias("label"), e["at_low"].alias("at_low"), (-e["falling"]).alias("slope"), F.lit(0.0).alias("start")))

    def add(below: Column, new: Column) -> Column:
        stays = F.filter(below, lambda e: _at(e, e["start"]) <= _at(new, e["start"]))
        last = F.try_element_at(stays, F.lit(-1))
        # Where the new line meets the last that stays; parallel lines never do.
        meets = F.when(F.size(stays) == 0, 0.0).otherwise(F.try_divide(new["at_low"] - last["at_low"], last["slope"] - new["slope"]))
        one = F.array(F.struct(new["label"].alias("label"), new["at_low"].alias("at_low"), new["slope"].alias("slope"), meets.alias("start")))
        return F.when(meets < width, F.concat(stays, one)).otherwise(stays)

    none = F.filter(given, lambda e: F.lit(False))
    stretches = grouped.select(*keys, F.aggregate(given, none, add).alias("s"))
    until = lambda i: F.coalesce(F.get("s", i + 1)["start"], F.lit(width))
    ended = F.transform("s", lambda e, i: F.struct(e.alias("e"), until(i).alias("end")))
    rows = stretches.select(*keys, F.explode(ended).alias("r")).where(F.col("r.end") > F.col("r.e.start"))
    return rows.select(
        *keys,
        F.col("r.e.label").alias(label),
        (F.col("r.e.start") + low).alias("low"),
        (F.col("r.end") + low).alias("high"),
        _at(F.col("r.e"), F.col("r.e.start")).alias("value_low"),
        _at(F.col("r.e"), F.col("r.end")).alias("value_high"),
    )


def on_grid(stretches: DataFrame, name: str, *, first: int, last: int, value: str) -> DataFrame:
    """Every whole number from ``first`` to ``last`` that a stretch holds, as ``name``, and the line's ``value`` there.

    A number on a border goes to the stretch that ends there.
    """
    begin = F.greatest(F.lit(first), F.when(F.col("low") <= first, F.lit(first)).otherwise(F.floor("low") + 1)).cast("int")
    end = F.least(F.lit(last), F.floor("high")).cast("int")
    opened = stretches.withColumn("__begin", begin).withColumn("__end", end).where("__begin <= __end")
    opened = opened.withColumn(name, F.explode(F.sequence("__begin", "__end"))).withColumn(name, F.col(name).cast("double"))
    share = (F.col(name) - F.col("low")) / (F.col("high") - F.col("low"))
    line = F.col("value_low") + share * (F.col("value_high") - F.col("value_low"))
    return opened.withColumn(value, line).drop("low", "high", "value_low", "value_high", "__begin", "__end")
