"""Source tables to month-end series, panels and targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import from_year, month_end_of, previous_month_end
from ..operators.relational import (
    DENSITIES,
    ROOMS,
    all_nonzero,
    means_through,
    non_null_counts,
    without_cell,
)
from ..operators.reshape import unpivot_rooms
from ..operators.series import interpolate_monthly, resample_monthly

# Counties count only if they report both of these at least once.
REQUIRED_MEASURES = ("MedianListingPrice_1Bedroom", "MedianRentalPrice_1Bedroom")

# The index rows that are read.
INDEX_TYPE, INDEX_FLAVOR = "traditional", "purchase-only"

# Column names of the published county table, and the names used here.
COUNTY_NAMES = {
    "FIPS code": "RegionName",
    "2013 code": "urban_code",
    "State Abr.": "state",
    "County name": "county_name",
}


def monthly_rate(weekly: DataFrame) -> DataFrame:
    """Weekly percent to a monthly fraction; months without a week are kept, as NULL."""
    return resample_monthly(
        weekly.select("DATE", (F.col("MORTGAGE30US") / 100).alias("apr")), "DATE", ["apr"]
    )


def index_series(
    index: DataFrame, place: str | None = None, *, frequency: str | None = "monthly"
) -> DataFrame:
    """Purchase-only index on month-ends, of one place or all.

    Monthly rows only unless another frequency is asked for: the period of a quarterly row is
    not a month.
    """
    wanted = (F.col("hpi_type") == INDEX_TYPE) & (F.col("hpi_flavor") == INDEX_FLAVOR)
    if frequency is not None:
        wanted &= F.col("frequency") == frequency
    if place is not None:
        wanted &= F.col("place_name") == place
    return (
        index.filter(wanted)
        .withColumnsRenamed({"index_sa": "hpi_sa", "index_nsa": "hpi_nsa"})
        .withColumn("month_end", month_end_of("yr", "period"))
        .drop("hpi_type", "hpi_flavor", "yr", "period")
    )


def county_dim(codes: DataFrame, state: str) -> DataFrame:
    """Counties of one state: ``RegionName, urban_code, state, county_name``."""
    named = codes.withColumnsRenamed(COUNTY_NAMES).select(*COUNTY_NAMES.values())
    return named.filter(F.col("state") == state)


def recent_panel(panel: DataFrame, min_year: int) -> DataFrame:
    """Rows from ``min_year`` on; a panel stored by year skips the folders before."""
    if "year" in panel.columns:
        panel = panel.filter(F.col("year") >= min_year).drop("year")
    return panel.filter(from_year("Date", min_year))


def region_counts(panel: DataFrame, dim: DataFrame) -> DataFrame:
    """Months with a value, per county of the dimension.

    Rows are counted before they meet the dimension: a county with very many of them is one
    row per task by then.
    """
    counts = non_null_counts(panel, ["RegionName"], REQUIRED_MEASURES)
    return counts.join(dim.select("RegionName"), "RegionName")


def eligible_regions(panel: DataFrame, dim: DataFrame) -> DataFrame:
    """Counties of the dimension with at least one value of every required measure."""
    counts = non_null_counts(panel, ["RegionName"], REQUIRED_MEASURES)
    enough = counts.filter(all_nonzero(REQUIRED_MEASURES))
    return dim.join(enough, "RegionName", "left_semi")


def region_panel(panel: DataFrame, regions: DataFrame) -> DataFrame:
    """Unweighted mean of every measure over the counties of each code and month."""
    measures = [c for c in panel.columns if c not in ("Date", "RegionName")]
    means = means_through(panel, regions, "RegionName", "Date", "urban_code", measures)
    return means.withColumnRenamed("Date", "month_end")


def price_targets(means: DataFrame) -> DataFrame:
    """Listing prices in thousands, one row per month and market."""
    long = unpivot_rooms(means, ["month_end", "urban_code"], "MedianListingPrice_{}Bedroom", "target")
    return long.dropna().withColumn("target", F.col("target") / 1000)


def rent_targets(means: DataFrame, *, excluded: dict[str, int] | None = None) -> DataFrame:
    """Monthly rents, one row per month and market, without one sparse early cell."""
    long = unpivot_rooms(means, ["month_end", "urban_code"], "MedianRentalPrice_{}Bedroom", "target")
    long = long.dropna()
    return without_cell(long, **excluded) if excluded else long


def fair_rent_monthly(fair_rent: DataFrame, regions: DataFrame) -> DataFrame:
    """Annual fair rents by code, spread over the months: ``urban_code, rooms, month_end, fmr``."""
    modelled = regions.filter(F.col("urban_code").isin(*DENSITIES))
    rents = fair_rent.select("Date", F.col("fips_simple").alias("RegionName"), *[f"fmr_{r}" for r in ROOMS])
    annual = means_through(rents, modelled, "RegionName", "Date", "urban_code", [f"fmr_{r}" for r in ROOMS])
    annual = annual.withColumn("month_end", previous_month_end("Date")).drop("Date")
    points = unpivot_rooms(annual, ["month_end", "urban_code"], "fmr_{}", "fmr")
    return interpolate_monthly(points, "fmr", keys=["urban_code", "rooms"])


def fair_rent_index(monthly: DataFrame) -> DataFrame:
    """Unweighted mean over codes and bedroom counts."""
    return monthly.groupBy("month_end").agg(F.avg("fmr").alias("fmr"))


def join_macro(*series: DataFrame, on: Sequence[str] = ("month_end",)) -> DataFrame:
    """Months present in every series."""
    joined = series[0]
    for other in series[1:]:
        joined = joined.join(other, list(on))
    return joined
