"""Readers for the five source tables, with declared types, and their column store.

CSV columns are found by header name: the files carry many columns beyond those used, in
an order that differs by release. Only the header line is read ahead; no type inference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import missing_as_null
from ..operators.relational import ROOMS

COUNTY_PANEL = T.StructType(
    [T.StructField("Date", T.DateType()), T.StructField("RegionName", T.IntegerType())]
    + [T.StructField(f"MedianListingPrice_{r}Bedroom", T.DoubleType()) for r in ROOMS]
    + [T.StructField(f"MedianRentalPrice_{r}Bedroom", T.DoubleType()) for r in ROOMS]
)
COUNTY_CODES = T.StructType(
    [
        T.StructField("FIPS code", T.IntegerType()),
        T.StructField("2013 code", T.IntegerType()),
        T.StructField("State Abr.", T.StringType()),
        T.StructField("County name", T.StringType()),
    ]
)
MORTGAGE_RATE = T.StructType(
    [T.StructField("DATE", T.DateType()), T.StructField("MORTGAGE30US", T.DoubleType())]
)
PRICE_INDEX = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("hpi_type", "hpi_flavor", "frequency", "place_name")]
    + [T.StructField("yr", T.IntegerType()), T.StructField("period", T.IntegerType())]
    + [T.StructField("index_sa", T.DoubleType()), T.StructField("index_nsa", T.DoubleType())]
)
FAIR_RENT = T.StructType(
    [T.StructField("Date", T.DateType()), T.StructField("fips_simple", T.IntegerType())]
    + [T.StructField(f"fmr_{r}", T.DoubleType()) for r in ROOMS]
)


def _typed(name: str, data_type: T.DataType, date_format: str | None = None) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(data_type, T.DateType):
        c = F.to_date(c, date_format) if date_format else c.cast("date")
    else:
        c = c.cast(data_type)
    if isinstance(data_type, T.DoubleType):
        c = missing_as_null(c)
    return c.alias(name)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, *, date_format: str | None = None
) -> DataFrame:
    """Declared columns of a headed CSV, plain or gzipped; a missing column is an error."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[_typed(f.name, f.dataType, date_format) for f in schema.fields])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Declared columns of a Parquet table; missing values are NULL, never NaN.

    The ``year`` folders of ``write_by_year`` are kept as a column, for filters to skip.
    """
    raw = spark.read.parquet(path)
    folders = ["year"] if "year" in raw.columns and "year" not in schema.names else []
    return raw.select(*[_typed(f.name, f.dataType) for f in schema.fields], *folders)


def write_by_year(df: DataFrame, path: str, *, date: str = "Date", rows_per_file: int = 10_000_000) -> None:
    """One-off rewrite as Parquet in one folder per year.

    A gzipped file cannot be split, so one task reads it; the rows are then rebalanced by year: Spark
    splits large years and joins small ones by their size, and later reads skip whole years.
    """
    (
        df.withColumn("year", F.year(date))
        .hint("rebalance", "year")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("year")
        .parquet(path)
    )


def read_years(spark: SparkSession, path: str, schema: T.StructType, years: DataFrame) -> DataFrame:
    """Rows of a table of ``write_by_year`` in the years of ``years`` (column ``year``, each once).

    The join on the folder column prunes folders when it runs, by the years that are left on the other side.
    """
    return read_parquet(spark, path, schema).join(years.select("year"), "year").select(*schema.names)


def read_since(spark: SparkSession, path: str, schema: T.StructType, year: int) -> DataFrame:
    """Rows of a table of ``write_by_year`` from a year on; folders of earlier years are not listed or read."""
    return read_parquet(spark, path, schema).filter(F.col("year") >= year).select(*schema.names)


def county_panel(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, COUNTY_PANEL)


def county_codes(spark: SparkSession, path: str) -> DataFrame:
    """The county dimension from its CSV export."""
    return read_csv(spark, path, COUNTY_CODES)


def mortgage_rate(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MORTGAGE_RATE)


def price_index(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PRICE_INDEX)


def fair_rent(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet(spark, path, FAIR_RENT)
