"""The folder that all executors share, for tables written once and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none, a folder beside the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_kept"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own for each call."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, *, compression: str | None = None) -> None:
    """Headed CSV, as the sources come; ``compression='gzip'`` for gzipped files. Missing values are empty."""
    options = {"header": True, "nullValue": ""} | ({"compression": compression} if compression else {})
    df.write.options(**options).csv(path)
