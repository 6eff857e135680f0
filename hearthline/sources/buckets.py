"""Tables that meet on one key, dealt to buckets by it once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


class BucketStore:
    """A folder of Parquet tables with the same number of buckets each.

    Tables bucketed by the keys of a join, or of a group, meet bucket by bucket, without a shuffle. A table is
    written once; what is there already is an error. Sessions that didn't write a table register it, by its
    declared columns, when they first read it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, schemas: dict[str, str]):
        self.spark, self.path, self.buckets, self.schemas = spark, path, buckets, schemas

    def _name(self, table: str) -> str:
        return f"hearthline_{table}_{hashlib.md5(self._folder(table).encode()).hexdigest()}"

    def _folder(self, table: str) -> str:
        return f"{self.path}/{table}-{self.buckets}"

    def write(self, table: str, df: DataFrame, key: str) -> None:
        """One file per bucket; rows without a key lie in one of them."""
        names = self.spark.createDataFrame([], self.schemas[table]).columns
        rows = df.select(*names).repartition(self.buckets, key)
        rows.write.mode("error").option("path", self._folder(table)).bucketBy(self.buckets, key).saveAsTable(self._name(table))

    def read(self, table: str, key: str) -> DataFrame:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name(table)} ({self.schemas[table]}) USING parquet "
            f"CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self._folder(table)}'"
        )
        return self.spark.table(self._name(table))
