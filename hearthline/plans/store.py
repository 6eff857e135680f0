"""Fitted models kept as rows, in versions, and looked up by market."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.seasonal import MAX_HARMONICS, harmonic_names
from ..operators.lasso import coef_name
from ..operators.relational import market


class ModelStore:
    """One folder of models of one kind.

    Rows lie in folders by version and urban code, so a lookup of one market opens the files of its code alone.
    A version is written once; what is there already is an error. The rows are what ``fit_all`` returns.
    """

    def __init__(self, spark: SparkSession, path: str, terms: list[str]):
        self.spark, self.path, self.terms = spark, path, terms

    @property
    def schema(self) -> T.StructType:
        """Declared, so that opening the store looks at no file."""
        coefs = ", ".join(f"{coef_name(t)} double" for t in [*self.terms, *harmonic_names(MAX_HARMONICS)])
        return T.StructType.fromDDL(
            f"rooms int, density string, alpha double, harmonics int, r2 double, intercept double, {coefs}, version int, urban_code int"
        )

    def write(self, models: DataFrame, version: int) -> None:
        """Store the models of every market as one version; rows of a code go to one file."""
        folder = f"{self.path}/version={int(version)}"
        names = [f.name for f in self.schema if f.name != "version"]
        models.select(*names).repartition("urban_code").write.mode("error").partitionBy("urban_code").parquet(folder)

    def read(self, version: int) -> DataFrame:
        """All models of a version, in the columns of ``fit_all``."""
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path)
        names = [f.name for f in self.schema if f.name not in ("version", "urban_code", "rooms")]
        return rows.filter(F.col("version") == version).select("urban_code", "rooms", *names)

    def model(self, version: int, urban_code: int, rooms: int) -> DataFrame:
        """One market's model: a row, or none."""
        return self.read(version).filter(market(urban_code, rooms))
