"""Reading the corpus tables, keeping intermediate ones, and Arrow maps in bounded pieces."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step of an Arrow map works on; a longer text makes a step of its own.
STEP_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a folder beside the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_kept"


def keep(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/hearthline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def steps(batch: pa.RecordBatch, text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def ship(spark: SparkSession) -> None:
    """Hand this package's code to the executors, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_hearthline_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp()) / "hearthline_code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for one in [package / "__init__.py", *sorted((package / "llm").glob("*.py"))]:
            out.write(one, one.relative_to(package.parent))
    context.addPyFile(str(path))
    context._hearthline_shipped = True


def mapped(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema, text: str = "text") -> DataFrame:
    """mapInArrow with `work` over the batches in bounded steps."""

    def run(batches):
        for batch in batches:
            for step in steps(batch, text):
                yield work(step)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; a missing one is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
