"""Shards by extendible hashing: a directory of hash prefixes in which only oversized buckets are split.

A row's bits are those of the MD5 of its key and content. A bucket is a prefix of bits; it is split on its next
bit until what it holds fits the byte limit. The directory comes from a histogram of bytes per prefix a few
bits longer than the shards need; prefixes that are still too large get a longer one of their own rows. So rows
of one key are spread like any others, and only rows that are equal in every hashed column stay together.
Where such a group alone is over the limit, it is counted and dealt to numbered overflow pages. A row that
alone is over the limit has a shard for itself.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.tables import keep, table

#: Bits of a row's hash: 15 hexadecimal digits.
BITS = 60
#: Bits by which the histogram is finer than shards of the limit.
FINER = 4
LIMIT = 64 << 20
#: The limit of the directory query.
SMALL = 256 << 10


def bits(*columns: str) -> Column:
    """A row's hash as a string of 0 and 1; missing values count as empty strings."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.lpad(F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 2), BITS, "0")


def _prefix(column: str, depth: int) -> Column:
    return F.substring(column, 1, depth)


def buckets(cells: DataFrame, known: int, depth: int, limit: int) -> DataFrame:
    """(cell, shard, depth) for cells (cell, bytes) of `depth` bits: the shortest prefix of `known` bits at least that
    fits, or, for a cell that doesn't fit itself, NULL. Cells without rows may be among them.

    A prefix is a shard if it fits and the one without its last bit doesn't. Sums are combined before they are
    shuffled, a sum meets its parent's by a key of two rows, and a shard names its cells by counting them up.
    """
    opened = cells.select("bytes", F.explode(F.sequence(F.lit(known), F.lit(depth))).alias("depth"), "cell")
    sums = opened.groupBy("depth", F.expr("substring(cell, 1, depth)").alias("prefix")).agg(F.sum("bytes").alias("held"))
    parents = sums.where(F.col("held") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    fitting = sums.where(F.col("held") <= limit).withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))
    split = fitting.where(F.col("depth") > known).join(parents, ["depth", "parent"], "left_semi")
    leaves = split.select("prefix", "depth").unionByName(fitting.where(F.col("depth") == known).select("prefix", "depth"))
    rest = F.lit(depth) - F.col("depth")
    below = leaves.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), rest).cast("long") - 1)))
    tail = F.when(rest > 0, F.lpad(F.bin("k"), rest, F.lit("0"))).otherwise("")
    named = below.select(F.concat("prefix", tail).alias("cell"), F.col("prefix").alias("shard"), "depth")
    return named.unionByName(cells.where(F.col("bytes") > limit).selectExpr("cell", "cast(NULL AS string) AS shard", "cast(NULL AS int) AS depth"))


def sharded(df: DataFrame, hashed: list[str], size: Column, limit: int = LIMIT) -> DataFrame:
    """df with `shard` (a prefix of bits; "-k" after it for overflow page k) and `depth` (its bits).

    size: bytes of a row, 1 at least. `hashed` names key and content. Columns named shard or depth are replaced.
    Rows come back as often as they were, a page's copies together. Columns must allow grouping (no maps).
    """
    names = [c for c in df.columns if c not in ("shard", "depth")]
    columns = [f"c{i}" for i in range(len(names))]  # no name of df meets one used here
    given = [F.col(f"`{name}`").alias(c) for name, c in zip(names, columns, strict=True)]
    rows = df.select(*given, bits(*hashed).alias("_bits"), F.greatest(size, F.lit(1)).cast("long").alias("_size"))
    large = rows.where(F.col("_size") > limit)
    rest = rows.where(F.col("_size") <= limit)
    total = rest.agg(F.sum("_size")).first()[0] or 0
    known, depth = 0, min(BITS, max(0, ceil(log2(max(1, total / limit)))) + FINER)
    out = None
    while True:
        cells = keep(rest.groupBy(_prefix("_bits", depth).alias("cell")).agg(F.sum("_size").alias("bytes")))
        directory = keep(buckets(cells, known, depth, limit))
        placed = rest.withColumn("_cell", _prefix("_bits", depth)).join(directory, F.col("_cell") == F.col("cell")).drop("_cell", "cell")
        fitting = placed.where(F.col("shard").isNotNull())
        out = fitting if out is None else out.unionByName(fitting)
        rest = placed.where(F.col("shard").isNull()).select(*columns, "_bits", "_size")
        if directory.where("shard IS NULL").isEmpty():
            break
        if depth == BITS:
            out = out.unionByName(_pages(rest, columns, limit))
            break
        known, depth = depth + 1, min(BITS, depth + 2 * FINER)
    out = out.unionByName(_pages(large, columns, limit))
    return out.select(*[F.col(c).alias(name) for c, name in zip(columns, names, strict=True)], "shard", "depth")


def _pages(equal: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Groups of equal rows dealt to pages that fit (one row at least): counted, then opened page by page."""
    counted = equal.groupBy(*columns, "_bits", "_size").agg(F.count("*").alias("_n"))
    room = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("_size")))
    pages = counted.withColumn("_room", room).withColumn("_page", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / F.col("_room")))))
    held = F.least(F.col("_room"), F.col("_n") - F.col("_page") * F.col("_room")).cast("int")
    dealt = pages.withColumn("_held", held).repartition("_bits", "_page")
    copies = dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_held"))))
    name = F.concat_ws("-", "_bits", F.col("_page").cast("string"))
    return copies.select(*columns, "_bits", "_size", name.alias("shard"), F.lit(BITS).alias("depth"))


def write_shards(df: DataFrame, path: str, hashed: list[str], size: Column, limit: int = LIMIT) -> None:
    """One folder `shard=...` per shard, each written by one task."""
    sharded(df, hashed, size, limit).repartition("shard").write.partitionBy("shard").parquet(path)


def op1_extendible_shards(spark: SparkSession, sf_dir: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8, and a line end), shard, depth for every document, in shards of 64 MiB at most.

    A missing text is empty; equal rows are interchangeable. No documents: no rows.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = docs.select("doc_id", "text", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("n_bytes"))
    return sharded(rows, ["doc_id", "text"], F.col("n_bytes"), limit).select("doc_id", "n_bytes", "shard", "depth")


def shard_directory(spark: SparkSession, sf_dir: str, limit: int = SMALL) -> DataFrame:
    """The directory of shards of 256 KiB at most, as small tables fill several: shard, depth, n_docs, n_bytes per shard.

    Sums over op1_extendible_shards, so of its rows each is in one shard. No documents: no shards.
    """
    rows = op1_extendible_shards(spark, sf_dir, limit)
    return rows.groupBy("shard", "depth").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))


def oracle(limit: int) -> str:
    """Without overflow pages: distinct rows of the limit at most."""
    return f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS n_bytes,
    to_base(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 15) AS BIGINT), 2, {BITS}) AS bits
  FROM documents
), prefixes AS (
  SELECT substr(bits, 1, d) AS prefix, d, sum(n_bytes) AS held
  FROM rows, (SELECT unnest(generate_series(0, 30)) AS d) GROUP BY ALL
), leaf AS (
  SELECT bits, min(d) AS depth FROM rows JOIN prefixes ON prefix = substr(bits, 1, d) WHERE held <= {limit} GROUP BY bits
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, substr(bits, 1, depth) AS shard, CAST(depth AS INTEGER) AS depth
FROM rows JOIN leaf USING (bits)
"""


ORACLE = oracle(LIMIT)
DIRECTORY_ORACLE = f"""
SELECT shard, depth, count(*) AS n_docs, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM ({oracle(SMALL)}) GROUP BY shard, depth
"""
