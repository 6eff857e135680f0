"""Merkle fixity audit of WARC replicas.

Records are hashed, and so are the ordered ranges of offsets that they start in, and groups of `fan` such ranges,
up to one root per file. Replicas are compared by their roots; below a root that differs only the children
of nodes that differ are looked at, down to the records.

Trees are aggregates over (replica, file, node): at most `fan` nodes, or the records that start within
`range_bytes`, meet in one group.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearthline.llm.tables import keep, table


@dataclass(frozen=True)
class Settings:
    """`file_bytes`: about how much a file of an archive holds. One record in `damage` (0: none) of the second replica
    is changed, one is cut, and one is lost, by the MD5 of its page_id."""

    file_bytes: int = 256 << 20
    range_bytes: int = 64 << 10
    fan: int = 16
    damage: int = 100


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record as text; its bytes are the UTF-8 of it."""
    body = F.coalesce(html, F.lit(""))
    head = F.format_string(
        "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%s>\r\nWARC-Target-URI: %s\r\nContent-Length: %d\r\n\r\n",
        F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), F.octet_length(body),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def replicas(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """replica ('a', 'b'), file, offset, page_id, length, digest of each record of an archive and its damaged copy.

    A record's file comes from the hash of its id and content, so pages of one host or id are spread; within a file
    records lie in order of page_id and digest. The copy's records keep their offsets.
    """
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    kind = _number(F.coalesce(F.col("page_id").cast("string"), F.lit(""))) % settings.damage if settings.damage else F.lit(-1)
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    copy = F.when(kind == 0, F.concat(F.lit("#"), F.expr("substring(text, 2)"))).when(kind == 1, half).when(kind != 2, F.col("text"))
    rows = pages.select("page_id", text.alias("text"), kind.alias("kind")).withColumn("copy", copy)
    rows = rows.select(
        "page_id",
        F.octet_length("text").cast("long").alias("length"),
        F.sha2("text", 256).alias("digest"),
        F.octet_length("copy").cast("long").alias("copy_length"),
        F.sha2("copy", 256).alias("copy_digest"),
    )
    rows = keep(rows)
    total = rows.agg(F.sum("length")).first()[0] or 0
    files = max(1, ceil(total / settings.file_bytes))
    name = F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest")
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)  # a file
    laid = rows.withColumn("file", _number(name) % files).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    one = F.struct(F.lit("a").alias("replica"), "length", "digest")
    other = F.struct(F.lit("b").alias("replica"), F.col("copy_length").alias("length"), F.col("copy_digest").alias("digest"))
    both = laid.select("file", "offset", "page_id", F.explode(F.array(one, other)).alias("r"))
    return both.select("r.replica", "file", "offset", "page_id", "r.length", "r.digest").where("digest IS NOT NULL")


def _hash(rows: DataFrame, node: Column, item: Column) -> DataFrame:
    """(replica, file, node, hash): the hash of a node's items in their order."""
    grouped = rows.groupBy("replica", "file", node.alias("node")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    line = F.transform("items", lambda x: F.concat_ws(":", x["at"].cast("string"), x["length"].cast("string"), x["digest"]))
    return grouped.select("replica", "file", "node", F.sha2(F.array_join(line, "\n"), 256).alias("hash"))


def tree(records: DataFrame, settings: Settings = Settings()) -> list[DataFrame]:
    """(replica, file, node, hash) per level, from ranges of offsets up to the files' roots."""
    node = F.floor(F.col("offset") / settings.range_bytes)
    levels = [keep(_hash(records, node, F.struct(F.col("offset").alias("at"), "length", "digest")))]
    widest = levels[0].agg(F.max("node")).first()[0] or 0
    while widest:
        item = F.struct(F.col("node").alias("at"), F.lit(0).alias("length"), F.col("hash").alias("digest"))
        levels.append(_hash(levels[-1], F.floor(F.col("node") / settings.fan), item))
        widest //= settings.fan
    return levels


def _differing(nodes: DataFrame) -> DataFrame:
    hashes = [F.max(F.when(F.col("replica") == r, F.col("hash"))).alias(r) for r in "ab"]
    return nodes.groupBy("file", "node").agg(*hashes).where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node")


def audit(records: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """file, offset, page_id, kind (changed, missing, extra), length and digest of both replicas, for each record
    in which the replicas differ. records: as replicas() gives them."""
    levels = tree(records, settings)
    differing = _differing(levels[-1])
    for level in reversed(levels[:-1]):
        parents = differing.select("file", F.col("node").alias("parent"))
        children = level.withColumn("parent", F.floor(F.col("node") / settings.fan)).join(parents, ["file", "parent"], "left_semi")
        differing = _differing(children)
    inside = records.withColumn("node", F.floor(F.col("offset") / settings.range_bytes)).join(differing, ["file", "node"], "left_semi")
    sides = [F.max(F.when(F.col("replica") == r, F.struct("length", "digest"))).alias(r) for r in "ab"]
    pairs = inside.groupBy("file", "offset", "page_id").agg(*sides).where(~F.col("a").eqNullSafe(F.col("b")))
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    columns = [F.col(f"{r}.{c}").alias(f"{c}_{r}") for r in "ab" for c in ("length", "digest")]
    return pairs.select("file", "offset", "page_id", kind.alias("kind"), *columns)


def op6_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the pages' archive that its damaged replica lacks or holds otherwise.

    Missing urls and bodies are empty, and so is a missing page_id in the record's id. Repeated rows are records of
    their own, one after another. A record of any length is hashed whole. No pages: no rows.
    """
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return audit(keep(replicas(pages)))


ORACLE = f"""
WITH texts AS (
  SELECT page_id, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>',
      chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10),
      chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS t,
    CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 15) AS BIGINT) % {Settings.damage} AS kind
  FROM pages
), rows AS (
  SELECT page_id, strlen(t) AS length_a, sha256(t) AS digest_a, kind,
    CASE kind WHEN 0 THEN '#' || substr(t, 2) WHEN 1 THEN substr(t, 1, length(t) // 2) WHEN 2 THEN NULL ELSE t END AS copy
  FROM texts
), filed AS (
  SELECT *, CAST('0x' || substr(md5(page_id || '/' || digest_a), 1, 15) AS BIGINT)
    % greatest(1, CAST(ceil((SELECT sum(length_a) FROM rows) / {Settings.file_bytes}) AS BIGINT)) AS file
  FROM rows
), laid AS (
  SELECT *, coalesce(sum(length_a) OVER (PARTITION BY file ORDER BY page_id, digest_a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs
  FROM filed
)
SELECT file, CAST(offs AS BIGINT) AS "offset", page_id, CASE kind WHEN 2 THEN 'missing' ELSE 'changed' END AS kind,
  CAST(length_a AS BIGINT) AS length_a, digest_a, CAST(strlen(copy) AS BIGINT) AS length_b, sha256(copy) AS digest_b
FROM laid WHERE kind < 3
"""
