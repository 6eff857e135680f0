"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.tables import keep


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least vertex around: the greater ones (large), or the lesser ones and oneself.

    edges: (u, v) with u > v. A vertex's neighbours are never gathered: the least is a combined aggregate
    that is joined back.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every vertex with an edge to another one; the label is the least id of its component.

    edges: (a, b), any order, repeats and loops allowed, ids of one orderable type. Each round is written to
    the shared folder. A round ends the loop when it changes nothing.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") > F.col("v")).distinct()
    size = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    edges = keep(edges)
    state = edges.agg(*size).first()
    while state[0]:
        edges = keep(_stars(_stars(edges, large=True), large=False))
        new = edges.agg(*size).first()
        if new == state:
            break
        state = new
    labels = edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return labels.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
