"""Centroid clustering of integer vectors with a PCA-rotated filter.

The vectors' second moments are summed in the tasks; their eigenvectors rotate the space so that the leading
coordinates hold most of the spread. Each vector is stored with as many leading rotated coordinates as hold the
share `held` of the spread, and the norm of the rest. By the triangle inequality the squared distance to a centroid is at least the squared distance
of the leading coordinates plus the squared difference of the rest's norms. The centroid whose bound is least is
measured in integers first; of the others only those whose bound doesn't exceed that distance. So rotation and
floating point decide how much is measured, never the result.

A round sends the centroids (k rows) to the tasks, and brings back one sum per centroid and partition, combined
by Spark.

Definitions: kept are vectors with exactly `dims` components, none NULL, NaN or infinite, whose integers lie
within 2^26 of zero (beyond, squared distances don't fit a long). A kept vector without a vec_id counts as any
other and hashes as the empty string. Repeated rows are vectors of their own, also as first centroids, where equal
hashes are ordered by vec_id and components. Fewer vectors than centroids: as many centroids as vectors. Ties go
to the smaller number, and a centroid without vectors stays where it is. No vectors, no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.tables import keep, ship, table


@dataclass(frozen=True)
class Settings:
    """`scale`: components are multiplied by it and rounded down. `held`: share of the spread that the stored rotated
    coordinates hold."""

    dims: int = 64
    scale: int = 64
    clusters: int = 16
    rounds: int = 3
    held: float = 0.9
    seed: int = 1


#: Integers beyond it aren't clustered.
MOST = 1 << 26
#: Vectors that an Arrow map works on at once.
ROWS = 4096


def integers(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, point (array<int>) of the vectors that are kept."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * settings.scale))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * settings.scale) <= MOST))
    good = (F.size("embedding") == settings.dims) & whole
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(good)
    return rows.select("vec_id", scaled.cast("array<int>").alias("point"))


def first_centroids(points: DataFrame, settings: Settings) -> np.ndarray:
    """The vectors whose hashes are least: `clusters` rows come to the driver."""
    name = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.select(name.alias("name"), "vec_id", "point").orderBy("name", "vec_id", "point").limit(settings.clusters).collect()
    return np.array([r["point"] for r in rows], np.int64).reshape(-1, settings.dims)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(column)).reshape(-1, dims)


def _mapped(df: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow over steps of ROWS rows; work yields batches."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield from work(batch.slice(at, ROWS))

    return df.mapInArrow(run, schema)


def _summed(df: DataFrame, start, add, rows, schema: str) -> DataFrame:
    """One state per partition: add(state, batch) for each step, then rows(state) as a batch."""
    ship(df.sparkSession)

    def run(batches):
        state = start()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                state = add(state, batch.slice(at, ROWS))
        yield rows(state)

    return df.mapInArrow(run, schema)


def rotation(points: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, rotation (columns by falling spread) and number of leading coordinates, from all points; dims * dims
    numbers come to the driver."""
    d = settings.dims

    def add(state, batch):
        x = matrix(batch.column("point"), d).astype(float)
        return state[0] + len(x), state[1] + x.sum(0), state[2] + x.T @ x

    def rows(state):
        flat = np.concatenate(([state[0]], state[1], state[2].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    parts = _summed(points.select("point"), lambda: (0, np.zeros(d), np.zeros((d, d))), add, rows, "i int, v double")
    flat = np.zeros(1 + d + d * d)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[r["i"]] = r["v"]
    n = max(flat[0], 1.0)
    mean = flat[1 : d + 1] / n
    spread, axes = np.linalg.eigh(flat[d + 1 :].reshape(d, d) / n - np.outer(mean, mean))
    share = np.cumsum(spread[::-1].clip(0))
    lead = int(np.searchsorted(share, settings.held * share[-1])) + 1
    return mean, np.ascontiguousarray(axes[:, ::-1]), min(lead, d)


def short(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, lead: int) -> np.ndarray:
    """The leading rotated coordinates and the norm of the rest, in single precision."""
    turned = (x - mean) @ axes
    return np.concatenate([turned[:, :lead], np.sqrt((turned[:, lead:] ** 2).sum(1, keepdims=True))], 1).astype(np.float32)


def rotated(points: DataFrame, mean: np.ndarray, axes: np.ndarray, lead: int, settings: Settings) -> DataFrame:
    """points with `short`, the coordinates that the filter reads."""
    d = settings.dims

    def work(batch):
        x = short(matrix(batch.column("point"), d).astype(float), mean, axes, lead)
        size = pa.array(np.arange(len(x) + 1) * (lead + 1), pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(size, pa.array(x.ravel()))], ["vec_id", "point", "short"])

    return _mapped(points, work, "vec_id long, point array<int>, short array<float>")


def nearest(x: np.ndarray, brief: np.ndarray, centroids: np.ndarray, centroids_brief: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per vector its centroid, the squared distance, and how many centroids were measured.

    brief: rows of short(). Single precision moves a bound by less than 5e-7 of both squared norms; the margin is
    twice that.
    """
    brief, centroids_brief = brief.astype(float), centroids_brief.astype(float)
    own, other = (brief * brief).sum(1), (centroids_brief * centroids_brief).sum(1)
    bound = own[:, None] + other[None] - 2.0 * (brief @ centroids_brief.T)
    margin = 1e-6 * (own[:, None] + other[None] + 1.0)
    best = bound.argmin(1)
    rows = np.arange(len(x))
    gap = x - centroids[best]
    distance = (gap * gap).sum(1)
    left = bound - margin <= distance[:, None]
    left[rows, best] = False
    measured = 1 + left.sum(1)
    row, centroid = np.nonzero(left)
    gap = x[row] - centroids[centroid]
    every = np.full(left.shape, np.iinfo(np.int64).max)
    every[rows, best] = distance
    every[row, centroid] = (gap * gap).sum(1)
    best = every.argmin(1)  # the first of equal ones
    return best, every[rows, best], measured


def _found(batch: pa.RecordBatch, settings: Settings, centroids: np.ndarray, brief: np.ndarray):
    x = matrix(batch.column("point"), settings.dims).astype(np.int64)
    return x, *nearest(x, matrix(batch.column("short"), brief.shape[1]), centroids, brief)


def totals(points: DataFrame, centroids: np.ndarray, brief: np.ndarray, settings: Settings) -> tuple[list[int], list[list[int]], list[int]]:
    """Per centroid the number of its vectors, their sum and their distances' sum, as exact integers."""
    k, d = len(centroids), settings.dims

    def add(state, batch):
        x, best, distance, _ = _found(batch, settings, centroids, brief)
        value = np.concatenate([np.ones((len(x), 1), np.int64), x, (distance >> 31)[:, None], (distance & 0x7FFFFFFF)[:, None]], 1)
        step = np.zeros((k, d + 3), np.int64)
        np.add.at(step, best, value)
        return state + step.astype(object)  # whole numbers of any size

    def rows(state):
        text = [str(v) for v in state.ravel().tolist()]
        at = np.arange(k * (d + 3))
        return pa.RecordBatch.from_arrays([pa.array(at // (d + 3), pa.int32()), pa.array(at % (d + 3), pa.int32()), pa.array(text, pa.string())], ["centroid", "i", "v"])

    parts = _summed(points.select("point", "short"), lambda: np.zeros((k, d + 3), object), add, rows, "centroid int, i int, v string")
    sums = [[0] * (d + 3) for _ in range(k)]
    for r in parts.groupBy("centroid", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        sums[r["centroid"]][r["i"]] = int(r["v"])
    return [s[0] for s in sums], [s[1 : d + 1] for s in sums], [(s[d + 1] << 31) + s[d + 2] for s in sums]


def clustered(vectors: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, np.ndarray, list[int]]:
    """vec_id, point, cluster, distance, measured per kept vector; the final centroids, and the distances' sum of each."""
    points = integers(vectors, settings)
    centroids = first_centroids(points, settings)
    mean, axes, lead = rotation(points, settings)
    points = keep(rotated(points, mean, axes, lead, settings))

    def brief() -> np.ndarray:
        return short(centroids.astype(float), mean, axes, lead)

    for _ in range(settings.rounds if len(centroids) else 0):
        count, sums, _ = totals(points, centroids, brief(), settings)
        moved = [[v // n for v in s] if n else old for n, s, old in zip(count, sums, centroids.tolist(), strict=True)]
        centroids = np.array(moved, np.int64)
    inertia = totals(points, centroids, brief(), settings)[2] if len(centroids) else []

    def work(batch, own=centroids, brief=brief()):
        _, best, distance, measured = _found(batch, settings, own, brief)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("point"), pa.array(best, pa.int32()), pa.array(distance, pa.int64()), pa.array(measured, pa.int32())],
            ["vec_id", "point", "cluster", "distance", "measured"],
        )

    found = _mapped(points, work, "vec_id long, point array<int>, cluster int, distance long, measured int")
    return found, centroids, inertia


def _by_cluster(values: list, kind: str) -> Column:
    return F.element_at(F.expr(f"cast(array({', '.join(values)}) as array<{kind}>)"), F.col("cluster") + 1)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector with its cluster. A sum of distances that doesn't fit a long is NULL."""
    found, centroids, inertia = clustered(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    named = [f"'{hashlib.sha256(','.join(map(str, c)).encode()).hexdigest()}'" for c in centroids.tolist()]
    fitting = [str(v) if v < 1 << 63 else "NULL" for v in (*inertia, sum(inertia))]
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        _by_cluster(fitting[:-1], "bigint").alias("cluster_inertia"),
        F.expr(f"cast({fitting[-1]} as bigint)").alias("inertia"),
        _by_cluster(named, "string").alias("centroid_sha256"),
    )


def _oracle(rounds: int = 3) -> str:
    steps = [
        """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(64 * CAST(x AS DOUBLE)) > 67108864)) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), vec_id NULLS FIRST, p) - 1 AS cluster, p AS c FROM kept
  QUALIFY cluster < 16
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""
, a{i} AS MATERIALIZED (
  SELECT r, min_by(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
  FROM (SELECT r, cluster, CAST(list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance FROM kept, c{i})
  GROUP BY r
)""")
        if i < rounds:
            steps.append(f"""
, m{i} AS (
  SELECT cluster, list(v ORDER BY i) AS c
  FROM (SELECT cluster, i, CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) AS v
    FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n
      FROM (SELECT cluster, unnest(p) AS x, unnest(generate_series(1, 64)) AS i FROM a{i} JOIN kept USING (r)) GROUP BY cluster, i))
  GROUP BY cluster
), c{i + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster)
)""")
    return "".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (cluster)
"""


ORACLE = _oracle()
