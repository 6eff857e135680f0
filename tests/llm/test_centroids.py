"""Clustering against SQL and against plain Python; the filter against measuring everything."""

import hashlib
import math

import corpora
import numpy as np
import pytest
import sql

from hearthline.llm import centroids


@pytest.mark.parametrize("sf_dir", [corpora.SMALL, "awkward", "nothing"])
def test_equals_its_sql(spark, request, sf_dir):
    sf_dir = sf_dir if sf_dir.startswith("/") else request.getfixturevalue(sf_dir)
    ours, theirs = sql.both(spark, centroids.op12_centroids, centroids.ORACLE, sf_dir)
    assert ours == theirs


def plain(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(64 * x) <= 2**26 for x in v)]
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, p) for i, p in kept)
    centre = [p for *_, p in named[:k]]
    for r in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), n) for n, c in enumerate(centre)) for _, p in kept]
        for n in range(len(centre)) if r < rounds else ():
            if own := [p for (_, p), (_, m) in zip(kept, found, strict=True) if m == n]:
                centre[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, n, d, hashlib.sha256(",".join(map(str, centre[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, found, strict=True)]


def test_equals_plain_python_on_awkward_vectors(spark, awkward):
    rows = centroids.op12_centroids(spark, awkward).collect()
    theirs = plain(corpora.VECTORS)
    assert sorted(map(str, ((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in rows))) == sorted(map(str, theirs))
    assert {r["inertia"] for r in rows} == {sum(d for _, _, d, _ in theirs)}
    assert 70 in {r["vec_id"] for r in rows} and not {61, 62, 63, 64, 65, 66, 67, 68, 69} & {r["vec_id"] for r in rows}


def test_fewer_vectors_than_centroids(spark, tmp_path):
    rows = centroids.op12_centroids(spark, corpora.write(tmp_path, [], embeddings=[(i, [float(i)] * 64, 0) for i in range(3)])).collect()
    assert {r["cluster"] for r in rows} == {0, 1, 2} and {r["distance"] for r in rows} == {0}


@pytest.mark.parametrize("spread", [1, 1000, 1 << 24])
def test_filter_loses_no_centroid_and_skips_many(spread):
    deal = np.random.default_rng(5)
    centre = deal.integers(-spread, spread + 1, (16, 64))
    x = centre[deal.integers(0, 16, 3000)] + deal.integers(-1 - spread // 8, 2 + spread // 8, (3000, 64))
    x[:50] = (centre[0] + centre[1]) // 2  # ties and near ties
    axes = np.linalg.qr(deal.normal(size=(64, 64)))[0]
    mean = x.mean(0)
    brief = [centroids.short(v.astype(float), mean, axes, 16) for v in (x, centre)]
    best, distance, measured = centroids.nearest(x, brief[0], centre, brief[1])
    every = ((x[:, None, :] - centre[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert spread == 1 or measured.mean() < 8


def test_only_sums_come_back(spark):
    """A round's plan brings one row per centroid and component to the driver, combined before the shuffle."""
    found, final, inertia = centroids.clustered(spark.read.parquet(f"{corpora.SMALL}/embeddings.parquet"))
    assert final.shape == (16, 64) and len(inertia) == 16
    assert "Exchange" not in corpora.plan(found)
    assert found.agg({"measured": "avg"}).first()[0] < 5
