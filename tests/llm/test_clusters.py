"""Yinyang rounds against plain rounds of nearest centroids, in whole numbers."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from tidewright.llm import yinyang


def plain(rows, k, rounds, seed, scale, dim):
    """id, cluster, distance for each kept row, and the final centroids; nothing is skipped."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]
        if turn == rounds:
            return [(i, n, d) for (i, _), (d, n) in zip(kept, found, strict=True)], centroids
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, found, strict=True) if m == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]


def cloud(draw, n, dim, blobs, spread=0.2):
    middles = draw.normal(0, 1, (blobs, dim))
    return [(k, (middles[k % blobs] + draw.normal(0, spread, dim)).astype(np.float32).tolist()) for k in range(n)]


CASES = {
    "blobs": lambda draw: cloud(draw, 400, 6, 12),
    "ties on a grid": lambda draw: [(k, [float(x) for x in draw.integers(-1, 2, 6)]) for k in range(300)],
    "one hot vector": lambda draw: cloud(draw, 150, 6, 5) + [(1000 + k, [0.5] * 6) for k in range(200)],
    "repeated and null identifiers": lambda draw: [(None if k % 7 == 0 else k % 20, v) for k, v in cloud(draw, 120, 6, 4)],
    "fewer than centroids": lambda draw: cloud(draw, 9, 6, 3),
    "large components": lambda draw: [(k, (draw.normal(0, 1, 6) * 400_000).tolist()) for k in range(120)],
    "what is left out": lambda draw: cloud(draw, 60, 6, 3) + [(70, None), (71, []), (72, [1.0] * 5), (73, [1.0] * 7), (74, [None, *[1.0] * 5]), (75, [float("nan")] * 6), (76, [float("inf")] * 6)],
    "nothing": lambda draw: [],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_equals_plain_rounds(spark, name):
    rows = CASES[name](np.random.default_rng(3))
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int").repartition(3)
    got = yinyang.clustered(df, dim=6, k=25, rounds=4).collect()
    want, centroids = plain(rows, 25, 4, 2, 256.0, 6) if rows else ([], [])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    sums = {c: sum(d for _, m, d in want if m == c) for c in range(len(centroids))}
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_bounds_spare_distances(spark):
    """On separated blobs most vectors are never held against most centroids after the first scan."""
    rows = cloud(np.random.default_rng(5), 3000, 16, 20, 0.05)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scans = [r.scans for r in yinyang.clustered(df, dim=16, k=40, rounds=5).collect()]
    assert 3000 * 40 <= sum(scans) < 3000 * 40 * 6 * 0.5


def test_both_ways_of_counting_agree():
    draw = np.random.default_rng(1)
    points, centroids = draw.integers(-(2**20), 2**20, (50, 64)), draw.integers(-(2**20), 2**20, (7, 64))
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c, strict=True)) for c in centroids] for p in points]
    assert yinyang.squared(points, centroids).tolist() == exact
    assert yinyang.squared(points * 100, centroids * 100).tolist() == [[d * 10_000 for d in row] for row in exact]


def test_groups_hold_every_centroid_once():
    centroids = np.random.default_rng(2).integers(-300, 300, (40, 8))
    groups = yinyang.grouped(centroids)
    assert sorted(np.concatenate(groups).tolist()) == list(range(40)) and all(len(g) for g in groups)
    assert [g.tolist() for g in yinyang.grouped(np.zeros((3, 8), np.int64))] == [[0, 1, 2]]


def test_components_too_large_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 64), (2, [0.0] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="squared distances would not fit"):
        yinyang.clustered(df).collect()
