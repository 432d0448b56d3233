"""Centroid clustering of integer vectors by Yinyang grouping, equal to plain rounds of nearest centroids.

Centroids are dealt into groups once.  Each vector carries an upper bound of the distance to its own centroid and, for
each group, one lower bound of the distances to the group's other centroids.  When centroids move, the bounds move by as
much, and a vector whose upper bound lies below all its lower bounds keeps its centroid unread (the global filter); of
the others, only groups whose bound does not lie above are scanned, exactly.  Bounds are rounded outwards and compare
strictly, so ties go by the number of the centroid as in the plain rounds.

A round reads the table of vectors and bounds and writes the next one, without a shuffle.  New centroids come from exact
integer sums that only the vectors which changed their centroid add to, combined in each task before they are shuffled;
k centroids are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import new_folder, removed

#: Centroids in a group, about.
GROUP = 10
#: Rounds in which the first centroids are grouped.
GROUPING_ROUNDS = 5
#: Bounds are kept in steps of 1 / STEPS.
STEPS = 1024.0
STATE = "id {id}, v array<int>, was int, cluster int, upper double, lower array<double>, distance long, scans long"


def reach(dim: int) -> int:
    """Largest size of a component for which squared distances of so many components fit a long."""
    return min(2**31 - 1, isqrt((2**63 - 1) // (4 * max(1, dim))))


def upwards(x: np.ndarray) -> np.ndarray:
    return (np.floor(x * STEPS) + 2) / STEPS


def downwards(x: np.ndarray) -> np.ndarray:
    return (np.ceil(x * STEPS) - 2) / STEPS


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every centroid, from int64 components."""
    far = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * points.shape[1] * far * far < 2**53:  # every intermediate result is a whole number that a double holds
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([between(points, c) for c in centroids], axis=1)


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of a to the same row of b."""
    return ((a - b) ** 2).sum(axis=1)


@dataclass
class Centroids:
    at: np.ndarray  # k x dim, int64
    groups: list[np.ndarray]  # numbers of the centroids of each group, ascending
    drift: np.ndarray  # how far each has moved since the last assignment, rounded up

    @property
    def group_of(self) -> np.ndarray:
        out = np.zeros(len(self.at), np.int64)
        for g, members in enumerate(self.groups):
            out[members] = g
        return out


def grouped(centroids: np.ndarray) -> list[np.ndarray]:
    """The centroids in groups of about GROUP near ones; no group is empty."""
    n = max(1, -(-len(centroids) // GROUP))
    middles = centroids[:: max(1, len(centroids) // n)][:n].astype(np.float64)
    for _ in range(GROUPING_ROUNDS):
        own = ((centroids[:, None, :] - middles[None]) ** 2).sum(axis=2).argmin(axis=1)
        middles = np.stack([centroids[own == g].mean(axis=0) if (own == g).any() else middles[g] for g in range(n)])
    return [m for g in range(n) if len(m := np.flatnonzero(own == g))]


def assigned_first(points: np.ndarray, known: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each point by a full scan: cluster, squared distance, upper and lower bounds, distances computed."""
    all_of = squared(points, known.at)
    cluster = all_of.argmin(axis=1)
    row = np.arange(len(points))
    best = all_of[row, cluster]
    others = np.sqrt(all_of.astype(np.float64))
    others[row, cluster] = np.inf
    lower = np.stack([downwards(others[:, m].min(axis=1)) for m in known.groups], axis=1)
    return cluster, best, upwards(np.sqrt(best.astype(np.float64))), lower, np.full(len(points), len(known.at))


def assigned_again(points: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, known: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same after the centroids moved, from the bounds of the last assignment; the squared distance is -1 where none was computed."""
    upper = upwards(upper + known.drift[cluster])
    lower = downwards(lower - np.array([known.drift[m].max() for m in known.groups]))
    best, scans, to = np.full(len(points), -1), np.zeros(len(points), np.int64), cluster.copy()
    rest = np.flatnonzero(~(lower.min(axis=1) > upper))
    best[rest] = between(points[rest], known.at[cluster[rest]])
    scans[rest] += 1
    upper[rest] = upwards(np.sqrt(best[rest].astype(np.float64)))
    rest = rest[~(lower[rest].min(axis=1) > upper[rest])]
    own, group_of = best[rest].copy(), known.group_of
    scanned = np.zeros((len(rest), len(known.groups)), bool)
    firsts = np.zeros((len(rest), len(known.groups)), np.int64)
    nearest, second = np.full(firsts.shape, np.inf), np.full(firsts.shape, np.inf)
    for g, members in enumerate(known.groups):
        place = np.flatnonzero(~(lower[rest, g] > upper[rest]))
        if not len(place):
            continue
        rows = rest[place]
        found = squared(points[rows], known.at[members])
        scans[rows] += len(members)
        at = found.argmin(axis=1)
        first = found[np.arange(len(rows)), at]
        scanned[place, g], firsts[place, g] = True, members[at]
        nearest[place, g] = first
        found[np.arange(len(rows)), at] = np.iinfo(np.int64).max
        if len(members) > 1:
            second[place, g] = found.min(axis=1)
        closer = (first < best[rows]) | ((first == best[rows]) & (members[at] < to[rows]))
        best[rows[closer]], to[rows[closer]] = first[closer], members[at[closer]]
        upper[rows] = upwards(np.sqrt(best[rows].astype(np.float64)))
    for g in range(len(known.groups)):
        on = scanned[:, g]
        other = np.where(firsts[on, g] == to[rest[on]], second[on, g], nearest[on, g])
        lower[rest[on], g] = downwards(np.sqrt(other))
        left = ~on & (group_of[cluster[rest]] == g) & (to[rest] != cluster[rest])  # the old centroid is one of the others now
        lower[rest[left], g] = np.minimum(lower[rest[left], g], downwards(np.sqrt(own[left].astype(np.float64))))
    return to, best, upper, lower, scans


def with_assignment(state: DataFrame, known: Centroids, dim: int, first: bool, last: bool) -> DataFrame:
    """The next state of every vector; last: with its exact squared distance."""
    sent = state.sparkSession.sparkContext.broadcast(known)  # k x dim numbers
    most = reach(dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sent.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            points = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dim)
            if np.abs(points).max(initial=0) > most:
                raise ValueError(f"a component is beyond {most} after scaling: squared distances would not fit a long")
            if first:
                was, scans = pa.nulls(n, pa.int32()), np.zeros(n, np.int64)
                cluster, best, upper, lower, more = assigned_first(points, now)
            else:
                was, scans = batch.column("cluster"), batch.column("scans").to_numpy()
                held = batch.column("lower").flatten().to_numpy().reshape(n, len(now.groups))
                cluster, best, upper, lower, more = assigned_again(points, was.to_numpy().astype(np.int64), batch.column("upper").to_numpy(), held, now)
            if last:
                open_ = np.flatnonzero(best < 0)
                best[open_] = between(points[open_], now.at[cluster[open_]])
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * lower.shape[1]), pa.array(lower.ravel()))
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(points.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), values, was, pa.array(cluster.astype(np.int32)), pa.array(upper), bounds, pa.array(best), pa.array(scans + more)],
                names=["id", "v", "was", "cluster", "upper", "lower", "distance", "scans"],
            )

    return state.mapInArrow(assign, STATE.format(id=state.schema["id"].dataType.simpleString()))


def changes(state: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the vectors that changed their centroid add to and take from the sums: numbers, counts, sums of components."""
    sides = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("s")))
    moved = state.where(~F.col("was").eqNullSafe(F.col("cluster"))).select(F.explode(sides).alias("side"), "v").where("side.c IS NOT NULL")
    sums = moved.groupBy("side.c").agg(F.sum("side.s").alias("n"), *[F.sum(F.col("side.s").cast("long") * F.col("v")[i]).alias(f"v{i}") for i in range(dim)])
    rows = sums.collect()  # one for each centroid at most
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2:] for r in rows], np.int64).reshape(len(rows), dim)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: float) -> DataFrame:
    """id, v: the vectors with exactly dim components, all finite, as whole numbers floor(scale * x)."""
    x = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).alias("id"), x.alias("x")).where(
        F.coalesce((F.size("x") == dim) & F.forall("x", lambda y: F.coalesce(F.abs(y) < float("inf"), F.lit(False))), F.lit(False))
    )
    most = float(reach(dim) + 1)  # what lies beyond is told apart, and refused when it is read
    bounded: Column = F.transform("x", lambda y: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.lit(float(scale)) * y).cast("double"))).cast("int"))
    return kept.select("id", bounded.alias("v"))


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, scale: float = 256.0) -> DataFrame:
    """One row per vector that is kept: id_col, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, scans.

    Kept are vectors of exactly dim components, none null or not finite; x becomes floor(scale * x).  Centroids start as
    the k vectors with the smallest SHA-256 of "seed:identifier" (a null identifier counts as empty text; of equal ones
    the smaller components go first).  Each of the rounds assigns every vector to the nearest centroid, ties to the
    smaller number, and moves every centroid that has vectors to the floor of their mean; then they are assigned once
    more.  With fewer than k vectors there are as many centroids as vectors; without any the result is empty.  Repeated
    vectors and identifiers are rows of their own.  Components so large that a squared distance would not fit a long are
    refused with an error.  Other columns are not read, whatever their names.  scans counts the distances computed.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = whole_vectors(vectors, id_col, vector_col, dim, scale)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = np.array([r.v for r in rows.orderBy(drawn, "v").limit(k).collect()], np.int64).reshape(-1, dim)  # k rows
    if not len(start):
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans long")
    known = Centroids(start, grouped(start), np.zeros(len(start)))
    counts, sums = np.zeros(len(start), np.int64), np.zeros_like(start)
    state, folder = rows, ""
    for turn in range(rounds + 1):
        done, folder = folder, new_folder(spark, f"yinyang-{turn}")
        with_assignment(state, known, dim, turn == 0, turn == rounds).write.parquet(folder)
        state = spark.read.schema(STATE.format(id=kind)).parquet(folder)
        if done:
            removed(spark, done)
        if turn < rounds:
            which, more, parts = changes(state, dim)
            counts[which] += more
            sums[which] += parts
            at = np.where((counts > 0)[:, None], sums // np.maximum(counts, 1)[:, None], known.at)
            known = replace(known, at=at, drift=upwards(np.sqrt(between(at, known.at).astype(np.float64))))
    inertia = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    told = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(known.at.tolist())]
    ends = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(ends), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")
