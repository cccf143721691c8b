"""Operator 13: ball k-means over integer vectors, exact.

A cluster is a ball: its centroid and a radius that no member is farther away than. In each round a cluster's
members are compared with few centroids only:

* A centroid is a neighbour if it is less than two radii away; others can't win any member.
* Members nearer than half the way to the nearest neighbour are the stable core and stay without a comparison.
* Around it lie annuli: a member is compared with the neighbours less than twice its own distance away, and
  with no others. All distances are exact integers, as are sums and floors of means, so the result is
  that of comparing every vector with every centroid.

A round is one pass that writes each vector with its new cluster and distance, then one aggregation with a row
per cluster. Vectors never move between tasks; the driver gets sums, counts and radii of the clusters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle

CLUSTERS = 8
ROUNDS = 10
SIZE = 64
SCALE = 1024
SEED = 3
#: Integers from this size on give squared distances that a long can't hold; such entries count as not finite.
LARGEST = 1 << 27
STATE = "vec_id long, x array<int>, cluster int, distance long"


def integers(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)`` of the vectors of exactly ``size`` entries, none null or non-finite, as integers
    ``floor(scale * entry)``. Entries of ``LARGEST / scale`` and more count as not finite."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    inside = lambda e: F.coalesce(F.abs(e) < LARGEST / scale, F.lit(False))  # noqa: E731  NaN compares as larger
    kept = kept.where(F.col("v").isNotNull() & (F.size("v") == size) & F.forall("v", inside))
    return kept.select("vec_id", F.transform("v", lambda e: F.floor(e * F.lit(float(scale))).cast("int")).alias("x"))


def first_centroids(x: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest hex sha256 of ``seed:vec_id``, in that order; of one id's
    vectors the smaller go first, null ids last. Fewer vectors are fewer centroids."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = x.orderBy(key.asc_nulls_last(), F.col("x").asc()).select("x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64) if rows else np.empty((0, 0), np.int64)


def neighbours(centroids: np.ndarray, radii: np.ndarray) -> list[list[tuple[int, int]]]:
    """Of each ball the ``(squared distance, number)`` of the centroids that are less than, or just, two radii
    away, nearest first. ``radii`` are upper bounds."""
    gaps = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    out = []
    for i, row in enumerate(gaps.tolist()):
        reach = 2 * float(radii[i]) * (1 + 1e-9) + 1e-6
        out.append(sorted((d, j) for j, d in enumerate(row) if j != i and math.sqrt(d) <= reach))
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, of equally near ones the first."""
    best = np.zeros(len(x), np.int32)
    least = np.full(len(x), np.iinfo(np.int64).max)
    for j, c in enumerate(centroids):
        d = ((x - c) ** 2).sum(axis=1)
        closer = d < least
        best[closer], least[closer] = j, d[closer]
    return best, least


def within_balls(x: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, near: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``nearest``, for rows that were in ``cluster``, and how many distances were computed."""
    own = ((x - centroids[cluster]) ** 2).sum(axis=1)
    best, least, made = cluster.copy(), own.copy(), len(x)
    for i, others in enumerate(near):
        rows = np.flatnonzero(cluster == i)
        for gap, j in others:
            rows = rows[4 * own[rows] >= gap]  # the core is out with the first, each annulus with a later one
            if not len(rows):
                break
            made += len(rows)
            d = ((x[rows] - centroids[j]) ** 2).sum(axis=1)
            won = (d < least[rows]) | ((d == least[rows]) & (j < best[rows]))
            best[rows[won]], least[rows[won]] = j, d[won]
    return best, least, made


def _assigned(centroids: np.ndarray, near: list[list[tuple[int, int]]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1 if b.num_rows else centroids.shape[1])
            if near is None:
                best, least = nearest(x, centroids)
            else:
                best, least, _ = within_balls(x, b.column("cluster").to_numpy(zero_copy_only=False), centroids, near)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(best, pa.int32()), pa.array(least, pa.int64())], ["vec_id", "x", "cluster", "distance"])

    return run


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New centroids, and radii around them that hold all members: the old radius and the way moved."""
    size = centroids.shape[1]
    rows = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(size))).collect()
    new, radii = centroids.copy(), np.zeros(len(centroids))
    for r in rows:
        i = r["cluster"]
        new[i] = [r[f"s{k}"] // r["n"] for k in range(size)]
        radii[i] = math.sqrt(r["far"]) + math.sqrt(int(((new[i] - centroids[i]) ** 2).sum()))
    return new, radii


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def fit(x: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """``x(vec_id, x)`` to ``STATE`` rows with their cluster and squared distance, and the centroids, after
    ``rounds`` rounds of assigning and moving and one assignment more. Empty clusters keep their centroid."""
    x = settle(x, "vectors")
    centroids = first_centroids(x, k, seed)
    if not len(centroids):  # no vector at all
        return x.selectExpr("vec_id", "x", "cast(0 as int) as cluster", "0L as distance"), centroids
    state, near = settle(x.mapInArrow(_assigned(centroids, None), STATE), "balls"), None
    forget(x)
    for _ in range(rounds):
        centroids, radii = _moved(state, centroids)
        near = neighbours(centroids, radii)
        before, state = state, settle(state.mapInArrow(_assigned(centroids, near), STATE), "balls")
        forget(before)
    return state, centroids


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` to ``(vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256)``, a row per kept vector; ``integers`` states which are kept.

    Repeated rows and null ids are vectors of their own; of equally near centroids the smaller number wins; other
    columns are not read; a table of no kept vector gives an empty result."""
    state, centroids = fit(integers(vectors, size, scale), k, rounds, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(sums.values())
    of = lambda values, kind: F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>")[F.col("cluster")]
    return state.select(
        "vec_id", "cluster", "distance", of([sums.get(i, 0) for i in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(whole).cast("long").alias("inertia"), of([digest(c) for c in centroids], "string").alias("centroid_sha256"),
    )
