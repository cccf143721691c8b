"""Operator 12: whitening of embeddings by upper-triangle column aggregates.

Three passes over the vectors, each one Spark aggregation or projection without a shuffle of rows:

1. counts and sums of every dimension;
2. a Spark SQL expression for each pair of dimensions on and above the diagonal sums the products of
   centred entries, all in one aggregation of one row, so that ``d * (d + 1) / 2`` numbers reach the driver,
   whatever the number of vectors. The driver assembles the covariance and LAPACK decomposes it;
3. rows are projected on the components, block by block. The same aggregation over the projected columns
   tells how far their covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Kept components, and the fixed point of an entry: ``floor(SCALE * c) + SHIFT``.
COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
#: Entries from this size on don't fit exact sums of long integers and count as not finite.
LARGEST = float(1 << 31)


def fixed_point(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``(vec_id, x)``: entries as long integers, of the vectors that are not null and hold neither null
    nor non-finite entries. A table's dimension is its vectors' most frequent length (of equally frequent
    ones the longest); vectors of another length can't be in one covariance and are left out."""
    # a comparison takes NaN for larger than any number
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & F.forall("v", lambda e: F.coalesce(F.abs(e) < LARGEST, F.lit(False)))
    )
    lengths = kept.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).select("d").first()
    d = most["d"] if most else 0
    return kept.where(F.size("v") == d).select("vec_id", F.transform("v", lambda e: F.floor(F.lit(float(scale)) * e) + F.lit(shift)).alias("x"))


def sums(x: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors of ``x(x)`` and the exact sum of each dimension."""
    first = x.select(F.size("x").alias("d")).first()
    d = first["d"] if first else 0
    row = x.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d))).first()
    return row["n"], [row[f"s{i}"] for i in range(d)]


def pair_sums(columns: DataFrame) -> np.ndarray:
    """Sums of the products of every pair of the double columns ``c0``, ``c1``, ...: one aggregation with
    an expression for each entry of the upper triangle."""
    names = columns.columns
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = columns.selectExpr(*(f"sum({names[i]} * {names[j]})" for i, j in pairs)).first()
    out = np.zeros((d, d))
    for (i, j), v in zip(pairs, row):
        out[i, j] = out[j, i] = v if v is not None else 0.0
    return out


def centred(x: DataFrame, n: int, totals: Sequence[int]) -> DataFrame:
    """Columns ``c0``, ``c1``, ...: entries less their dimension's mean. The mean's whole part is taken off
    in integers, so that a common offset costs no digits. No entry is null; saying so halves the time
    of the sums."""
    off = lambda i, s: (F.col("x")[i] - F.lit(s // n)).cast("double") - F.lit((s % n) / n)
    return x.select(*(F.coalesce(off(i, s), F.lit(0.0)).alias(f"c{i}") for i, s in enumerate(totals)))


def covariance(x: DataFrame, n: int, totals: Sequence[int]) -> np.ndarray:
    return pair_sums(centred(x, n, totals)) / n


def components(cov: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: the first ``k``, without those that are zero
    to the precision of a double, along which nothing can be scaled to a variance of one."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    # LAPACK leaves the sign open; the largest entry is positive
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(len(values))] < 0, -1.0, 1.0)
    sound = values > max(values.max(), 0.0) * len(values) * np.finfo(float).eps
    return values[sound][:k], vectors[:, sound][:, :k]


def _deviations(x: np.ndarray, n: int, totals: np.ndarray) -> list[int | None]:
    """Exact sums of ``(n * x - S) ** 2``, None where a long can't hold them."""
    whole = [t // n for t in totals.tolist()], [t % n for t in totals.tolist()]
    off = x - np.array(whole[0], np.int64)  # n * x - S == n * off - S % n
    if (float(np.abs(off).max(initial=0)) + 1) ** 2 * float(n) ** 2 * x.shape[1] < 2.0**62:
        far = n * off - np.array(whole[1], np.int64)
        return (far * far).sum(axis=1).tolist()
    exact = (sum((n * int(v) - r) ** 2 for v, r in zip(row, whole[1])) for row in off)
    return [v if v < 1 << 63 else None for v in exact]


def _projected(n: int, totals: list[int], loadings: np.ndarray):
    means, rests = np.array([t // n for t in totals], np.int64), np.array([t % n for t in totals]) / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, len(totals))
            white = ((x - means).astype(float) - rests) @ loadings
            edges = np.arange(b.num_rows + 1, dtype=np.int32) * loadings.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(white.ravel()))
            far = pa.array(_deviations(x, n, np.array(totals, object)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), far, lists], ["vec_id", "deviation", "w"])

    return run


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` to a row per kept vector and component: ``(vec_id, component, n,
    deviation, whitened, explained, identity_error)``.

    Which vectors are kept is stated in ``fixed_point``; entries of 2 ** 31 and more count as not finite.
    Repeated rows and null ids are vectors of their own, ties in eigenvalues are numbered as LAPACK gives them;
    other columns are not read. Components without variance have no rows, so a table of equal vectors, of one
    or of none gives an empty result. ``deviation`` is null where a long can't hold it."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = settle(fixed_point(vectors, scale, shift), "fixed-point")
    n, totals = sums(x)
    if not totals:
        return vectors.sparkSession.createDataFrame([], schema)
    cov = covariance(x, n, totals)
    values, found = components(cov, k)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    rows = x.mapInArrow(_projected(n, totals, found / np.sqrt(values)), "vec_id long, deviation long, w array<double>")
    error = identity_error(rows.select(*(F.col("w")[i].alias(f"c{i}") for i in range(len(values)))), n)
    share = F.array(*(F.lit(float(v)) for v in values / np.trace(cov)))
    each = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")
    )


def identity_error(columns: DataFrame, n: int) -> float:
    """The largest absolute entry of the columns' covariance, centred first, less the identity."""
    means = columns.agg(*(F.avg(c).alias(c) for c in columns.columns)).first()
    off = columns.select(*(F.coalesce(F.col(c) - F.lit(means[c]), F.lit(0.0)).alias(c) for c in columns.columns))
    return float(np.abs(pair_sums(off) / n - np.eye(len(columns.columns))).max())
