"""Calendar-time portfolios: quantile buckets, active positions, long-short spreads, HAC tests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut
from .relational import bounded_lookup, first_by
from .stats import grouped_quantiles, normal_p, quantiles


def qcut(df: DataFrame, keys: Sequence[str], value: str, n: int, bucket: str = "bucket") -> DataFrame:
    """Buckets 0..n-1 by linear-interpolation quantiles, right-closed, ties together. Groups whose
    edges coincide (fewer than ``n`` buckets) are left out, as are null values."""
    rows = df.where(F.col(value).isNotNull())
    shares = [i / n for i in range(n + 1)]
    if not keys:
        edges = quantiles(rows, value, shares)
        if edges is None or len(set(edges)) <= n:
            return rows.withColumn(bucket, F.lit(0)).where("false")
        return rows.withColumn(bucket, sum(((F.col(value) > e).cast("int") for e in edges[1:-1]), F.lit(0)))
    whole = grouped_quantiles(rows, keys, value, shares, "_edges").where(F.size(F.array_distinct("_edges")) == n + 1)
    inner = F.slice("_edges", 2, n - 1)
    return rows.join(whole, list(keys)).withColumn(bucket, F.size(F.filter(inner, lambda e: e < F.col(value)))).drop("_edges")


def active_positions(events: DataFrame, entry: str, holding: int | Column, first: str, last: str) -> DataFrame:
    """Each event in every month end ``m`` with ``m - holding months < entry <= m`` (month ends clamp,
    so a position may be active one month longer), between the dates ``first`` and ``last``. Months
    are generated per event, which is linear, instead of range-joined; ``holding`` may be a column."""
    held = F.lit(holding) if isinstance(holding, int) else holding
    low, high = F.greatest(F.col(entry), F.lit(first).cast("date")), F.least(F.add_months(F.col(entry), held + 1), F.lit(last).cast("date"))
    months = F.transform(F.sequence(F.trunc(low, "MM"), F.trunc(high, "MM"), F.expr("interval 1 month")), F.last_day)
    spread = events.where(low <= high).withColumn("month", F.explode(months))
    return spread.where((F.col(entry) > F.add_months("month", -held)) & (F.col(entry) <= F.col("month")))


def latest_events(events: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str = "weight") -> DataFrame:
    """``(keys, order, weight)``: the last event by ``order`` of those with equal keys, and how many they are. Events of one
    name and entry are held in the same months, so that the others count there but are never chosen."""
    last = events.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"), F.count("*").alias(weight))
    return last.select(*keys, "_last.*", weight)


def grid_spread(
    positions: DataFrame, returns: DataFrame, key: str, score: str, groups: Sequence[int], min_group: int = 3, order: Sequence[str] = (), extra: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """``(extra, month, groups, n_active, high, low, spread)``: per month, one position per key (the last
    by ``order``), score buckets, equal-weight mean of the non-null returns, highest less lowest, for
    each number of ``groups``. Positions, returns and quantiles are computed once for all of them.

    A month needs ``min_group * groups`` positions before duplicates go; it is left out if its buckets
    collapse or either end has no return. ``weight`` names the number of positions that a row stands for. Months
    are counted by partial sums and rows are dealt out by month and key, so no task gets a month.
    """
    by = [*extra, "month"]
    shares = sorted({i / n for n in groups for i in range(n + 1)})
    sizes = cut(positions.groupBy(*by).agg((F.sum(weight) if weight else F.count("*")).alias("_n")).where(F.col("_n") >= min_group * min(groups)))
    nth = F.row_number().over(W.partitionBy(*by, key).orderBy(*(F.desc(c) for c in (order or (score,)))))
    single = positions.withColumn("_nth", nth).where("_nth = 1").select(*by, key, score)
    single = cut(bounded_lookup(single, sizes, by).where("_n is not null"))
    held = bounded_lookup(single.join(returns, [key, "month"], "left"), cut(grouped_quantiles(single, by, score, shares, "_edges")), by)
    cases = []
    for n in groups:
        edges = F.array(*(F.col("_edges")[shares.index(i / n)] for i in range(n + 1)))
        bucket = sum(((F.col(score) > edges[i]).cast("int") for i in range(1, n)), F.lit(0))
        whole = (F.col("_n") >= min_group * n) & (F.size(F.array_distinct(edges)) == n + 1)
        cases.append(F.when(whole, F.struct(F.lit(n).alias("groups"), bucket.alias("bucket"))))
    rows = held.where(F.col(score).isNotNull()).withColumn("_case", F.explode(F.array_compact(F.array(*cases)))).select(*by, "ret", "_case.*")
    legs = rows.groupBy(*by, "groups").agg(
        F.count("*").alias("n_active"), F.avg(F.when(F.col("bucket") == F.col("groups") - 1, F.col("ret"))).alias("high"), F.avg(F.when(F.col("bucket") == 0, F.col("ret"))).alias("low")
    )
    return legs.where("high is not null and low is not null").withColumn("spread", F.col("high") - F.col("low"))


def monthly_spread(
    positions: DataFrame, returns: DataFrame, key: str, score: str, n: int, min_group: int = 3, order: Sequence[str] = (), extra: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """``grid_spread`` of one number of groups, without its column."""
    return grid_spread(positions, returns, key, score, [n], min_group, order, extra, weight).drop("groups")


def hac_mean(series: DataFrame, value: str, order: str, keys: Sequence[str] = (), max_lags: int = 3) -> DataFrame:
    """Mean with its Bartlett-weighted HAC standard error, t statistic and normal two-sided p, a row per key."""
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    u = series.where(F.col(value).isNotNull()).withColumn("_u", F.col(value) - F.avg(value).over(by))
    products = [F.sum(F.col("_u") * F.col("_u")).alias("g0")]
    for j in range(1, max_lags + 1):
        u = u.withColumn(f"_l{j}", F.lag("_u", j).over(by.orderBy(order)))
        products.append(F.coalesce(F.sum(F.col("_u") * F.col(f"_l{j}")), F.lit(0.0)).alias(f"g{j}"))
    sums = (u.groupBy(*keys) if keys else u.groupBy()).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *products)
    s = F.col("g0") + sum((2 * (1 - j / (max_lags + 1)) * F.col(f"g{j}") for j in range(1, max_lags + 1)), F.lit(0.0))
    out = sums.withColumn("se", F.sqrt(F.greatest(s, F.lit(0.0))) / F.col("n"))
    return out.where("n > 0").select(*keys, "n", "mean", "se", F.try_divide("mean", "se").alias("t"), normal_p(F.try_divide("mean", "se")).alias("p"), (F.pow(1 + F.col("mean"), 12) - 1).alias("annualized"))


def size_neutral_spread(
    events: DataFrame, positions: DataFrame, returns: DataFrame, key: str, score: str, size: str, n: int, buckets: int = 2, min_group: int = 2, min_months: int = 5, order: Sequence[str] = ()
) -> DataFrame:
    """``(month, spread, n_slices)`` averaged over closed slices of size, whose edges are quantiles over
    ``events``; a value on an edge is in both slices. Slices with ``min_months`` months or fewer are
    left out."""
    edges = quantiles(events, size, [i / buckets for i in range(buckets + 1)]) or [0.0] * (buckets + 1)
    inside = [F.when(F.col(size).between(a, b), i) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    cut = positions.withColumn("slice", F.explode(F.array_compact(F.array(*inside))))
    each = monthly_spread(cut, returns, key, score, n, min_group, order, ["slice"])
    months = each.withColumn("_m", F.count("*").over(W.partitionBy("slice"))).where(F.col("_m") > min_months)
    return months.groupBy("month").agg(F.avg("spread").alias("spread"), F.count("*").alias("n_slices"))


def characteristic_adjusted_spread(
    positions: DataFrame, returns: DataFrame, key: str, score: str, controls: Sequence[str], n: int = 3, min_group: int = 3, min_names: int = 12, order: Sequence[str] = ()
) -> DataFrame:
    """``(month, n_active, high, low, spread)`` of returns with the part that a month's cross-section
    explains by ``controls`` taken off.

    Positions without a score or a control are dropped first; a month needs ``min_group * n`` of the
    rest, then one per key stays (the last by ``order``) that has a return, ``min_names`` at least.
    """
    whole = positions.dropna(subset=["month", key, score, *controls]).withColumn("_n", F.count("*").over(W.partitionBy("month"))).where(F.col("_n") >= min_group * n)
    single = first_by(whole, ["month", key], [F.desc(c) for c in (order or (score,))]).join(returns, [key, "month"]).where("ret is not null")
    single = cut(single.select("month", key, score, "ret", *(c for c in controls if c != score)))
    residuals = residual_scores(single, "month", key, "ret", controls, min_names)
    held = qcut(residuals.join(single.select("month", key, score), ["month", key]), ["month"], score, n)
    legs = held.groupBy("month").agg(
        F.count("*").alias("n_active"), F.avg(F.when(F.col("bucket") == n - 1, F.col("residual"))).alias("high"), F.avg(F.when(F.col("bucket") == 0, F.col("residual"))).alias("low")
    )
    return legs.where("high is not null and low is not null").withColumn("spread", F.col("high") - F.col("low"))


def concat_on(frames: Sequence[DataFrame], key: str, names: Sequence[str], value: str) -> DataFrame:
    """Series side by side: a row per key of any frame, the ``value`` of each under its name. One
    aggregation over their union, however many there are."""
    tagged = [f.select(key, F.col(value).alias("_v"), F.lit(n).alias("_n")) for f, n in zip(frames, names)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy(key).agg(*(F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(n) for n in names))


def residual_scores(positions: DataFrame, month: str, key: str, outcome: str, controls: Sequence[str], min_names: int = 12) -> DataFrame:
    """``(month, key, residual)`` of monthly cross-sectional least squares of ``outcome`` on
    ``controls``; rows with a null are dropped first and months with fewer names left out.

    Months are summed, never gathered: their means, then the cross products of what is off the means. A
    month's row of sums, ``k * k`` numbers for ``k`` controls, is solved in a batch with others (of equally
    good coefficients the smallest), and rows get theirs by a join."""
    values, k = [outcome, *controls], len(controls)
    rows = positions.select(F.col(month).alias("_month"), F.col(key).alias("_key"), *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(values))).dropna()
    means = rows.groupBy("_month").agg(F.count("*").alias("_n"), *(F.avg(f"_v{i}").alias(f"_m{i}") for i in range(k + 1))).where(F.col("_n") >= min_names)
    off = bounded_lookup(rows, means, ["_month"]).where("_n is not null").select("_month", "_key", *((F.col(f"_v{i}") - F.col(f"_m{i}")).alias(f"_v{i}") for i in range(k + 1)))
    pairs = [(i, j) for i in range(1, k + 1) for j in range(k + 1)]
    sums = off.groupBy("_month").agg(F.array(*(F.sum(F.col(f"_v{i}") * F.col(f"_v{j}")) for i, j in pairs)).alias("s"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column("s").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k, k + 1)
            scale = np.sqrt(np.maximum(np.diagonal(s[:, :, 1:], axis1=1, axis2=2), 1e-300))  # so that units don't decide the rank
            inverse = np.linalg.pinv(s[:, :, 1:] / scale[:, :, None] / scale[:, None, :], rcond=1e-12, hermitian=True)
            coefs = (inverse @ (s[:, :, 0] / scale)[:, :, None])[:, :, 0] / scale
            yield pa.RecordBatch.from_arrays([b.column("_month"), pa.array(coefs.tolist(), pa.list_(pa.float64()))], ["_month", "b"])

    fits = sums.mapInArrow(solve, f"_month {sums.schema['_month'].dataType.simpleString()}, b array<double>")
    explained = sum((F.col("b")[i - 1] * F.col(f"_v{i}") for i in range(1, k + 1)), F.lit(0.0))
    return bounded_lookup(off, fits, ["_month"]).select(F.col("_month").alias(month), F.col("_key").alias(key), (F.col("_v0") - explained).alias("residual"))
