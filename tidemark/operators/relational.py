"""Relational kit: version and priority dedup, coalescing joins, crosstabs, profiles, set operations.

Operators are functions of DataFrames with column names as parameters. Where an order of rows
decides, it is given by explicit columns. All are plain Catalyst plans: one shuffle on the key each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stats import grouped_quantiles


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``; null keys form a group. A top-one aggregation:
    partial results shrink hot keys before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    nth = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(nth)).where("_nth = 1").select(*keys, *rest)


def latest_version(df: DataFrame, keys: Sequence[str], version: str, *ties: str) -> DataFrame:
    """The row of the highest version per key; ties go to the highest of ``ties``."""
    return first_by(df, keys, [F.desc(version), *(F.desc(t) for t in ties)])


def union_by_priority(frames: Sequence[DataFrame], keys: Sequence[str], *ties: str) -> DataFrame:
    """Union of frames (columns may be missing), one row per key from the earliest frame that has it."""
    ranked = [f.withColumn("_priority", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return first_by(both, keys, [F.col("_priority"), *(F.col(t) for t in ties)]).drop("_priority")


def coalesce_outer(preferred: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join in which each cell is the preferred frame's value unless that is null."""
    a, b = preferred.alias("a"), fallback.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    columns = list(dict.fromkeys([*preferred.columns, *fallback.columns]))
    both = [c for c in columns if c in preferred.columns and c in fallback.columns]
    return joined.select(*(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) if c in both else F.col(c) for c in columns))


def pivot_first(df: DataFrame, keys: Sequence[str], name: str, value: str, domain: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First non-null value per key and name, a column for each of ``domain``."""
    firsts = first_by(df.where(F.col(value).isNotNull()), [*keys, name], order)
    return firsts.groupBy(*keys).pivot(name, list(domain)).agg(F.first(value, ignorenulls=True))


def crosstab(df: DataFrame, row: str, column: str, domain: Sequence[str]) -> DataFrame:
    """Counts with a fixed set of columns; absent combinations are 0."""
    return df.groupBy(row).pivot(column, list(domain)).count().na.fill(0)


def value_counts(df: DataFrame, *columns: str, drop_null: bool = True) -> DataFrame:
    kept = df.dropna(subset=list(columns)) if drop_null else df
    return kept.groupBy(*columns).agg(F.count("*").alias("n"))


def pivot_mean(df: DataFrame, keys: Sequence[str], name: str, value: str, domain: Sequence[str]) -> DataFrame:
    """Mean per key and name, a column for each of ``domain``; empty cells are null."""
    return df.groupBy(*keys).pivot(name, list(domain)).agg(F.avg(value))


def valid_counts(df: DataFrame, keys: Sequence[str], value: str, holds: Column, share: str = "share") -> DataFrame:
    """``(keys, n, n_valid, share)``: rows, non-null values, and the share of rows where ``holds`` is true."""
    hit = F.avg(F.coalesce(holds, F.lit(False)).cast("int"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("n_valid"), hit.alias(share))


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles by linear interpolation."""
    sums = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    quarters = grouped_quantiles(df, keys, value, (0.25, 0.5, 0.75), "_q")
    named = [F.round(F.col("_q")[i], 6).alias(c) for i, c in enumerate(("p25", "p50", "p75"))]
    same = [sums[k].eqNullSafe(quarters[k]) for k in keys]
    return sums.join(quarters, same, "left").select(*(sums[k] for k in keys), "n", "mean", "std", "min", *named, "max")


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows in which each column is not null, a row per column."""
    shares = df.agg(*(F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in columns))
    return shares.unpivot([], list(columns), "column_name", "share")


def row_sum(columns: Sequence[str], min_count: int = 0) -> Column:
    """Sum across columns with nulls as 0; null if fewer than ``min_count`` are present."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0)) for c in columns))
    present = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns))
    return F.when(present >= min_count, total)


def share_of(part: Sequence[str], whole: Sequence[str]) -> Column:
    """Sum of some columns over the sum of others; null where that is 0."""
    return F.try_divide(row_sum(part).cast("double"), row_sum(whole))


def mode_first_seen(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value per key; of equally frequent ones, that seen first."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_seen"))
    return first_by(counted, keys, [F.desc("_n"), F.col("_seen")]).drop("_seen").withColumnRenamed("_n", "n")


def bounded_lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], max_rows: int = 100_000) -> DataFrame:
    """Left join to a dimension, broadcast only if it is counted to be at most ``max_rows``; a larger
    one is joined as the optimizer sees fit. Unmatched rows get nulls."""
    small = dim.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(dim) if small else dim, list(on), "left")


def resolve_by_prefix(names: DataFrame, issuers: DataFrame, name: str, issuer: str, weight: str, unmatched: str = "keep") -> DataFrame:
    """Names without their trailing digits, matched to issuers; per issuer the name of most weight, then
    the smallest. An issuer without a name keeps a row of nulls, goes (``skip``) or is an error (``raise``)."""
    stem = F.regexp_replace(F.col(name), r"\d+$", "")
    best = first_by(names.withColumn(issuer, stem), [issuer], [F.desc(weight), F.col(name)])
    found = issuers.join(best, issuer, "left")
    if unmatched == "raise":
        lost = [r[0] for r in found.where(F.col(name).isNull()).select(issuer).limit(10).collect()]
        if lost:
            raise ValueError(f"no names for issuers {lost}")
    return found.where(F.col(name).isNotNull()) if unmatched == "skip" else found
