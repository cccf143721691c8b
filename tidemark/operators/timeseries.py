"""Time-series operators: as-of lookups, N-th observations, returns, month ends, volatility.

As-of lookups union both sides and carry the last (or next) observation through one ordered window
per key: one shuffle and one sort, linear in the rows, with no range join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .lineage import cut


def _asof(events: DataFrame, series: DataFrame, key: str, at: str, values: Sequence[str], forward: bool, inclusive: bool) -> DataFrame:
    """``events`` with ``obs_at`` and the values of the nearest observation on one side. A null key or time has none."""
    seen = F.struct(F.col(at).alias("obs_at"), *values)
    left = events.withColumn("_obs", F.lit(None)).withColumn("_event", F.struct(*events.columns)).select(key, at, "_event", "_obs")
    right = series.select(key, at, F.lit(None).alias("_event"), seen.alias("_obs")).where(F.col(at).isNotNull())
    both = left.drop("_obs").unionByName(right, allowMissingColumns=True)
    # equal times: an observation counts as reached if inclusive, in either direction
    is_event = F.col("_event").isNotNull().cast("int")
    order = [F.desc(at) if forward else F.col(at), is_event if inclusive else -is_event]
    window = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = F.col(key).isNotNull() & F.col(at).isNotNull()
    carried = both.withColumn("_obs", F.when(placed, F.last("_obs", ignorenulls=True).over(window))).where("_event is not null")
    return carried.select("_event.*", "_obs.*")


def asof_forward(events: DataFrame, series: DataFrame, key: str, at: str, values: Sequence[str], inclusive: bool = True) -> DataFrame:
    """The first observation at or after each event (null if there is none)."""
    return _asof(events, series, key, at, values, True, inclusive)


def asof_backward(events: DataFrame, series: DataFrame, key: str, at: str, values: Sequence[str], inclusive: bool = True) -> DataFrame:
    """The last observation at or before each event (null if there is none)."""
    return _asof(events, series, key, at, values, False, inclusive)


def nth_following(series: DataFrame, key: str, at: str, value: str, n: int, *ties: str) -> DataFrame:
    """Each non-null observation with the one ``n`` observations later; null near the end."""
    ahead = W.partitionBy(key).orderBy(at, *ties)
    rows = series.where(F.col(value).isNotNull())
    return rows.withColumn(f"{at}_n", F.lead(at, n).over(ahead)).withColumn(f"{value}_n", F.lead(value, n).over(ahead))


def pct_change(value: str, key: str, at: str, fill: bool = False) -> Column:
    """Change against the row before; null if either is null, or with gaps filled forward first; from 0 it is infinite."""
    order = W.partitionBy(key).orderBy(at)
    now = F.last(value, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)) if fill else F.col(value)
    before = F.last(value, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)) if fill else F.lag(value).over(order)
    return ratio(now, before) - 1


def month_end_last(df: DataFrame, key: str, at: str, value: str, *ties: str) -> DataFrame:
    """Last non-null value of each key and month over the key's own range; empty months are null rows."""
    seen = df.where(F.col(value).isNotNull())
    last = seen.groupBy(key, F.last_day(at).alias("month")).agg(F.max_by(value, F.struct(at, *ties)).alias(value))
    span = last.groupBy(key).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))
    spine = span.select(key, F.explode(F.transform(months, F.last_day)).alias("month"))
    return spine.join(last, [key, "month"], "left")


def trailing_return(series: DataFrame, key: str, at: str, value: str, year: Column, lookback: int = 380, min_obs: int = 200, *ties: str) -> DataFrame:
    """Per key and year end: last value up to it over the first from ``lookback`` days before it,
    minus one; only where ``min_obs`` observations exist up to the year end in the whole history. ``ties`` order rows of
    one time. A row adds to its year and to the year ends within ``lookback`` days, in one aggregation without a sort."""
    day, own = F.to_date(at), F.col("_own")
    rows = series.where(F.col(value).isNotNull()).withColumn("_own", year)
    end = lambda y: F.make_date(y, F.lit(12), F.lit(31))
    reached = F.filter(F.sequence(F.year(day), F.year(F.date_add(day, lookback))), lambda y: end(y) <= F.date_add(day, lookback))
    each = rows.withColumn("year", F.explode(F.array_union(F.array(own), F.coalesce(reached, F.array(own)))))
    # a plain time as the order leaves the sums to a hash aggregation, a struct would have all rows sorted
    order, mine = F.struct(at, *ties) if ties else F.col(at), F.col("year") == own
    inside = end(F.col("year")).between(day, F.date_add(day, lookback))
    per_year = cut(each.groupBy(key, "year").agg(F.count(F.when(mine, 1)).alias("n"), F.max_by(value, F.when(mine, order)).alias("p1"), F.min_by(value, F.when(inside, order)).alias("p0")))
    # a key's years run from its first to the last of all, which is one number
    seen = per_year.where("n > 0")
    last_year = seen.agg(F.max("year")).first()[0]
    years = seen.groupBy(key).agg(F.explode(F.sequence(F.min("year"), F.lit(last_year))).alias("year")) if last_year is not None else seen.select(key, "year")
    so_far = W.partitionBy(key).orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    grid = years.join(per_year, [key, "year"], "left").withColumn("n_obs", F.sum("n").over(so_far)).withColumn("p1", F.last("p1", ignorenulls=True).over(so_far))
    guarded = grid.where((F.col("n_obs") >= min_obs) & F.col("p0").isNotNull())
    return guarded.select(key, "year", (ratio(F.col("p1"), F.col("p0")) - 1).alias("trailing_return"))


def volatility(daily: DataFrame, key: str, at: str, value: str, min_obs: int = 50, days: int = 252) -> DataFrame:
    """Yearly standard deviation of daily changes, annualised, where ``min_obs`` changes exist."""
    changes = daily.withColumn("_r", pct_change(value, key, at)).where("_r is not null")
    yearly = changes.groupBy(key, F.year(at).alias("year")).agg(F.count("*").alias("n_obs"), (F.stddev_samp("_r") * F.sqrt(F.lit(days))).alias("volatility"))
    return yearly.where(F.col("n_obs") >= min_obs)
