"""Event studies: benchmark-adjusted returns and bracketed revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import guarded_ratio, ratio
from .timeseries import asof_backward, asof_forward


def abnormal_return(events: DataFrame, prices: DataFrame, benchmark: DataFrame, key: str, at: str, price: str, n: int) -> DataFrame:
    """Return from the first row of prices at or after an event to the ``n``-th after it, less the
    benchmark's over the same days; events without either row are left out. From a price of 0 it is
    infinite. Days without a price count as rows; a return from or to one is null.

    ``benchmark(at, price)`` has a row a day. Its first and last levels inside the span are as-of
    lookups too; a span with fewer than two benchmark days is left out, one without a level has none.
    """
    ahead = W.partitionBy(key).orderBy(at)
    legs = prices.select(key, at, F.col(price).alias("p0"), F.lead(at, n).over(ahead).alias("t1"), F.lead(price, n).over(ahead).alias("p1"))
    hit = asof_forward(events, legs, key, at, ["p0", "t1", "p1"]).where("t1 is not null").withColumnRenamed("obs_at", "t0")
    one = F.lit(1).alias("_one")
    traded = benchmark.select(one, F.col(at), F.col(price).alias("level"))
    level = traded.where("level is not null")
    spans = hit.select(*events.columns, "t0", "p0", "t1", "p1").withColumnRenamed(at, "_event_at")
    # the benchmark is one series: a day has one level, so lookups are equi-joins on days made dense
    days = traded.agg(F.min(at).alias("a"), F.max(at).alias("b")).select(F.explode(F.sequence("a", "b")).alias(at)).withColumn("_one", F.lit(1))
    dense = asof_forward(asof_forward(days, traded, "_one", at, []).withColumnRenamed("obs_at", "first_day"), level, "_one", at, ["level"])
    dense_back = asof_backward(asof_backward(days, traded, "_one", at, []).withColumnRenamed("obs_at", "last_day"), level, "_one", at, ["level"])
    opening = dense.select(F.col(at).alias("t0"), "first_day", F.col("obs_at").alias("b0_at"), F.col("level").alias("b0"))
    closing = dense_back.select(F.col(at).alias("t1"), "last_day", F.col("obs_at").alias("b1_at"), F.col("level").alias("b1"))
    joined = spans.join(opening, "t0").join(closing, "t1").where("first_day < last_day")
    own = ratio(F.col("p1"), F.col("p0"))
    common = F.when((F.col("b0_at") <= F.col("t1")) & (F.col("b1_at") >= F.col("t0")), ratio(F.col("b1"), F.col("b0")))
    return joined.withColumnRenamed("_event_at", at).select(
        *events.columns, "t0", "t1", (own - 1).alias("stock_return"), (common - 1).alias("benchmark_return"), (own - common).alias("abnormal_return")
    )


def bracket_revision(events: DataFrame, estimates: DataFrame, key: str, at: str, value: str, window_days: int = 140) -> DataFrame:
    """Last estimate at or before each event and first one after it within ``window_days``; revision
    raw and relative (null near zero); events without both keep nulls."""
    before = asof_backward(events, estimates, key, at, [value]).withColumnRenamed(value, "pre").drop("obs_at")
    after = asof_forward(before, estimates, key, at, [value], inclusive=False).withColumnRenamed(value, "_post")
    near = F.col("obs_at") <= F.date_add(at, window_days)
    both = F.when(near & F.col("pre").isNotNull(), F.col("_post"))
    out = after.withColumn("post", both).withColumn("pre", F.when(F.col("post").isNotNull(), F.col("pre"))).drop("_post", "obs_at")
    return out.withColumn("revision", F.col("post") - F.col("pre")).withColumn("revision_pct", guarded_ratio(F.col("revision"), F.abs("pre")))
