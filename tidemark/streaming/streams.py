"""Streaming forms of version dedup and vintage windows.

An extension: the batch operators have these semantics, streams add watermarks for late rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_within(stream: DataFrame, keys: Sequence[str], at: str, delay: str) -> DataFrame:
    """One row per key within the watermark's delay; state is dropped as the watermark passes."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def vintages(stream: DataFrame, keys: Sequence[str], at: str, value: str, length: str, slide: str, delay: str) -> DataFrame:
    """Counts and means in sliding windows; rows later than ``delay`` are dropped."""
    window = F.window(at, length, slide)
    rows = stream.withWatermark(at, delay).groupBy(window.alias("w"), *keys)
    return rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")
