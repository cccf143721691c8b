"""Registration of queries with their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import nearest


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None, dates: tuple[str, ...] = ()):
        """Register a query. Results have days as text and whole numbers as longs, so that engines
        with other types for them agree; ``dates`` names the day columns of the SQL."""

        def put(f):
            @functools.wraps(f)
            def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
                df = f(spark, sf_dir)
                kinds = {"date": "string", "int": "long", "smallint": "long"}
                return df.select(*(F.col(c).cast(kinds[t]).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes))

            self.queries[f.__name__] = plain
            if sql:
                days = ", ".join(f"{d}::DATE::VARCHAR AS {d}" for d in dates)
                self.oracle[f.__name__] = f"SELECT * REPLACE ({days}) FROM ({sql})" if dates else sql
            return f

        return put


class Tables:
    """Tables of a folder; timestamps of day grain are read as dates where asked."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree."""
    return df.select(*(nearest(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
