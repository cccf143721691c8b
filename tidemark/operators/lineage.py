"""Cutting the lineage of iterated tables, and where to put what is kept between steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that ``spark.checkpoint.dir`` names, which all executors share. A
    session on one machine that names none gets a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in ``shared_folder``: work above isn't repeated, and a lost executor costs a read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
