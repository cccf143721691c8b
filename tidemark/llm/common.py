"""Shared helpers of the training-data operators: settled tables and small column idioms."""

from __future__ import annotations

import ctypes
import tempfile
import urllib.parse
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, ``spark.checkpoint.dir``;
    what it holds can be deleted when the application has ended.

    Where the session names none, a session on one machine gets a temporary folder, and another one
    an error: executors elsewhere could not read what is written here.
    """
    return f"{_root(spark)}/tidemark-{spark.sparkContext.applicationId}"


def _root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def settle(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: work above is not repeated, and a lost executor costs only the reading of
    a file that all machines reach.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files_of(df: DataFrame) -> list[str]:
    """Paths of the files of a settled table, which Spark names as addresses, with blanks and the like in code."""
    return sorted(map(urllib.parse.unquote, df.inputFiles()))


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in files_of(df)}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot if it holds more than one in so many rows: there can't be more hot keys than that.
HOT_SHARE = 1000


#: Rows of a narrow table, 100 bytes at most each, that are broadcast; one that is counted to have more is
#: shuffled.
BROADCAST_ROWS = 300_000


def bounded_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``big`` joined with a settled narrow table, broadcast if it is counted to be small; else the keys in
    ``hot`` come by broadcast, if there are any, and the others are shuffled."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how) if hot is None else split_join(big, small, hot, on, how)


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` of the integer keys that hold more than one in ``HOT_SHARE`` rows: buckets of keys
    are counted first, which shuffles little, then the keys of the buckets that are as large."""
    bucket = F.pmod(F.xxhash64(key), F.lit(1 << 16))
    sizes = settle(df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n")), "bucket-sizes")
    limit = F.lit((sizes.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE)
    large = sizes.where(F.col("n") > limit).select("_bucket")
    inside = df.withColumn("_bucket", bucket).join(F.broadcast(large), "_bucket", "left_semi")
    return settle(inside.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit), "hot")


def split_join(big: DataFrame, small: DataFrame, hot: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, whose keys are unique: entries of the keys in ``hot``, at most
    ``HOT_SHARE`` rows, are broadcast, so that no task gets all rows of one; others are shuffled."""
    few = F.broadcast(hot.select(on))
    cold = big.join(few, on, "left_anti").join(small, on, how)
    return cold.unionByName(big.join(F.broadcast(small.join(few, on, "left_semi")), on, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


Blocks = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def giving_back(run: Blocks) -> Blocks:
    """``run``, which returns freed memory to the system when its task ends. A Python worker lives
    on for later tasks, and would hold what its largest block took while the next stage works."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


def free_name(taken: Iterable[str], stem: str) -> str:
    """``stem``, with as many underscores before it as keep it apart from ``taken`` in any case."""
    used = {c.lower() for c in taken}
    while stem.lower() in used:
        stem = "_" + stem
    return stem


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside ``body``'s higher-order functions.

    Without it the optimizer may inline an expensive array into a lambda and evaluate it there
    for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def crc32_mod(col: Column, n: int) -> Column:
    """crc32 of the value's decimal text, modulo ``n`` (the contracts' folds)."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)
