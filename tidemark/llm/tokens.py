"""Operator 7: token ids as Parquet list columns, in document order, read back selectively.

Texts are dealt by ranges of ``doc_id`` and text hash and sorted before they are encoded, so that a task writes
its range as it goes and the files are in global order. The ids are 32-bit list elements; the
writer tries a dictionary and falls back to delta encoding (format version 2), with set sizes of
row groups and pages and with page indexes, which let readers skip by ``doc_id`` and read counts
without ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import text_blocks
from .common import giving_back, settle, shared_dir
from .vocab import merge_encoder

LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(256 << 10),
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "5000",
    "compression": "zstd",
}
SCHEMA = "at long, doc_id long, n_tokens int, ids array<int>"


def _ids(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merge_encoder(path)
        for b in text_blocks(batches):
            ids, counts = encoder.encode(b.column("text"))
            ends = np.cumsum(counts)
            ids, counts = np.insert(ids, ends, end_id).astype(np.int32), counts + 1
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(counts.astype(np.int32)), lists], ["doc_id", "n_tokens", "ids"]
            )

    return giving_back(run)


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = 2) -> None:
    """Write ``at`` (place in the global order: range, then row), ``doc_id``, ``n_tokens`` and
    ``ids`` of every document, the end id included, in ascending ``doc_id`` order.

    Null and empty texts are the end id alone; null ids come first; rows of equal id follow each
    other in the order of their texts' hashes, so that ranges also part the rows of an id that many
    texts share; ``doc_id`` is a number or the text of one; an empty table writes a file without
    rows; other columns are not read."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    coded = ordered.mapInArrow(_ids(path, end_id), "doc_id long, n_tokens int, ids array<int>")
    coded.select(F.monotonically_increasing_id().alias("at"), "*").write.options(**LAYOUT).parquet(out)


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(out)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        edges = lists.offsets.to_numpy()
        raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        sums = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(edges.tolist(), edges[1:].tolist())]
        counts = pa.array(np.diff(edges).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [b.column("at"), b.column("doc_id"), counts, pa.array(sums, pa.int64())], ["at", "doc_id", "n_tokens", "ids_crc32"]
        )


def index(ids: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of files by ``write_ids``: where each document begins
    in the stream of all ids. Ranges are summed first (a row each), so running sums stay inside a
    range and only their offsets go everywhere."""
    rows = settle(ids.mapInArrow(_checksums, "at long, doc_id long, n_tokens long, ids_crc32 long"), "token-index")
    rows = rows.withColumn("range", F.shiftright("at", 33))
    sums = rows.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    running = F.sum("n_tokens").over(W.partitionBy("range").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    return rows.join(F.broadcast(before), "range").select(
        "doc_id", (F.col("before") + running - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_output(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and give the index read back from the files."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, out, end_id)
    return index(read_ids(spark, out))
