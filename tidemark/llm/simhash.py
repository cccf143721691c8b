"""Operator 1: SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most two
bits have a segment in which they differ in at most one, so they share one of that segment's 32
one-wildcard variants. The variants are an equality index: one shuffle on the variant key brings
candidates together, and the whole fingerprints are then verified. Work is done on distinct
fingerprints, so exact copies, however many, cost one row.

A bucket with more than ``bucket_limit`` distinct fingerprints (families of near copies) is not
paired off. Its members go to an exact index instead: all fingerprints that agree outside a pair
of bit positions are within two bits of each other, so each member links to the smallest member
for each of the 2016 position pairs, linear in the family's size. No link is lost: a pair that
meets only in large buckets has both ends in that index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, hot_keys, settle, split_join
from .components import component_labels

SEED = 42
SHINGLE = 3
BUCKET_LIMIT = 64
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, size: int) -> bytes:
    """Big-endian 64-bit hashes, one after another, of the shingles of ``size`` ASCII-lower-cased words
    in their order, repeats included; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return b""
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_digest
    return b"".join([digest(s, SEED) for s in shingles])


def majority(raw: bytes) -> int:
    """Signed 64-bit SimHash of the hashes: the bits that over half of them have; 0 for none."""
    n = len(raw) // 8
    if not n:
        return 0
    grid = np.frombuffer(raw, np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        ones += np.unpackbits(grid[i : i + _BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprint(text: str | None) -> int:
    return majority(shingle_hashes(text, SHINGLE))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [fingerprint(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``; null and empty texts give 0."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_fingerprints, "doc_id long, fp long")


def links(prints: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``prints(fp)``, distinct, to edges ``(u, v)`` whose components are those of all pairs of
    fingerprints that differ in at most two bits."""
    variants = prints.select(
        "fp",
        F.explode(F.expr("""
            transform(sequence(0, 63), k ->
                (cast(k as bigint) << 32)
                | ((if(k < 32, fp, shiftrightunsigned(fp, 32)) & 4294967295L) & ~(1L << (k % 32))))
        """)).alias("key"),
    )
    # a segment that a large share of all has is one key: its members are counted before a shuffle and all crowded
    hot = settle(hot_keys(variants, "key").where(F.col("n") > bucket_limit).select("key"), "hot-variants")
    cold = variants.join(F.broadcast(hot), "key", "left_anti")
    sized = cold.withColumn("n", F.expr("count(*) over (partition by key)")).where("n > 1")
    light = (
        sized.where(F.col("n") <= bucket_limit)
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .select(F.explode(F.expr("""
            flatten(transform(fps, (a, i) -> transform(
                filter(slice(fps, i + 2, size(fps)), b -> bit_count(a ^ b) <= 2),
                b -> struct(a as u, b as v))))
        """)).alias("e"))
        .select("e.u", "e.v")
    )
    warm = variants.join(F.broadcast(hot), "key", "left_semi").select("fp")
    crowded = sized.where(F.col("n") > bucket_limit).select("fp").unionByName(warm).distinct()
    pairs = crowded.select(
        "fp",
        F.explode(F.expr("""
            flatten(transform(sequence(1, 63), i -> transform(sequence(0, i - 1), j ->
                struct(i * 64 + j as at, fp & ~((1L << i) | (1L << j)) as rest))))
        """)).alias("node"),
    ).select("fp", "node.*")
    heavy = (  # no more than the four values of two bits share a place and the rest
        pairs.withColumn("v", F.expr("min(fp) over (partition by at, rest)"))
        .where("fp <> v")
        .select(F.col("fp").alias("u"), "v")
    )
    return light.unionByName(heavy).distinct()


def near_duplicates(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, fingerprint, component_id)``, a row per input row.

    * Null, empty and wordless texts have fingerprint zero and are linked like any other.
    * ``component_id`` is the smallest ``doc_id`` reachable; null ids do not count, and a group of
      null ids alone has a null component.
    * Ties and repeated rows share a fingerprint and so a component; other columns are not read.
    * ``doc_id`` is a number or the text of one; an empty table gives an empty result.
    """
    prints = settle(fingerprints(docs), "fingerprints")
    is_hot = F.col("n") * HOT_SHARE > F.lit(prints.count())
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).select("fp", "rep", is_hot.alias("hot"))
    distinct = settle(distinct, "distinct")
    labels = component_labels(links(distinct.select("fp"), bucket_limit))
    rooted = settle(distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root")), "rooted")
    # components are of fingerprints; each is named by the smallest document it holds
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_print = settle(split_join(rooted, named, hot_keys(rooted, "root"), "root").select("fp", "component_id"), "components")
    return split_join(prints, of_print, distinct.where("hot"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
