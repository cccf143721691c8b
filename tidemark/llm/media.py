"""Operator 2: media columns. Payloads are stored as lossless WebP, decoded to pixel arrays and described."""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp, webpwrite
from .bpe import BLOCK, text_blocks
from .common import files_of, forget, giving_back, settle

UNIT = 3 * webp.WIDTH  # 576
#: Runs over the media in which pixel arrays are written, described and deleted.
WAVES = 3
STORED = "doc_id long, n_bytes long, media binary"
ARRAYS = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, height int, width int, pixels binary"
DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_blocks(batches):
        raw = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
        media = webpwrite.encode_payloads([payload(t) for t in raw])
        sizes = pa.array([len(t) for t in raw], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text's UTF-8 bytes, padded with 255 to a positive multiple
    of 576, as RGB samples of lossless WebP images 192 pixels wide, one after another."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(giving_back(_store), STORED)


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_blocks(batches, "media", 2 * BLOCK):
        doc, n, media = (b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))
        rows = [
            (d, k, len(m), hashlib.sha256(m).hexdigest(), sum(map(len, images)), images[0].shape[1], b"".join(i.tobytes() for i in images))
            for d, k, m, images in zip(doc, n, media, webp.decode_all(media))
        ]
        yield _columns(rows, ARRAYS)


def pixels(stored: DataFrame) -> DataFrame:
    """``stored(doc_id, n_bytes, media)`` to pixel arrays: ``height x width`` samples of red, green and
    blue as one binary column, beside the size and digest of the media."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(giving_back(_decode), ARRAYS)


def feature(samples: np.ndarray, height: int, width: int) -> str:
    """Size, mean of each channel, and the entropy of the samples in bits."""
    means = "/".join(f"{samples[k::3].sum(dtype=np.int64) * 3 / len(samples):.3f}" for k in range(3))
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    return f"{width}x{height};{means};{abs(float(-(p * np.log2(p)).sum())):.4f}"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_blocks(batches, "pixels"):
        rows = []
        for doc, n, size, sha, height, width, read in zip(*(b.column(x.split()[0]).to_pylist() for x in ARRAYS.split(", "))):
            rows.append((
                doc, n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), size, sha,
                feature(np.frombuffer(read, np.uint8), height, width),
            ))
        yield _columns(rows, DIGEST)


def describe(arrays: DataFrame) -> DataFrame:
    """Digests and a feature of a table of pixel arrays."""
    return arrays.mapInArrow(giving_back(_digest), DIGEST)


def _waves(stored: DataFrame) -> list[DataFrame]:
    """A settled table as up to ``WAVES`` tables, by its files; each has files for all cores, as far as they go."""
    spark, files = stored.sparkSession, files_of(stored)
    n = max(1, min(WAVES, len(files) // spark.sparkContext.defaultParallelism))
    return [spark.read.schema(stored.schema).parquet(*files[i::n]) for i in range(n)] if n > 1 else [stored]


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Store every text of ``docs(doc_id, text, ...)`` as media in the shared folder, read the files back,
    write their pixel arrays, and describe those: a row per input row.

    The media stay in the folder. Arrays are larger than the texts, so they are written and described in
    ``WAVES`` runs over the files of media, if there are enough of them, and those of a run are deleted
    before the next one.

    Null and empty texts are one unit of padding; equal texts give equal values; null ids and
    repeated rows stay as they are; other columns are not read; ``doc_id`` is a number or the text of
    one; an empty table gives an empty result.
    """
    described = []
    for wave in _waves(settle(store(docs), "media", compression="zstd")):
        arrays = settle(pixels(wave), "pixels", compression="zstd")
        described.append(settle(describe(arrays), "digests", compression="zstd"))
        forget(arrays)
    return functools.reduce(DataFrame.unionByName, described)
