"""Operator 6: best-fit packing with certified bounds.

Documents become token pieces of at most ``capacity``. Pieces are dealt into groups of bounded size;
each group packs its own by best-fit decreasing and holds the number of bins against a lower bound
from dual feasible functions. A group that meets its bound is done, but for bins under half full.
The others keep their full bins and put the pieces of the rest into a pool, which is dealt anew:
groups exchange documents and pack again, until the bounds are met, one group is left, or a round
leaves as many loose pieces as the one before. ``certificate`` tells what gap to the bound of all
pieces remains.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_blocks
from .common import giving_back, settle
from .vocab import merge_encoder

CAPACITY = 2048
#: Pieces that one task packs at once.
GROUP = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merge_encoder(path)
        for b in text_blocks(batches):
            ids, counts = encoder.encode(b.column("text"))
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts).tolist()
            tail = int(end_id).to_bytes(4, "little")
            rows: list[tuple] = []
            at = 0
            for doc, end in zip(b.column("doc_id").to_pylist(), ends):
                own = raw[4 * at : 4 * end] + tail
                n, at = end - at + 1, end
                k = -(-n // capacity)
                cuts = [0, *range(n - (k - 1) * capacity, n + 1, capacity)]
                rows += [(doc, i, s, e - s, zlib.crc32(own[4 * s : 4 * e])) for i, (s, e) in enumerate(zip(cuts, cuts[1:]))]
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return giving_back(run)


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every document; only those longer than ``capacity`` are cut, and of their
    pieces only the first may be shorter."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(_pieces(path, end_id, capacity), PIECES)


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that no packing can do without, from the number of items of each length: the best of the dual
    feasible functions that round items over ``capacity - k`` up to a bin and those under ``k`` down to
    nothing."""
    n, mass = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    k = np.arange(0, capacity // 2 + 1)
    big = n[-1] - n[capacity - k]
    below = np.where(k > 0, mass[np.maximum(k - 1, 0)], 0)
    return int((big + -(-(mass[capacity - k] - below) // capacity)).max())


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity) if len(lengths) else 0


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill; items are taken longest first, as given
    among equals. Open bins are kept by room, and a bit mask finds the tightest that fits."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if room > n:
            by_room[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, np.array(fills, np.int64)


def _packer(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, fills = best_fit(lengths, capacity)
        gap = len(fills) - lower_bound(lengths, capacity)
        loose = fills < (capacity if gap else capacity // 2)
        return pdf.assign(bin=bins, offset=offsets, loose=loose[bins], gap=gap)

    return pack


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int | None = None) -> DataFrame:
    """``items(doc_id, piece, start, length, ids_crc32)`` with ``sequence_id`` and ``offset``.

    Every row is placed once; repeated rows and null ids are items of their own; an empty table
    gives an empty result. ``length`` is 1 to ``capacity``."""
    pool = items.withColumn("at", F.monotonically_increasing_id())
    parts: list[DataFrame] = []
    left, gained, base = pool.count(), None, 0
    for r in itertools.count():
        groups = max(1, -(-left // group))
        dealt = pool.withColumn("g", F.pmod(F.xxhash64("at", F.lit(r)), F.lit(groups)))
        packed = settle(
            dealt.groupBy("g").applyInPandas(
                _packer(capacity), f"{PIECES}, at long, g long, bin long, offset long, loose boolean, gap long"
            ),
            "packed",
        )
        seen = packed.agg(F.count_if("loose").alias("loose"), (F.coalesce(F.max("bin"), F.lit(0)) + 1).alias("bins")).first()
        # a round's sequences are numbered from a place of its own, and a group's within it
        packed = packed.withColumn("sequence_id", F.lit(base) + F.col("g") * F.lit(seen["bins"]) + F.col("bin"))
        base += groups * seen["bins"]
        last = groups == 1 or r + 1 == rounds or seen["loose"] == 0 or (gained is not None and seen["loose"] >= gained)
        parts.append(packed if last else packed.where("not loose"))
        if last:
            break
        pool, left, gained = packed.where("loose").select(*items.columns, "at"), seen["loose"], seen["loose"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """``sequences`` used, the ``bound`` that no packing of all pieces can go below, and the ``gap``; the
    driver gets a count per length, ``capacity`` at most."""
    counts = {r["length"]: r["n"] for r in packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    bound = bound_of_counts(np.array([counts.get(k, 0) for k in range(capacity + 1)], np.int64), capacity)
    used = packed.select("sequence_id").distinct().count()
    return {"sequences": used, "bound": bound, "gap": used - bound}


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place: a row per piece. Null and empty texts are the end
    id alone; a null id and repeated rows are documents of their own; ``doc_id`` is a number or the text
    of one; other columns are not read; an empty table gives an empty result."""
    return pack(settle(pieces(docs, path, end_id, capacity), "pieces"), capacity)
