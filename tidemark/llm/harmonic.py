"""Operator 11: harmonic packing of token pieces.

A piece of length ``n`` is of the class ``k = capacity // n``, lengths from above ``capacity / (k + 1)`` to
``capacity / k``, and a class's sequences hold ``k`` pieces each, whatever they are. Nothing else is looked
at, so every task fills sequences of its own as its rows go by: there is no shuffle and no round trip, and a
lost task is simply run again.

Documents may be cut, so they are cut where the classes are exact: into pieces of the whole capacity and, for
what is left, of falling powers of two, each a reciprocal of the capacity. ``k`` such pieces fill a sequence
to the last token. A task holds the pieces of its open sequences, fewer than two for each token of the
capacity; when its rows end it lays them out by falling length, which again leaves no gap, and parts the last
sequence into powers of two, which need no padding. With ``cut`` off only documents over the capacity are
cut, and a class's sequences are padded by what its lengths lack.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_blocks
from .common import giving_back, text_or_empty
from .vocab import merge_encoder

CAPACITY = 2048
#: Classes of documents that aren't cut; shorter ones are one class more, whose sequences are filled in turn.
CLASSES = 64
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_KINDS = [pa.field(c.split()[0], pa.int64()) for c in PACKED.split(", ")]


def cuts(n: int, capacity: int = CAPACITY, exact: bool = True) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens, in their order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        out.append(1 << (rest.bit_length() - 1) if exact else rest)
        rest -= out[-1]
    return out


class Filler:
    """One task's sequences. A piece is ``(doc_id, start, length, crc, doc_tokens)``."""

    def __init__(self, capacity: int, classes: int, first: int):
        self.capacity, self.classes, self.next = capacity, classes, first
        self.open: dict[int, list[tuple]] = {}
        self.fill = 0  # of the class of short pieces
        self.done: list[tuple] = []

    def _close(self, held: list[tuple]) -> None:
        at = 0
        for piece in held:
            self.done.append((*piece, self.next, at))
            at += piece[2]
        self.next += 1

    def add(self, piece: tuple) -> None:
        k = self.capacity // piece[2]
        if k > self.classes:
            k = self.classes + 1
            if self.fill + piece[2] > self.capacity:
                self._close(self.open.pop(k))
                self.fill = 0
            self.fill += piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k <= self.classes:
            self._close(self.open.pop(k))

    def end(self) -> None:
        """Lay out the pieces of open sequences, the longest first."""
        left = sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2])
        now: list[tuple] = []
        fill = 0
        for piece in left:
            if fill + piece[2] > self.capacity:
                self._close(now)
                now, fill = [], 0
            now.append(piece)
            fill += piece[2]
        while now:  # parted where a power of two is reached exactly
            top, at, n = 1 << (fill.bit_length() - 1), 0, 0
            while at < top:
                at += now[n][2]
                n += 1
            n = n if at == top else len(now)
            self._close(now[:n])
            now, fill = now[n:], fill - at
        self.open = {}

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def _batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KINDS)], schema=pa.schema(_KINDS))


def _packed(path: str, end_id: int, capacity: int, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merge_encoder(path)
        # a task numbers its sequences from a place of its own
        filler = Filler(capacity, capacity if cut else CLASSES, TaskContext.get().partitionId() << 40)
        tail = int(end_id).to_bytes(4, "little")
        for b in text_blocks(batches):
            ids, counts = encoder.encode(b.column("text"))
            raw, at = ids.astype("<u4").tobytes(), 0
            for doc, end in zip(b.column("doc_id").to_pylist(), np.cumsum(counts).tolist()):
                own = raw[4 * at : 4 * end] + tail
                n, at, start = end - at + 1, end, 0
                for length in cuts(n, capacity, cut):
                    filler.add((doc, start, length, zlib.crc32(own[4 * start : 4 * (start + length)]), n))
                    start += length
            yield _batch(filler.take())
        filler.end()
        yield _batch(filler.take())

    return giving_back(run)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, cut: bool = True) -> DataFrame:
    """``docs(doc_id, text, ...)`` to a row per piece with its place, ``PACKED``; ``start`` is the place of a
    piece in its document, ``doc_tokens`` the document's ids with the end id.

    Null and empty texts are the end id alone; null ids and repeated rows are documents of their own; ``doc_id``
    is a number or the text of one; other columns are not read; an empty table gives an empty result.
    A capacity that is no power of two is an error, unless ``cut`` is off. Sequence ids are unique, not dense."""
    if cut and capacity & (capacity - 1):
        raise ValueError("exact classes need a capacity that is a power of two")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return slim.mapInArrow(_packed(path, end_id, capacity, cut), PACKED)


def padding(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """``sequences``, their ``tokens`` and the ``padded`` places: up to the capacity, none at a power of two."""
    fills = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    short = F.when(F.expr("n & (n - 1)") == 0, F.lit(0)).otherwise(F.lit(capacity) - F.col("n"))
    found = fills.agg(F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(short), F.lit(0)).alias("padded")).first()
    return found.asDict()
