"""Ordered line diff of text pairs.

Texts stay in Spark: lines are split and hashed by column functions, and only the arrays of hashes go to a
small array routine, which gives the places of the changed runs. Hunks are then cut out of the lines again by
column functions. A pair is a row, so pairs are spread over all tasks and nothing is shuffled.

Matching: equal lines of a pair are points ``(i, j)``; points that follow each other on a diagonal are runs. The
longest run (of equally long ones the first in the text before, then in the one after) is kept, and both corners
beside it are searched in the same way with the runs that reach into them. In texts of 200 and more lines,
lines that make up more than a hundredth of the text after begin no run; runs grow over them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of lines, and from what length of text which share of it makes a line popular.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
POPULAR_FROM, POPULAR_SHARE = 200, 100
#: Points of one pair that are held at a time; more are found in slices of the text before.
POINTS = 1 << 21


def split_lines(text: Column) -> Column:
    """The lines of a text; an end of line at its end begins no line, null and empty texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in ``a`` and ``b`` and lengths of the maximal diagonal runs of equal entries."""
    order = np.argsort(b, kind="stable")
    values, first, count = np.unique(b[order], return_index=True, return_counts=True)
    if len(b) >= POPULAR_FROM:
        count = np.where(count > len(b) // POPULAR_SHARE + 1, 0, count)
    at = np.minimum(np.searchsorted(values, a), len(values) - 1)
    n = np.where(values[at] == a, count[at], 0)
    parts, edges = [], [0, *(np.flatnonzero(np.diff(np.cumsum(n) // POINTS)) + 1).tolist(), len(a)]
    for lo, hi in zip(edges, edges[1:]):
        i = np.repeat(np.arange(lo, hi), n[lo:hi])
        j = order[np.repeat(first[at[lo:hi]], n[lo:hi]) + np.arange(len(i)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])]
        along = np.lexsort((i, j - i))
        i, j = i[along], j[along]
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)])) if len(i) else np.zeros(0, np.int64)
        parts.append((i[begins], j[begins], np.diff(np.append(begins, len(i)))))
    i, j, size = (np.concatenate(p) for p in zip(*parts))
    if len(parts) > 1:  # runs that go on in the next slice
        along = np.lexsort((i, j - i))
        i, j, size = i[along], j[along], size[along]
        new = np.concatenate([[True], (np.diff(j - i) != 0) | (i[1:] != i[:-1] + size[:-1])])
        size = np.add.reduceat(size, np.flatnonzero(new))
        i, j = i[new], j[new]
    return i, j, size


def matches(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """``(i, j, n)`` in order: ``a[i:i + n] == b[j:j + n]`` is kept by the diff; runs that touch are one."""
    if not len(a) or not len(b):
        return []
    found: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b), *_runs(a, b))]
    while todo:
        alo, ahi, blo, bhi, i, j, size = todo.pop()
        cut = np.maximum(np.maximum(alo - i, blo - j), 0)
        i, j = i + cut, j + cut
        size = np.minimum(size - cut, np.minimum(ahi - i, bhi - j))
        inside = size > 0
        i, j, size = i[inside], j[inside], size[inside]
        if len(i):
            best = np.lexsort((j, i, -size))[0]
            x, y, n = int(i[best]), int(j[best]), int(size[best])
        else:  # popular lines alone can still go on from the corner
            x, y, n = alo, blo, 0
        while x > alo and y > blo and a[x - 1] == b[y - 1]:
            x, y, n = x - 1, y - 1, n + 1
        while x + n < ahi and y + n < bhi and a[x + n] == b[y + n]:
            n += 1
        if n:
            found.append((x, y, n))
            corners = [(alo, x, blo, y), (x + n, ahi, y + n, bhi)]
            todo += [(*c, i, j, size) for c in corners if c[0] < c[1] and c[2] < c[3]]
    found.sort()
    out: list[tuple[int, int, int]] = []
    for x, y, n in found:
        if out and out[-1][0] + out[-1][2] == x and out[-1][1] + out[-1][2] == y:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((x, y, n))
    return out


def changes(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(i, m, j, n)``: ``m`` lines from ``i`` on give way to ``n`` lines from ``j`` on, counted from 0."""
    out, i, j = [], 0, 0
    for x, y, n in [*matches(a, b), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append((i, x - i, j, y - j))
        i, j = x + n, y + n
    return out


_PLACES = ("before_at", "before_n", "after_at", "after_n")


def _hunks(before: pa.Array, after: pa.Array) -> pa.Array:
    found = [[dict(zip(_PLACES, h)) for h in changes(*(v.values.to_numpy(zero_copy_only=False) for v in pair))] for pair in zip(before, after)]
    return pa.array(found, pa.list_(pa.struct([(name, pa.int32()) for name in _PLACES])))


def line_diff(pairs: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """``(keys, hunk, before_at, before_n, after_at, after_n, removed, added)``: the changed runs of each pair of
    texts in their order, numbered from 1; lines are counted from 0. Moved and repeated lines count. A null
    text has no lines; equal texts have no row; repeated pairs are pairs of their own.

    Two unlike lines count as equal where their 64-bit hashes do."""
    made = pairs.select(*keys, split_lines(F.col(before)).alias("_before"), split_lines(F.col(after)).alias("_after"))
    # equal texts, most of a stable series, need no work
    made = made.where(~(F.col("_before") == F.col("_after")))
    hashes = [F.transform(c, lambda line: F.xxhash64(line)) for c in ("_before", "_after")]
    hunks = F.arrow_udf(_hunks, f"array<struct<{', '.join(f'{name} int' for name in _PLACES)}>>")
    each = made.withColumn("_hunks", hunks(*hashes)).select(*keys, "_before", "_after", F.posexplode("_hunks").alias("_at", "_h"))
    part = lambda lines, at, n: F.slice(lines, F.col(f"_h.{at}") + 1, F.col(f"_h.{n}"))
    return each.select(
        *keys, (F.col("_at") + 1).alias("hunk"), "_h.*", part("_before", "before_at", "before_n").alias("removed"), part("_after", "after_at", "after_n").alias("added")
    )


def unified(hunks: DataFrame) -> DataFrame:
    """``hunks`` of ``line_diff`` with ``text``: a header and the lines with their marks, without context."""
    span = lambda at, n: F.when(F.col(n) == 1, (F.col(at) + 1).cast("string")).otherwise(
        F.concat_ws(",", F.when(F.col(n) == 0, F.col(at)).otherwise(F.col(at) + 1).cast("string"), F.col(n).cast("string"))
    )
    head = F.concat(F.lit("@@ -"), span("before_at", "before_n"), F.lit(" +"), span("after_at", "after_n"), F.lit(" @@"))
    marked = lambda c, mark: F.transform(c, lambda line: F.concat(F.lit(mark), line))
    return hunks.withColumn("text", F.array_join(F.concat(F.array(head), marked("removed", "-"), marked("added", "+")), "\n"))


def diff_summary(hunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, hunks, lines_removed, lines_added)`` of the pairs that changed."""
    return hunks.groupBy(*keys).agg(F.count("*").alias("hunks"), F.sum("before_n").alias("lines_removed"), F.sum("after_n").alias("lines_added"))
