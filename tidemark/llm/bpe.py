"""Operator 4: byte-level BPE encoding and decoding with a segment tree of pair ranks.

A word starts as one symbol per byte. Leaf ``i`` of a segment tree holds the rank of the pair that
starts at live byte position ``i``, with the position in its low bits, so the root is the leftmost
minimum. A merge kills one leaf, changes two, and repairs three paths to the root: logarithmic
work, whatever the word's length.

Words of up to ``WIDE`` symbols are merged many at a time, one tree per row of an array, so that the
point updates of thousands of words are single array operations; longer words have a tree each.
Texts are cut at spaces that a non-space follows, where the pattern always starts a new match, and
ids of chunks are remembered within a bound (``ChunkEncoder``).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDE = 64
_ROWS = 4096
_NONE = np.int64(1) << 40
#: Distinct chunks, and words, of 64 bytes at most that a task remembers; others are encoded anew each
#: time they are met.
REMEMBERED = 340_000
#: Text a task works on at once, in characters.
BLOCK = 2_000_000


class PairTable:
    """``(left symbol, right symbol) -> rank`` as an open-addressing hash table for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.merged = merged.astype(np.int64)
        keys = (left.astype(np.int64) << 20) | right.astype(np.int64)
        self.bits = max(12, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int64)
        left_over, slot = np.arange(len(keys)), self._slot(keys)
        while len(left_over):
            free = self.keys[slot[left_over]] == -1
            self.keys[slot[left_over[free]]] = keys[left_over[free]]
            won = self.keys[slot[left_over]] == keys[left_over]
            self.ranks[slot[left_over[won]]] = rank[left_over[won]]
            left_over = left_over[~won]
            slot[left_over] = (slot[left_over] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, ``_NONE`` for pairs that don't merge or that have a symbol below 0."""
        keys = (left << 20) | right
        slot = self._slot(keys)
        there = self.keys[slot]
        out = self.ranks[slot]
        wrong = np.flatnonzero((there != keys) & (there != -1))
        out[there == -1] = _NONE
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[wrong]]
            out[wrong] = np.where(there == keys[wrong], self.ranks[slot[wrong]], _NONE)
            wrong = wrong[(there != keys[wrong]) & (there != -1)]
        out[(left < 0) | (right < 0)] = _NONE
        return out

    @functools.cached_property
    def as_dict(self) -> dict[int, int]:
        used = self.keys >= 0
        return dict(zip(self.keys[used].tolist(), self.ranks[used].tolist()))


def _merge_rows(sym: np.ndarray, length: np.ndarray, table: PairTable) -> np.ndarray:
    """Merge every row of ``sym`` (rows x width, -1 after a row's ``length``); dead symbols become -1."""
    rows, width = sym.shape
    shift = int(width).bit_length()
    none = _NONE << shift
    at = np.arange(width)
    tree = np.full((rows, 2 * width), none, np.int64)
    ranks = table.find(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(rows, width - 1)
    tree[:, width : 2 * width - 1] = np.where(ranks < _NONE, (ranks << shift) | at[:-1], none)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    # a row of links has a spare place at its end, for what follows the last symbol and precedes the first
    nxt = np.minimum(at + 1, length[:, None])
    nxt = np.where(nxt >= length[:, None], width, nxt)
    nxt = np.concatenate([nxt, np.full((rows, 1), width)], axis=1).ravel()
    prv = np.concatenate([np.broadcast_to(at - 1, (rows, width)), np.zeros((rows, 1), np.int64)], axis=1)
    prv[:, 0] = width
    prv = prv.ravel()
    syms = np.concatenate([sym, np.full((rows, 1), -1)], axis=1).ravel()
    flat, live = tree.ravel(), np.arange(rows)

    def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        base, node = row * (2 * width), leaf + width
        flat[base + node] = value
        while node[0] > 1:
            node = node >> 1
            low = base + 2 * node
            flat[base + node] = np.minimum(flat[low], flat[low + 1])

    while len(live):
        best = flat[live * (2 * width) + 1]
        live = live[best < none]
        if not len(live):
            break
        best = best[best < none]
        pos, new = best & ((1 << shift) - 1), table.merged[best >> shift]
        base = live * (width + 1)
        gone = nxt[base + pos]
        after, before = nxt[base + gone], prv[base + pos]
        syms[base + pos], syms[base + gone] = new, -1
        nxt[base + pos] = after
        prv[base + after] = pos
        put(live, gone, np.full(len(live), none))
        right = table.find(new, syms[base + after])
        put(live, pos, np.where(right < _NONE, (right << shift) | pos, none))
        has = before < width
        if has.any():
            row, b = live[has], before[has]
            left = table.find(syms[base[has] + b], new[has])
            put(row, b, np.where(left < _NONE, (left << shift) | b, none))
    return syms.reshape(rows, width + 1)[:, :width]


def _merge_long(sym: list[int], table: PairTable) -> list[int]:
    """One word of any length with a segment tree of its own."""
    n, ranks = len(sym), table.as_dict
    width = 1 << (n - 1).bit_length()
    none, shift = (1 << 62), n.bit_length()

    def key(i: int, j: int) -> int:
        r = ranks.get((sym[i] << 20) | sym[j]) if 0 <= i and j < n else None
        return none if r is None else (r << shift) | i

    tree = [none] * (2 * width)
    tree[width : width + n] = [key(i, i + 1) for i in range(n)]
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            i >>= 1
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                break
            tree[i] = low

    while tree[1] < none:
        rank, pos = tree[1] >> shift, tree[1] & ((1 << shift) - 1)
        gone = nxt[pos]
        after, before = nxt[gone], prv[pos]
        sym[pos], sym[gone] = int(table.merged[rank]), -1
        nxt[pos] = after
        if after < n:
            prv[after] = pos
        put(gone, none)
        put(pos, key(pos, after))
        if before >= 0:
            put(before, key(before, pos))
    return [s for s in sym if s >= 0]


def merge(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Words as concatenated start symbols and their lengths to concatenated ids and their counts."""
    starts = np.cumsum(lengths) - lengths
    counts = np.zeros(len(lengths), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    low, width = 0, 8
    while width <= WIDE:
        group = np.flatnonzero((lengths > low) & (lengths <= width))
        for i in range(0, len(group), _ROWS):
            g = group[i : i + _ROWS]
            inside = np.arange(width) < lengths[g][:, None]
            grid = np.full((len(g), width), -1, np.int64)
            grid[inside] = symbols[(starts[g][:, None] + np.arange(width))[inside]]
            done = _merge_rows(grid, lengths[g], table)
            counts[g] = (done >= 0).sum(axis=1)
            parts.append((g, done[done >= 0]))
        low, width = width, width * 2
    for w in np.flatnonzero(lengths > WIDE):
        ids = _merge_long(symbols[starts[w] : starts[w] + lengths[w]].tolist(), table)
        counts[w] = len(ids)
        parts.append((np.array([w]), np.array(ids, np.int64)))
    out_starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    for g, ids in parts:
        out[spread(out_starts[g], counts[g])] = ids
    return out, counts


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of all runs ``starts[i] .. starts[i] + counts[i] - 1``, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


#: Letters that the patterns take as one run whatever stands around it, and that no normaliser composes.
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"


class ByteCoder:
    """Ids of a rank file's vocabulary, as the library that reads such files gives them."""

    #: A space before a run of letters belongs to the run's match.
    takes_space = True
    #: Strings in a text that have an id of their own.
    special: dict[str, int] = {}

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pieces = regex.compile(pattern)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            self.bytes_of[r] = token
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.start = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.table = PairTable(np.array(left), np.array(right), np.array(rank), np.arange(len(self.bytes_of)))
        self.memory = _Memory(self.words)

    def symbols(self, raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.start[raw]

    def plain(self, text: str) -> str:
        """A text as the pattern sees it."""
        return text

    def plain_letters(self, runs: pa.Array) -> pa.Array:
        """``plain`` of runs of ``_LETTERS``."""
        return runs

    def words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches of the pattern, concatenated, and how many each has."""
        edges, raw = _bytes(words)
        counts = np.ones(len(words), np.int64)
        todo, whole = np.arange(len(words)), None
        if self.ranks:
            whole = np.array(list(map(self.ranks.get, words.cast(pa.large_binary()).to_pylist(), itertools.repeat(-1))), np.int64)
            todo = np.flatnonzero(whole < 0)
        lengths = np.diff(edges)[todo]
        symbols = self.symbols(raw[spread(edges[todo], lengths)], lengths)
        merged, counts[todo] = merge(symbols, lengths, self.table)
        if whole is None:
            return merged, counts
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        out[starts[whole >= 0]] = whole[whole >= 0]
        out[spread(starts[todo], counts[todo])] = merged
        return out, counts

    def encode_many(self, values: pa.LargeStringArray, spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Strings, each after a space if ``spaced``, to their concatenated ids and the count of each.
        Runs of letters are a match as they are; others go through the pattern. Words are remembered."""
        before = " " if spaced and self.takes_space else ""
        lettered = pc.match_substring_regex(values, _LETTERS)
        runs = self.plain_letters(values.filter(lettered))
        if before:
            runs = pc.binary_join_element_wise(pa.scalar(before, pa.large_string()), runs, pa.scalar("", pa.large_string()))
        lettered = lettered.to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~lettered)
        found = [self.pieces.findall(self.plain(before + t)) for t in values.take(pa.array(rest)).to_pylist()]
        flat = pa.concat_arrays([runs, pa.array([w for ws in found for w in ws], pa.large_string())])
        ids, starts, n = self.memory.look_up(flat)
        ids = ids[spread(starts, n)]
        # places of the values' ids in the order that they were looked up in
        per = np.concatenate([np.ones(len(runs), np.int64), np.fromiter(map(len, found), np.int64, len(found))])
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(per)] if len(per) else per
        counts = np.empty(len(values), np.int64)
        starts = np.empty(len(values), np.int64)
        order = np.concatenate([np.flatnonzero(lettered), rest])
        counts[order] = np.diff(ends, prepend=0)
        starts[order] = ends - counts[order]
        return ids[spread(starts, counts)], counts

    def encode(self, text: str) -> list[int]:
        return self.encode_many(pa.array([text], pa.large_string()))[0].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _bytes(values: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the strings, from 0, and their bytes with 16 more."""
    edges = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    raw = values.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if raw is not None else np.empty(0, np.uint8)
    return edges - edges[0], np.concatenate([raw, np.zeros(16, np.uint8)])


_SPACE = re.compile(r"\s")
#: First bytes of white space in UTF-8, and of characters some of which are white space.
_SPACE_BYTES = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a string that is its own key in the table of a memory, and of the longest that is remembered.
_SHORT, _LONG = 15, 64


class _Memory:
    """Ids of strings by place; the first ``REMEMBERED`` of up to ``_LONG`` bytes stay, others are
    encoded anew.

    Strings of up to 15 bytes are their own keys, two words of bytes and length, in an
    open-addressing table that whole arrays are looked up in; longer ones are in a dictionary."""

    def __init__(self, encode_many: Callable[[pa.LargeStringArray], tuple[np.ndarray, np.ndarray]]):
        self.encode_many = encode_many
        self.bits = max(4, (REMEMBERED * 3 // 2).bit_length())
        self.rows = np.zeros((1 << self.bits, 3), np.uint64)  # first bytes, other bytes and length, place
        self.long: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def _keys(values: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edges, raw = _bytes(values)
        start, length = edges[:-1], np.diff(edges)
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        low = eight[start] & _MASK[np.minimum(length, 8)]
        high = eight[start + 8] & _MASK[np.clip(length - 8, 0, 7)]
        return low, high | (np.minimum(length, 254) + 1).astype(np.uint64) << np.uint64(56), length

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        slot = self._slot(low, high)
        row = self.rows[slot]
        same = (row[:, 0] == low) & (row[:, 1] == high)
        out = np.where(same, row[:, 2].astype(np.int64), -1)
        wrong = np.flatnonzero(~same & (row[:, 1] != 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            row = self.rows[slot[wrong]]
            same = (row[:, 0] == low[wrong]) & (row[:, 1] == high[wrong])
            out[wrong[same]] = row[same, 2].astype(np.int64)
            wrong = wrong[~same & (row[:, 1] != 0)]
        return out

    def _put(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> None:
        left, slot = np.arange(len(low)), self._slot(low, high)
        while len(left):
            free = left[self.rows[slot[left], 1] == 0]
            self.rows[slot[free]] = np.stack([low[free], high[free], place[free].astype(np.uint64)], axis=1)
            row = self.rows[slot[left]]
            left = left[(row[:, 0] != low[left]) | (row[:, 1] != high[left])]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def look_up(self, values: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all places in use now, and the start and count of each of ``values``."""
        low, high, length = self._keys(values)
        at = self._find(low, high)
        longer = np.flatnonzero(length > _SHORT)
        if len(longer):
            names = values.take(pa.array(longer)).to_pylist()
            at[longer] = np.fromiter(map(self.long.get, names, itertools.repeat(-1)), np.int64, len(names))
        ids, starts, counts = self.ids, self.starts, self.counts
        missing = np.flatnonzero(at < 0)
        if len(missing):
            coded = values.take(pa.array(missing)).dictionary_encode()
            names, kept = coded.dictionary, len(counts)
            more, n = self.encode_many(names)
            starts = np.concatenate([starts, len(ids) + np.cumsum(n) - n])
            counts, ids = np.concatenate([counts, n]), np.concatenate([ids, more.astype(np.int32)])
            at[missing] = kept + coded.indices.to_numpy()
            self._keep(names.slice(0, max(0, REMEMBERED - kept)), ids, starts, counts)
        return ids, starts[at], counts[at]

    def _keep(self, names: pa.LargeStringArray, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        end = len(self.counts) + len(names)
        if not len(names):
            return
        low, high, length = self._keys(names)
        place = np.arange(len(self.counts), end)
        short, longer = length <= _SHORT, (length > _SHORT) & (length <= _LONG)
        self._put(low[short], high[short], place[short])
        if longer.any():
            self.long.update(zip(names.filter(pa.array(longer)).to_pylist(), place[longer].tolist()))
        self.starts, self.counts = starts[:end], counts[:end]
        self.ids = ids[: int(starts[end - 1] + counts[end - 1])]


class ChunkEncoder:
    """Ids of whole texts from ids of their chunks between single spaces.

    A text is cut before each space only if a non-space follows every space in it, or if the coder's
    matches hold no white space at all; other texts are encoded as they are. Special strings are cut
    out of a text before all else.
    """

    def __init__(self, coder: ByteCoder):
        self.coder = coder
        self.spaced = _Memory(lambda values: coder.encode_many(values, spaced=True))
        self.special = re.compile("|".join(map(re.escape, sorted(coder.special, key=len, reverse=True)))) if coder.special else None

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids of all texts (no nulls) and how many each has."""
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        texts = texts.cast(pa.large_string())
        spaces = texts if self.coder.takes_space else pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(spaces, " ")
        edges = lists.offsets.to_numpy().astype(np.int64)
        chunks = lists.values.slice(edges[0], edges[-1] - edges[0])
        edges -= edges[0]
        first = edges[:-1]
        marked = np.zeros(len(texts), bool)
        for s in self.coder.special:
            marked |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        slow = marked | self._odd(chunks, first) if self.coder.takes_space else marked
        whole = np.flatnonzero(slow)
        ids, starts, counts = self.spaced.look_up(chunks)
        # the first chunk of a text has no space before it; of a slow text it stands for the whole
        heads = chunks.take(pa.array(first)).to_pylist()
        for i in whole.tolist():
            heads[i] = "" if marked[i] else texts[i].as_py()
        head_ids, head_counts = self.coder.encode_many(pa.array(heads, pa.large_string()))
        starts[first] = len(ids) + np.cumsum(head_counts) - head_counts
        counts[first] = head_counts
        parts = [ids, head_ids]
        counts[spread(first[whole] + 1, np.diff(edges)[whole] - 1)] = 0
        for i in np.flatnonzero(marked).tolist():
            own = self._with_special(texts[i].as_py())
            starts[first[i]], counts[first[i]] = sum(map(len, parts)), len(own)
            parts.append(own)
        return np.concatenate(parts)[spread(starts, counts)].astype(np.int32, copy=False), np.add.reduceat(counts, first)

    def _odd(self, chunks: pa.LargeStringArray, first: np.ndarray) -> np.ndarray:
        """Texts with a chunk, not their first, that is empty or begins with white space."""
        at, raw = _bytes(chunks)
        odd = np.diff(at) == 0
        doubtful = np.flatnonzero(~odd & _SPACE_BYTES[raw[at[:-1]]])
        odd[doubtful] = [_SPACE.match(c) is not None for c in chunks.take(pa.array(doubtful)).to_pylist()]
        odd[first] = False
        return np.add.reduceat(odd.astype(np.int64), first) > 0

    def _with_special(self, text: str) -> np.ndarray:
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.coder.encode(text[at : m.start()]), self.coder.special[m[0]]]
            at = m.end()
        return np.array([*out, *self.coder.encode(text[at:])], np.int32)


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str, pattern: str) -> tuple[ByteCoder, ChunkEncoder]:
    coder = ByteCoder(path, pattern)
    return coder, ChunkEncoder(coder)


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about ``size`` characters, so that long texts don't add up."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = int(lengths.sum())
        run = (np.cumsum(lengths) - lengths) * max(1, -(-total // size)) // max(1, total)
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
        for i, j in zip(edges, edges[1:]):
            if j > i:
                yield b.slice(i, j - i)


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, encoder = byte_encoder(path, pattern)
        decimal = list(map(str, range(len(coder.bytes_of))))
        for b in text_blocks(batches):
            ids, counts = encoder.encode(b.column("text"))
            ids, ends = ids.tolist(), np.cumsum(counts).tolist()
            coded, decoded, at = [], [], 0
            for end in ends:
                own, at = ids[at:end], end
                coded.append(hashlib.sha256(" ".join(map(decimal.__getitem__, own)).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = byte_encoder(path, pattern)
        for b in text_blocks(batches):
            ids, counts = encoder.encode(b.column("text"))
            edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], ["doc_id", "ids"])

    return run


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, ids array<int>)``, a row per input row.

    Null and empty texts have no ids; null ids and repeated rows stay as they are; ``doc_id`` is a number
    or the text of one; other columns are not read; an empty table gives an empty result."""
    return _slim(docs).mapInArrow(_ids(path, pattern), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row: the digests of its ids, as
    decimals joined by spaces, and of the bytes that the ids decode to. Cases as in ``encode``."""
    return _slim(docs).mapInArrow(
        _digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
