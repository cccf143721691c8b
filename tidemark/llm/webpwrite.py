"""Writing lossless WebP: many images of byte samples at a time.

For each image the cheaper of several forms is taken, by the bits that it is estimated to need:
pixels as they are, predicted from the pixel above or to the left, with red and blue relative to
green, or a palette for images of few colours. The pixels then are literals, back-references or
colour-cache entries under prefix codes of their own. All pixels of a block of images are searched,
counted and packed by whole arrays, and so are the codes and their tables. An image's bytes depend on its
own pixels only.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np

from .webp import ALPHABETS, CACHE_HASH, LENGTH_ORDER, WIDTH, container

#: Rows of an image; a longer text is a run of images, which are read in step.
ROWS = 16
CACHE_BITS = 6
#: Pixels, and images, that are worked on at once.
PIXELS, IMAGES = 1 << 19, 1 << 10
LONGEST_CODE = 10
#: Fewest pixels of a back-reference, and the longest that one symbol pair reaches.
SHORTEST, LONGEST = 4, 4096
#: Estimated bits of a used symbol in the table of a code.
SYMBOL_BITS = 5.0
COLOURS = 16
_GREEN = 256 + 24


class Writer:
    """Bits of a header, least significant first."""

    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def code_lengths(counts: list[int], longest: int = LONGEST_CODE) -> list[int]:
    """Lengths of a complete prefix code for positive counts, two or more, by merging the rarest; counts
    are evened out until no length is over ``longest``."""
    n = len(counts)
    while True:
        heap = [c << 12 | i for i, c in enumerate(counts)]
        heapq.heapify(heap)
        up = [0] * (2 * n - 1)
        for node in range(n, 2 * n - 1):
            a = heapq.heappop(heap)
            b = heap[0]
            up[a & 4095] = up[b & 4095] = node
            heapq.heapreplace(heap, ((a >> 12) + (b >> 12)) << 12 | node)
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth[:n]) <= longest:
            return depth[:n]
        counts = [c // 2 + 1 for c in counts]


def code_lengths_of(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """``code_lengths`` of each row of counts, 0 for unused symbols; a symbol alone has 1.

    Counts in order and merged ones, which come in order too, are two queues, of whose heads the
    smaller is taken: a merge of each row in a turn.
    """
    used = (counts > 0).sum(axis=1)
    out = (counts > 0).astype(np.int64)
    rows = np.flatnonzero(used > 1)
    todo = counts[rows]
    while len(rows):
        by_use = np.argsort(-used[rows], kind="stable")  # rows in work are always the first ones
        rows, todo = rows[by_use], todo[by_use]
        depth = _depths(todo, used[rows])
        out[rows] = depth
        over = depth.max(axis=1) > longest
        rows, todo = rows[over], todo[over]
        todo = np.where(todo > 0, todo // 2 + 1, 0)
    return out


def _depths(counts: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Depth of each symbol in its row's tree; rows have two symbols or more, and fall by their number."""
    n, most = len(counts), int(used[0])
    none = np.iinfo(np.int64).max
    order = np.argsort(np.where(counts > 0, counts, none), axis=1, kind="stable")[:, :most]
    leaves = np.full((n, most + 2), none)
    leaves[:, :most] = np.take_along_axis(counts, order, axis=1)
    leaves[:, :most][np.arange(most) >= used[:, None]] = none
    merged = np.full((n, most + 1), none)
    queues = np.concatenate([leaves, merged], axis=1)  # one row: leaves, then merged nodes
    wide = queues.shape[1]
    queues = queues.ravel()
    up = np.zeros(len(queues), np.int64)
    leaf = np.arange(n) * wide
    node = leaf + most + 2
    first = node.copy()
    alive = np.searchsorted(-used, -np.arange(1, most), side="left")  # rows with a merge left, for each turn
    for turn, k in enumerate(alive.tolist()):
        total = 0
        for _ in range(2):
            a, b = queues[leaf[:k]], queues[node[:k]]
            small = a <= b
            up[np.where(small, leaf[:k], node[:k])] = turn
            total = total + np.where(small, a, b)
            leaf[:k] += small
            node[:k] += ~small
        queues[first[:k] + turn] = total
    depth = np.zeros((n, most), np.int64)
    flat, start = depth.ravel(), np.arange(n) * most
    for turn in range(most - 3, -1, -1):  # the last merge is the root
        k = int(alive[turn + 1])
        flat[start[:k] + turn] = flat[start[:k] + up[first[:k] + turn]] + 1
    leaf_up = up.reshape(n, wide)[:, :most]
    found = np.take_along_axis(depth, leaf_up, axis=1) + 1
    found[np.arange(most) >= used[:, None]] = 0
    out = np.zeros(counts.shape, np.int64)
    np.put_along_axis(out, order, found, axis=1)
    return out


_REVERSED = np.array([int(format(v, "015b")[::-1], 2) for v in range(1 << 15)], np.int64)


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical words, as they are read, of symbols with these lengths (0: unused)."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order]
    size = np.int64(1) << (15 - n)
    out = np.zeros(len(lengths), np.int64)
    out[order] = _REVERSED[np.cumsum(size) - size]
    return out


@functools.cache
def _gap(n: int) -> tuple[list[int], list[str]]:
    """Length symbols for ``n`` unused symbols in a row, and their extra bits as digits."""
    kinds, extras = [], []
    while n >= 11:
        run = min(n, 138)
        kinds.append(18), extras.append(format(run - 11, "07b"))
        n -= run
    if n >= 3:
        return [*kinds, 17], [*extras, format(n - 3, "03b")]
    return kinds + [0] * n, extras + [""] * n


def code_words_of(lengths: np.ndarray) -> np.ndarray:
    """``code_words`` of each row."""
    order = np.argsort(np.where(lengths, lengths, 16).astype(np.uint8), axis=1, kind="stable")
    n = np.take_along_axis(lengths, order, axis=1)
    size = np.where(n, np.int64(1) << (15 - n), 0)
    out = np.empty_like(lengths)
    np.put_along_axis(out, order, np.where(n, _REVERSED[np.minimum(np.cumsum(size, axis=1) - size, 32767)], 0), axis=1)
    return out


def put_code(w: Writer, lengths: np.ndarray, times: int = 1) -> None:
    """A prefix code by the lengths of its symbols, zeros in runs; one symbol alone by its number."""
    own = Writer()
    _put_code(own, lengths)
    for _ in range(times):
        w.put(own.value, own.size)


def _put_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        a, *b = used.tolist() or [0]
        w.put(1, 1), w.put(len(b), 1), w.put(1, 1), w.put(a, 8)
        if b:
            w.put(b[0], 8)
        return
    kinds, extras = [], []  # length symbols, and their extra bits as digits
    at = 0
    for s, n in zip(used.tolist(), lengths[used].tolist()):
        if s > at:
            k, e = _gap(s - at)
            kinds += k
            extras += e
        kinds.append(n), extras.append("")
        at = s + 1
    whole = len(kinds) + 2 > len(lengths)  # too little to leave out: the rest of the alphabet is written
    if whole:
        kinds += [0] * (len(lengths) - at)
        extras += [""] * (len(lengths) - at)
    counts = np.bincount(kinds, minlength=19)
    own = _lengths(counts, 7)
    words = code_words(own).tolist()
    own = own.tolist()
    count = max(max(i for i, k in enumerate(LENGTH_ORDER) if own[k]) + 1, 4)
    w.put(0, 1), w.put(count - 4, 4)
    for k in LENGTH_ORDER[:count]:
        w.put(own[k], 3)
    w.put(int(not whole), 1)
    if not whole:
        need = max(1, (len(kinds) - 2).bit_length() + 1 >> 1)
        w.put(need - 1, 3), w.put(len(kinds) - 2, 2 * need)
    alone = (counts > 0).sum() == 1  # a code of one word has no bits
    digits = ["" if alone or not n else format(words[k], f"0{n}b") for k, n in enumerate(own)]
    bits = "".join([e + digits[k] for k, e in zip(reversed(kinds), reversed(extras))])
    w.put(int(bits or "0", 2), len(bits))


def put_codes(lengths: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``put_code`` of each row of lengths, of which so many are the alphabet: row, value and number of bits
    of each piece, in the order of rows."""
    n = len(lengths)
    row, symbol = np.nonzero(lengths)
    used = np.bincount(row, minlength=n)
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    before = np.where(first, -1, np.concatenate([[-1], symbol[:-1]])) if len(row) else symbol
    last = np.zeros(n, np.int64)
    last[row] = symbol
    brief = (used <= 2) & (last < 256)
    low = np.zeros(n, np.int64)
    low[row[first]] = symbol[first]
    two = used == 2
    short = np.flatnonzero(brief)
    pieces = [(short, (5 | two << 1 | low << 3 | np.where(two, last, 0) << 11)[short], (11 + 8 * two)[short], np.zeros(len(short), np.int64))]

    keep = ~brief[row]
    row, symbol, gap = row[keep], symbol[keep], (symbol - before - 1)[keep]
    full, left = gap // 138, gap % 138
    long_runs = full + (left >= 11)
    left = np.where(left >= 11, 0, left)
    run = (left >= 3).astype(np.int64)
    each = long_runs + run + np.where(run, 0, left) + 1
    entry = np.repeat(np.arange(len(row)), each)
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(each) - each, each)
    is_long, is_run, is_last = nth < long_runs[entry], (nth == long_runs[entry]) & (run[entry] > 0), nth == each[entry] - 1
    kind = np.where(is_long, 18, np.where(is_run, 17, np.where(is_last, lengths[row, symbol][entry], 0)))
    more = np.where(is_long, np.where(nth < full[entry], 138, (gap % 138)[entry]) - 11, np.where(is_run, left[entry] - 3, 0))
    n_more = np.where(is_long, 7, np.where(is_run, 3, 0))
    row = row[entry]
    many = np.bincount(row, minlength=n)
    whole = ~brief & (many + 2 > sizes)  # too little to leave out: the rest of the alphabet is written
    rest = np.repeat(np.arange(n), np.where(whole, sizes - last - 1, 0))
    if len(rest):
        order = np.argsort(np.concatenate([row, rest]), kind="stable")
        nothing = np.zeros(len(rest), np.int64)
        row, kind, more, n_more = (np.concatenate(x)[order] for x in ((row, rest), (kind, nothing), (more, nothing), (n_more, nothing)))

    counts = np.bincount(row * 19 + kind, minlength=n * 19).reshape(n, 19)
    own = code_lengths_of(counts, 7)
    words = code_words_of(own)
    stored = own[:, list(LENGTH_ORDER)]
    count = np.maximum(19 - (stored[:, ::-1] > 0).argmax(axis=1), 4)
    head = (count - 4) << 1 | (stored << (5 + 3 * np.arange(19))).sum(axis=1)
    least = many - 2
    need = np.maximum(1, (np.searchsorted(1 << np.arange(16), least, side="right") + 1) >> 1)
    tail = np.where(whole, 0, 1 | (need - 1) << 1 | least << 4)
    table = np.flatnonzero(~brief)
    pieces.append((table, head[table], (5 + 3 * count)[table], np.zeros(len(table), np.int64)))
    pieces.append((table, tail[table], np.where(whole, 1, 4 + 2 * need)[table], np.ones(len(table), np.int64)))
    own[(counts > 0).sum(axis=1) == 1] = 0  # a code of one word has no bits
    bits = own[row, kind]
    pieces.append((row, words[row, kind] | more << bits, bits + n_more, np.full(len(row), 2)))
    row, value, width, part = (np.concatenate(x) for x in zip(*pieces))
    order = np.argsort(row * 3 + part, kind="stable")
    return row[order], value[order], width[order]


def _number(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols of lengths or distances, their extra bits and how many."""
    v = values - 1
    top = np.zeros(len(v), np.int64)
    big = v >= 4
    top[big] = np.floor(np.log2(v[big])).astype(np.int64)
    extra = np.where(big, top - 1, 0)
    half = (v >> np.maximum(top - 1, 0)) & 1
    return np.where(big, 2 * top + half, v), np.where(big, v & ((np.int64(1) << extra) - 1), 0), extra


def _before(image: np.ndarray, key: np.ndarray, few: int = 0) -> np.ndarray:
    """Place of the last pixel with the same image and key before each, -1 for none; ``few`` is one more
    than the greatest key, if that is small."""
    if few and (int(image[-1]) + 1) * few <= 1 << 16:
        mixed = (image * few + key).astype(np.uint16)  # sorted by digits
    else:
        mixed = key.astype(np.uint64) ^ (image.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(mixed, kind="stable")
    image, key = image[order], key[order]
    same = (key[1:] == key[:-1]) & (image[1:] == image[:-1])
    out = np.full(len(key), -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def _copies(image: np.ndarray, pixel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of back-references: runs of places whose next three pixels stood
    before at one distance."""
    n = len(pixel)
    if n < 4:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    p = pixel.astype(np.uint64)
    three = p.copy()
    three[:-2] = (p[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (p[2:] << np.uint64(29))
    whole = np.zeros(n, bool)
    whole[:-2] = image[2:] == image[:-2]
    place = np.flatnonzero(whole)
    prev = np.full(n, -1, np.int64)
    found = _before(image[place], three[place])
    hit = found >= 0
    prev[place[hit]] = place[found[hit]]
    at = np.flatnonzero(prev >= 0)
    sure = (pixel[at] == pixel[prev[at]]) & (pixel[at + 1] == pixel[prev[at] + 1]) & (pixel[at + 2] == pixel[prev[at] + 2])
    far = np.zeros(n, np.int64)
    far[at[sure]] = at[sure] - prev[at[sure]]
    edge = np.flatnonzero((far != np.concatenate([[0], far[:-1]])) | np.concatenate([[True], image[1:] != image[:-1]]))
    start = edge[far[edge] > 0]
    if not len(start):
        return start, start, start
    end = np.concatenate([edge, [n]])[np.searchsorted(edge, start) + 1]
    follows = np.concatenate([start[1:], [n + 9]])  # the next run, which the last two pixels of a run may reach into
    length = np.minimum(np.minimum(end - start + 2, follows - start), LONGEST)
    good = length >= SHORTEST
    return start[good], length[good], far[start[good]]


def _cost(image: np.ndarray, symbol: np.ndarray, n: int, size: int) -> np.ndarray:
    """Bits of each image's symbols under its own code, the table included."""
    counts = np.bincount(image * size + symbol, minlength=n * size).reshape(n, size)
    total = counts.sum(axis=1)
    logs = np.log2(np.maximum(counts, 1))
    return total * np.log2(np.maximum(total, 1)) - (counts * logs).sum(axis=1) + SYMBOL_BITS * (counts > 0).sum(axis=1)


def _transformed(rgb: np.ndarray, kind: int) -> np.ndarray:
    """Rows of an image after a transform: 1 predicted from above, 2 from the left, 3 relative to green."""
    out = rgb.copy()
    if kind in (1, 2):
        out[1:, 0] = rgb[1:, 0] - rgb[:-1, 0]
        out[0, 1:] = rgb[0, 1:] - rgb[0, :-1]
        if kind == 1:
            out[1:, 1:] = rgb[1:, 1:] - rgb[:-1, 1:]
        else:
            out[1:, 1:] = rgb[1:, 1:] - rgb[1:, :-1]
    elif kind == 3:
        signed = rgb[..., 1].astype(np.int8).astype(np.int64)
        out[..., 0] = rgb[..., 0] - (32 * signed >> 5).astype(np.uint8)
        out[..., 2] = rgb[..., 2] - (32 * signed >> 5).astype(np.uint8)
    return out


class Image:
    """An image's header so far, and the pixels that are left to code."""

    __slots__ = ("writer", "pixels", "rgb")

    def __init__(self, rgb: np.ndarray):
        self.rgb, self.writer, self.pixels = rgb, Writer(), None
        w = self.writer
        w.put(0x2F, 8), w.put(rgb.shape[1] - 1, 14), w.put(rgb.shape[0] - 1, 14), w.put(0, 4)

    def side_image(self, colours: list[tuple[int, int, int, int]]) -> None:
        """A small image (green, red, blue, alpha of each pixel) under codes of its own, without references."""
        w = self.writer
        w.put(0, 1)
        codes = []
        for k, size in enumerate(ALPHABETS[:4]):
            counts = np.bincount([c[k] for c in colours], minlength=size)
            lengths = _lengths(counts)
            put_code(w, lengths)
            codes.append((code_words(lengths).tolist(), (lengths if (lengths > 0).sum() > 1 else np.zeros(size, np.int64)).tolist()))
        put_code(w, np.zeros(40, np.int64))
        for c in colours:
            for k in range(4):
                w.put(codes[k][0][c[k]], codes[k][1][c[k]])

    def plain(self, words: np.ndarray) -> None:
        self.writer.put(0, 1)
        self.pixels = words

    def transform(self, kind: int) -> None:
        w = self.writer
        w.put(1, 1)
        if kind in (1, 2):  # one block of a mode: 2 from above, 1 from the left
            w.put(0, 2), w.put(7, 3)
            mode = 2 if kind == 1 else 1
        else:
            w.put(1, 2), w.put(7, 3)
        blocks = -(-self.rgb.shape[1] >> 9) * -(-self.rgb.shape[0] >> 9)
        colour = (mode, 0, 0, 255) if kind in (1, 2) else (32, 0, 32, 255)  # green to blue, red to blue, green to red
        self.side_image([colour] * blocks)
        w.put(0, 1)
        self.pixels = _argb(_transformed(self.rgb, kind))

    def palette(self, colours: np.ndarray, index: np.ndarray) -> None:
        """Colours as words, and each pixel's place among them; several places share a pixel."""
        w, height = self.writer, self.rgb.shape[0]
        w.put(1, 1), w.put(3, 2), w.put(len(colours) - 1, 8)
        channels = colours.astype("<u4").view(np.uint8).reshape(-1, 4)
        steps = np.diff(channels, axis=0, prepend=np.zeros((1, 4), np.uint8))
        self.side_image([(int(c[1]), int(c[2]), int(c[0]), int(c[3])) for c in steps])
        w.put(0, 1)
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        bits, each = 8 >> packed, 1 << packed
        wide = -(-index.shape[1] // each) * each
        grid = np.zeros((height, wide), np.int64)
        grid[:, : index.shape[1]] = index
        bundled = (grid.reshape(height, -1, each) << (np.arange(each) * bits)).sum(axis=2)
        self.pixels = (bundled << 8 | 0xFF000000).ravel()


def _argb(rgb: np.ndarray) -> np.ndarray:
    c = rgb.reshape(-1, 3).astype(np.int64)
    return c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2] | 0xFF000000


def _lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used):
        out[used] = code_lengths(counts[used].tolist(), longest) if len(used) > 1 else 1
    return out


def _guesses(images: list[np.ndarray], flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Pixels of all images after each transform of ``_transformed``, in its order; 0 is none."""
    yield flat
    wide = np.array([rgb.shape[1] for rgb in images])[owner]
    inside = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[owner]
    left = np.concatenate([np.zeros((1, 3), np.uint8), flat[:-1]])
    left[inside == 0] = 0
    above = flat[np.maximum(np.arange(len(flat)) - wide, 0)]
    yield flat - np.where((inside < wide)[:, None], left, above)
    yield flat - np.where(((inside % wide == 0) & (inside > 0))[:, None], above, left)
    yield _transformed(flat, 3)


def _prepared(images: list[np.ndarray]) -> list[Image]:
    """Images with the transform of the least estimated bits of literals."""
    out = [Image(rgb) for rgb in images]
    sizes = np.array([rgb.shape[0] * rgb.shape[1] for rgb in images])
    owner = np.repeat(np.arange(len(images)), sizes)
    twice = np.repeat(owner, 2)
    costs = np.zeros((4, len(images)))
    flat = np.concatenate([rgb.reshape(-1, 3) for rgb in images])
    for kind, changed in enumerate(_guesses(images, flat, owner, sizes)):
        costs[kind] = _cost(owner, changed[:, 1], len(images), 256) + _cost(twice, changed[:, ::2].ravel(), len(images), 256)
    costs[1:] += 90  # the transform itself
    best = costs.argmin(axis=0)
    every = _argb(flat)
    for image, kind, end, size in zip(out, best.tolist(), np.cumsum(sizes).tolist(), sizes.tolist()):
        words = every[end - size : end]
        if len(set(words[: 4 * COLOURS].tolist())) <= COLOURS and len(np.unique(words[: 4 * WIDTH])) <= COLOURS:
            colours, index = np.unique(words, return_inverse=True)
            if len(colours) <= COLOURS:
                image.palette(colours, index.reshape(image.rgb.shape[:2]))
                continue
        image.transform(kind) if kind else image.plain(words)
    return out


def _cached(owner: np.ndarray, pixel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all pixels in the colour cache, and whether a pixel's slot holds it already."""
    slot = ((pixel * CACHE_HASH) & 0xFFFFFFFF) >> (32 - CACHE_BITS)
    prev = _before(owner, slot, 1 << CACHE_BITS)
    return slot, (prev >= 0) & (pixel[np.maximum(prev, 0)] == pixel)


def encode_images(images: list[np.ndarray]) -> list[bytes]:
    """WebP files of ``height x width x 3`` byte arrays (red, green, blue)."""
    if not images:
        return []
    prepared = _prepared(images)
    n = len(prepared)
    pixel = np.concatenate([i.pixels for i in prepared])
    owner = np.repeat(np.arange(n), [len(i.pixels) for i in prepared])
    start, length, far = _copies(owner, pixel)
    copied = np.zeros(len(pixel) + 1, np.int64)
    np.add.at(copied, start, 1), np.add.at(copied, start + length, -1)
    covered = np.cumsum(copied[:-1]) > 0
    slot, held = _cached(owner, pixel)

    covered[start] = False
    token = np.flatnonzero(~covered)  # literals and cache entries, and the starts of copies
    is_copy = np.zeros(len(pixel), bool)
    is_copy[start] = True
    own = owner[token]
    green, red, blue = (pixel[token] >> 8) & 255, (pixel[token] >> 16) & 255, pixel[token] & 255
    kind = is_copy[token]
    length_symbol, length_extra, length_bits = _number(length)
    far_symbol, far_extra, far_bits = _number(far + 120)
    symbol = green.copy()
    symbol[kind] = 256 + length_symbol
    size = _GREEN + (1 << CACHE_BITS)
    with_cache = symbol.copy()
    cacheable = held[token] & ~kind
    with_cache[cacheable] = _GREEN + slot[token][cacheable]
    literal = ~kind

    def bits(s: np.ndarray, lit: np.ndarray) -> np.ndarray:
        return _cost(own, s, n, size) + _cost(own[lit], red[lit], n, 256) + _cost(own[lit], blue[lit], n, 256)

    use = bits(with_cache, literal & ~cacheable) < bits(symbol, literal)
    symbol = np.where(use[own], with_cache, symbol)
    literal &= ~(use[own] & cacheable)

    greens = np.bincount(own * size + symbol, minlength=n * size).reshape(n, size)
    others = np.bincount(np.concatenate([own[literal] * 256 + red[literal], own[literal] * 256 + blue[literal]]), minlength=n * 256).reshape(n, 256)
    fars = np.bincount(own[kind] * 40 + far_symbol, minlength=n * 40).reshape(n, 40)
    # red and blue have one code, as neighbouring bytes of a text are alike
    every = np.zeros((3 * n, size), np.int64)
    every[:n], every[n : 2 * n, :256], every[2 * n :, :40] = greens, others, fars
    every = code_lengths_of(every)
    lengths = [every[:n], every[n : 2 * n, :256], every[2 * n :, :40]]
    head = _heads(every, use)
    tables = []
    for own_lengths in lengths:
        words = code_words_of(own_lengths)
        alone = (own_lengths > 0).sum(axis=1) < 2  # a code of one word has no bits
        words[alone], own_lengths[alone] = 0, 0
        tables.append((words, own_lengths))

    place = own * size + symbol
    value, width = (x.ravel().take(place) for x in tables[0])
    word, wide = tables[1]
    word, wide, at = word.ravel(), wide.ravel(), np.flatnonzero(literal)
    for channel in (red, blue):
        place = own[at] * 256 + channel[at]
        value[at] |= word.take(place) << width[at]
        width[at] += wide.take(place)
    for more, n_more in ((length_extra, length_bits), (tables[2][0][own[kind], far_symbol], tables[2][1][own[kind], far_symbol]), (far_extra, far_bits)):
        value[kind] |= more << width[kind]
        width[kind] += n_more
    return _packed(prepared, [head, (own, value, width)])


def _heads(lengths: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stands between an image's transforms and its tokens, as image, value and number of bits of each
    piece: use of the cache, no prefix groups, and the five codes. ``lengths``: greens, others, then distances."""
    n, image = len(use), np.arange(len(use))
    sizes = np.concatenate([np.where(use, lengths.shape[1], _GREEN), np.full(n, 256), np.full(n, 40)])
    row, value, width = put_codes(lengths, sizes)
    green, other, far = (slice(*np.searchsorted(row, [k * n, (k + 1) * n])) for k in range(3))
    pieces = [
        (image, np.where(use, 1 | CACHE_BITS << 1, 0), np.where(use, 6, 2)),
        (row[green], value[green], width[green]),
        *[(row[other] - n, value[other], width[other])] * 2,
        (image, np.full(n, 5 | 255 << 3), np.full(n, 11)),  # alpha is 255 alone
        (row[far] - 2 * n, value[far], width[far]),
    ]
    order = np.argsort(np.concatenate([8 * p[0] + k for k, p in enumerate(pieces)]), kind="stable")
    image, value, width = (np.concatenate(x)[order] for x in zip(*pieces))
    return image, value, width


def _packed(prepared: list[Image], runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[bytes]:
    """Files of the headers followed by the bits of each run: image, value and number of bits of its pieces."""
    head = np.array([i.writer.size for i in prepared], np.int64)
    sizes = [np.bincount(own, weights=width, minlength=len(prepared)).astype(np.int64) for own, _, width in runs]
    bits = head + sum(sizes)
    words = (bits + 63) // 64 + 1
    base = np.cumsum(words) - words
    out = np.zeros(int(words.sum()), np.uint64)
    begin = 64 * base + head
    for (own, value, width), size in zip(runs, sizes):
        at = (begin - (np.cumsum(size) - size))[own] + np.cumsum(width) - width
        begin += size
        place, shift = at >> 6, (at & 63).astype(np.uint64)
        v = value.astype(np.uint64)
        low = v << shift
        high = np.where(shift > 0, v >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        for part, to in ((low, place), (high, place + 1)):
            edge = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1])
            out[to[edge]] |= np.bitwise_or.reduceat(part, edge)
    raw = out.astype("<u8").tobytes()
    files = []
    for i, image in enumerate(prepared):
        n = int(bits[i] + 7) // 8
        k = 8 * int(base[i])
        lead = (int(head[i]) + 7) // 8
        mine = bytearray(raw[k : k + n])
        start = image.writer.value.to_bytes(lead, "little")
        mine[: lead - 1] = start[: lead - 1]
        mine[lead - 1] |= start[lead - 1]
        files.append(container(bytes(mine)))
    return files


def encode_payloads(payloads: list[bytes], width: int = WIDTH) -> list[bytes]:
    """Payloads (positive multiples of ``3 * width``) as runs of files of up to ``ROWS`` rows of pixels."""
    images, runs = [], []
    known: dict[bytes, int] = {}
    for p in payloads:
        rows = np.frombuffer(p, np.uint8).reshape(-1, width, 3)
        own = []
        for i in range(0, len(rows), ROWS):
            piece = rows[i : i + ROWS]
            key = piece.tobytes()
            if key not in known:
                known[key] = len(images)
                images.append(piece)
            own.append(known[key])
        runs.append(own)
    part = np.cumsum([i.shape[0] * i.shape[1] for i in images]) // PIXELS + np.arange(len(images)) // IMAGES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(images)]
    files = [f for a, b in zip(cuts, cuts[1:]) for f in encode_images(images[a:b])]
    return [b"".join(files[i] for i in own) for own in runs]
