"""Reading lossless WebP (VP8L) in NumPy.

Every feature of the format is read: prefix codes, back-references, colour cache, prefix groups by
block, and the predictor, cross-colour, subtract-green and palette transforms. ``decode_stream`` reads
one stream symbol by symbol; ``decode_streams`` reads many in step, a pixel of each at a time, as whole
arrays. Written from the public format description, RFC 9649; ``webpwrite`` is the encoder.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

#: Order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values: (x, y) offsets that the 120 short distance codes stand for.
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
ALPHABETS = (280, 256, 256, 256, 40)  # green with lengths (and cache), red, blue, alpha, distance
CACHE_HASH = 0x1E35A7BD
MAX_SIDE = 1 << 14
WIDTH = 192


class Bits:
    """Bits of a string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value

    def span(self, start: int, n: int) -> int:
        whole = int.from_bytes(self.data[start >> 3 : (start + n + 7) >> 3], "little") >> (start & 7)
        return whole & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)


@functools.cache
def _reversed(bits: int) -> np.ndarray:
    """Numbers of so many bits with their bits in the other order."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


class Code:
    """A canonical prefix code from the length of each symbol; 0: the symbol isn't used."""

    def __init__(self, lengths: bytes):
        self.key = bytes(lengths)
        every = np.frombuffer(self.key, np.uint8)
        self.symbols = np.flatnonzero(every)
        k = len(self.symbols)
        self.only = int(self.symbols[0]) if k == 1 else 0 if not k else None
        if self.only is not None:
            return
        self.lengths, self.table = every[self.symbols].astype(np.int64), None
        self.most = int(self.lengths.max())
        if int((np.int64(1) << (self.most - self.lengths)).sum()) != 1 << self.most:
            raise ValueError("prefix code is not complete")

    def entries(self, bits: int) -> np.ndarray:
        """``symbol << 4 | length`` by the next ``bits`` bits as they are read, least significant first."""
        if self.only is not None:
            return np.full(1 << bits, self.only << 4, np.uint16)
        order = np.argsort(self.lengths, kind="stable")
        n = self.lengths[order]
        out = np.empty(1 << bits, np.uint16)
        out[_reversed(bits)] = np.repeat((self.symbols[order] << 4 | n).astype(np.uint16), np.int64(1) << (bits - n))
        return out

    def _tabled(self) -> list[tuple[int, int]]:
        return [(e >> 4, e & 15) for e in self.entries(self.most).tolist()]

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.table = self._tabled()
        symbol, n = self.table[bits.peek(self.most)]
        bits.at += n
        return symbol


@functools.lru_cache(maxsize=4096)
def _length_table(lengths: bytes) -> tuple[list[tuple[int, int]], int]:
    """Entries and mask of a code of lengths, of which few are in use."""
    code = Code(lengths)
    return ([(code.only, 0)], 0) if code.only is not None else (code._tabled(), (1 << code.most) - 1)


def _read_code(bits: Bits, size: int) -> Code:
    lengths = bytearray(size)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    of_lengths = bytearray(19)
    for i in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[i]] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    table, mask = _length_table(bytes(of_lengths))
    at, before = 0, 8
    window, room = 0, -1
    while at < size and left:
        left -= 1
        if room < 14:  # a window of the stream as one number; an entry takes 14 bits at most
            if room >= 0:
                bits.at -= room
            i = bits.at >> 3
            window, room = int.from_bytes(bits.data[i : i + 60], "little") >> (bits.at & 7), 472
            bits.at += 472
        s, n = table[window & mask]
        window >>= n
        room -= n
        if s < 16:
            lengths[at] = s
            at, before = at + 1, s or before
            continue
        value, least, more = (before, 3, 2) if s == 16 else (0, 3, 3) if s == 17 else (0, 11, 7)
        n = least + (window & ((1 << more) - 1))
        window >>= more
        room -= more
        if at + n > size:
            raise ValueError("code lengths run over")
        if value:
            lengths[at : at + n] = bytes((value,)) * n
        at += n
    if room > 0:
        bits.at -= room
    return Code(lengths)


def _number(bits: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ``height x width`` ARGB words."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    which, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        which = (_image(bits, -(-width >> block), -(-height >> block), False) >> 8) & 0xFFFF
    extra = (1 << cache_bits) if cache_bits else 0
    groups = [
        [_read_code(bits, n + extra * (i == 0)) for i, n in enumerate(ALPHABETS)] for _ in range(1 if which is None else int(which.max()) + 1)
    ]
    n = width * height
    out: list[int] = []
    cache = [0] * extra
    codes = groups[0]
    while len(out) < n:
        at = len(out)
        if which is not None:
            codes = groups[which[at // width >> block, at % width >> block]]
        s = codes[0].read(bits)
        if s < 256:
            red, blue, alpha = codes[1].read(bits), codes[2].read(bits), codes[3].read(bits)
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length = _number(bits, s - 256)
            far = _number(bits, codes[4].read(bits))
            if far > 120:
                far -= 120
            else:
                x, y = NEIGHBOURS[far - 1]
                far = max(1, x + y * width)
            if far > at or at + length > n:
                raise ValueError("back-reference out of the image")
            new = [out[at - far + i % far] for i in range(length)]
        else:
            new = [cache[s - 280]]
        if cache_bits:
            for p in new:
                cache[((CACHE_HASH * p) & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        out += new
    return np.array(out, np.uint32).reshape(height, width)


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)  # blue, green, red, alpha


def _words(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).view("<u4")[..., 0].astype(np.uint32)


def _predicted(mode: int, left, top, top_left, top_right):
    mean = lambda a, b: (a + b) >> 1
    if mode == 11:
        grad = [a + b - c for a, b, c in zip(left, top, top_left)]
        nearer = sum(abs(g - a) for g, a in zip(grad, left)) < sum(abs(g - b) for g, b in zip(grad, top))
        return left if nearer else top
    each = {
        0: lambda L, T, TL, TR, a: 255 * a, 1: lambda L, T, TL, TR, a: L, 2: lambda L, T, TL, TR, a: T,
        3: lambda L, T, TL, TR, a: TR, 4: lambda L, T, TL, TR, a: TL, 5: lambda L, T, TL, TR, a: mean(mean(L, TR), T),
        6: lambda L, T, TL, TR, a: mean(L, TL), 7: lambda L, T, TL, TR, a: mean(L, T), 8: lambda L, T, TL, TR, a: mean(TL, T),
        9: lambda L, T, TL, TR, a: mean(T, TR), 10: lambda L, T, TL, TR, a: mean(mean(L, TL), mean(T, TR)),
        12: lambda L, T, TL, TR, a: min(255, max(0, L + T - TL)),
        13: lambda L, T, TL, TR, a: min(255, max(0, mean(L, T) + int((mean(L, T) - TL) / 2))),
    }.get(mode, lambda L, T, TL, TR, a: 255 * a)
    return [each(*v, k == 3) for k, v in enumerate(zip(left, top, top_left, top_right))]


def _unpredict(argb: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width = argb.shape
    used = np.unique(modes >> 8 & 15)
    if len(used) == 1 and used[0] in (1, 2):  # sums along rows or columns, modulo 256
        c = _channels(argb).copy()
        c[0, 0, 3] = (int(c[0, 0, 3]) + 255) & 255  # the first is predicted as opaque black
        if used[0] == 1:
            c[:, 0] = np.cumsum(c[:, 0], axis=0, dtype=np.uint8)
            return _words(np.cumsum(c, axis=1, dtype=np.uint8))
        c[0] = np.cumsum(c[0], axis=0, dtype=np.uint8)
        return _words(np.cumsum(c, axis=0, dtype=np.uint8))
    p = _channels(argb).astype(int).tolist()
    flat = [px for row in p for px in row]
    for i in range(height * width):
        y, x = divmod(i, width)
        if y == 0:
            guess = flat[i - 1] if x else [0, 0, 0, 255]
        elif x == 0:
            guess = flat[i - width]
        else:
            mode = int(modes[y >> block, x >> block]) >> 8 & 15
            guess = _predicted(mode, flat[i - 1], flat[i - width], flat[i - width - 1], flat[i - width + 1])
        flat[i] = [(a + b) & 255 for a, b in zip(flat[i], guess)]
    return _words(np.array(flat).reshape(height, width, 4))


def _uncross(argb: np.ndarray, elements: np.ndarray, block: int) -> np.ndarray:
    height, width = argb.shape
    y, x = np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block
    e = _channels(elements)[y, x].astype(np.int8).astype(int)
    green_red, green_blue, red_blue = e[..., 0], e[..., 1], e[..., 2]
    c = _channels(argb).astype(int)
    signed = lambda v: ((v + 128) & 255) - 128
    red = (c[..., 2] + (green_red * signed(c[..., 1]) >> 5)) & 255
    blue = (c[..., 0] + (green_blue * signed(c[..., 1]) >> 5) + (red_blue * signed(red) >> 5)) & 255
    return _words(np.stack([blue, c[..., 1], red, c[..., 3]], axis=-1))


def _unindex(argb: np.ndarray, table: np.ndarray, width: int, packed: int) -> np.ndarray:
    index = (argb >> 8) & 255
    if packed:
        size, x = 8 >> packed, np.arange(width)
        index = (index[:, x >> packed] >> ((x & ((1 << packed) - 1)) * size).astype(np.uint32)) & ((1 << size) - 1)
    return np.concatenate([table, np.zeros(256, np.uint32)])[index]


def _head(bits: Bits) -> tuple[int, int, list]:
    """Width of the coded pixels, height, and the transforms to undo, last one first."""
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            block = bits.read(3) + 2
            side = _image(bits, -(-coded >> block), -(-height >> block), False)
            undo.append((_unpredict if kind == 0 else _uncross, side, block))
        elif kind == 2:
            undo.append((lambda a: _words(_channels(a) + _channels(a)[..., 1:2] * np.array([1, 0, 1, 0], np.uint8)),))
        else:
            size = bits.read(8) + 1
            deltas = _channels(_image(bits, size, 1, False))[0]
            table = _words(np.cumsum(deltas, axis=0, dtype=np.uint64)[None] & 255)[0]
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((_unindex, table, coded, packed))
            coded = -(-coded >> packed)
    return coded, height, undo[::-1]


def decode_stream(data: bytes) -> np.ndarray:
    """A VP8L stream to ``height x width`` ARGB words, symbol by symbol."""
    bits = Bits(data)
    coded, height, undo = _head(bits)
    argb = _image(bits, coded, height, True)
    if bits.at > 8 * len(data):
        raise ValueError("image data ends early")
    for step, *rest in undo:
        argb = step(argb, *rest)
    return argb


#: Streams are read in step as long as their tables have so many entries, and they so many pixels and
#: number so many, together.
_ENTRIES, _PIXELS, _STREAMS = 1 << 23, 1 << 22, 1 << 12
_FAR = np.array([0, *(0 for _ in NEIGHBOURS)], np.int64), np.array([0, *(0 for _ in NEIGHBOURS)], np.int64)
_FAR[0][1:], _FAR[1][1:] = np.array(NEIGHBOURS).T
#: Turns after which streams are looked at for their end, and spare bytes that these can't read past.
_TURNS, _SPARE = 64, 2048
#: Least repeats and their extra bits of the symbols of a code of lengths.
_LEAST = np.array([1] * 16 + [3, 3, 11], np.int64)
_MORE = np.array([0] * 16 + [2, 3, 7], np.int64)


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """VP8L streams to ``height x width`` ARGB words. Streams without prefix groups and with one alpha
    value are read in step; others by themselves."""
    out: list[np.ndarray | None] = [None] * len(streams)
    ready = []
    for i, data in enumerate(streams):
        bits = Bits(data)
        coded, height, undo = _head(bits)
        cache = bits.read(4) if bits.read(1) else 0
        if bits.read(1):
            out[i] = decode_stream(data)
        else:
            ready.append((coded * height, i, data, bits.at, coded, height, undo, cache))
    ready.sort(key=lambda r: -r[0])
    while ready:
        k = min(int(np.searchsorted(np.cumsum([r[0] for r in ready]), _PIXELS)) + 1, _STREAMS)
        group, ready = ready[:k], ready[k:]
        for part, pixels in _in_steps(group):
            for (_, i, data, _, coded, height, undo, _), argb in zip(part, pixels):
                if argb is None:
                    out[i] = decode_stream(data)
                    continue
                argb = argb.reshape(height, coded)
                for step, *rest in undo:
                    argb = step(argb, *rest)
                out[i] = argb
    return out


class _Joined:
    """Streams one after another, with the bits of each from its place on."""

    def __init__(self, streams: list[bytes]):
        sizes = np.array([len(s) for s in streams], np.int64)
        self.begin = 8 * (np.cumsum(sizes) - sizes)
        self.stop = self.begin + 8 * sizes
        raw = np.frombuffer(b"".join(streams) + bytes(_SPARE), np.uint8)
        self.eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))

    def peek(self, p: np.ndarray) -> np.ndarray:
        """At least 57 bits from each place on."""
        return self.eight[p >> 3] >> (p & 7).astype(np.uint64)

    def part(self, p: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return self.peek(p).view(np.int64) & ((1 << n) - 1)


def _entries(lengths: np.ndarray, bits: int) -> np.ndarray:
    """``Code.entries`` of each row of lengths, one row after another."""
    used = (lengths > 0).sum(axis=1)
    n_rows = len(lengths)
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol].astype(np.int64)
    size = np.where(used[row] > 1, np.int64(1) << np.maximum(bits - n, 0), 1 << bits)
    n[used[row] < 2] = 0
    if (n > bits).any() or (np.bincount(row, weights=size, minlength=n_rows)[used > 0] != 1 << bits).any():
        raise ValueError("prefix code is not complete")
    order = np.argsort((row << 4 | n).astype(np.uint32 if n_rows > 4095 else np.uint16), kind="stable")
    out = np.zeros((n_rows, 1 << bits), np.uint16)
    flat = np.repeat((symbol << 4 | n).astype(np.uint16)[order], size[order]).reshape(-1, 1 << bits)
    out[np.flatnonzero(used)[:, None], _reversed(bits)] = flat
    return out.ravel()


def _lengths_in_step(joined: _Joined, pos: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Lengths of a code's symbols at a place of each stream, for alphabets of these sizes; places move on."""
    n, stop = len(pos), joined.stop
    lengths = np.zeros((n, int(sizes.max())), np.uint8)
    head = joined.peek(pos).view(np.int64)
    brief = (head & 1) == 1
    who, h = np.flatnonzero(brief), head[brief]
    two, wide = h >> 1 & 1, np.where(h >> 2 & 1, 8, 1)
    first, second = h >> 3 & ((1 << wide) - 1), h >> (3 + wide) & 255
    if (first >= sizes[who]).any() or (second >= sizes[who])[two == 1].any():
        raise ValueError("symbol out of its alphabet")
    lengths[who, first] = 1
    lengths[who[two == 1], second[two == 1]] = 1
    pos[who] += 3 + wide + 8 * two
    live = np.flatnonzero(~brief)
    if not len(live):
        return lengths
    count = 4 + (head[live] >> 1 & 15)
    three = (joined.peek(pos[live] + 5).view(np.int64)[:, None] >> (3 * np.arange(19)) & 7) * (np.arange(19) < count[:, None])
    own = np.zeros((len(live), 19), np.uint8)
    own[:, list(LENGTH_ORDER)] = three
    table = _entries(own, 7)
    p = pos[live] + 5 + 3 * count
    partly = joined.part(p, 1)
    bits = 2 + 2 * joined.part(p + 1, 3)
    left = np.where(partly, 2 + joined.part(p + 4, bits), sizes[live])
    p += np.where(partly, 4 + bits, 1)
    base, size = np.arange(len(live), dtype=np.int64) << 7, sizes[live]
    at, before = np.zeros(len(live), np.int64), np.full(len(live), 8)
    again = []  # runs of a length that is repeated
    while len(live):
        if (p > stop[live]).any():
            raise ValueError("image data ends early")
        window = joined.peek(p).view(np.int64)
        entry = table[base + (window & 127)].astype(np.int64)
        symbol, used = entry >> 4, entry & 15
        more = _MORE[symbol]
        run = _LEAST[symbol] + (window >> used & ((1 << more) - 1))
        if (at + run > size).any():
            raise ValueError("code lengths run over")
        plain = symbol < 16
        lengths[live, at] = np.where(plain, symbol, 0)
        same = symbol == 16
        if same.any():
            again.append((live[same], at[same], run[same], before[same]))
        before = np.where(plain & (symbol > 0), symbol, before)
        p += used + more
        at += run
        left -= 1
        pos[live] = p
        going = (at < size) & (left > 0)
        if not going.all():
            live, p, at, before, left, base, size = (x[going] for x in (live, p, at, before, left, base, size))
    for who, start, run, value in again:
        for r, s, k, v in zip(who.tolist(), start.tolist(), run.tolist(), value.tolist()):
            lengths[r, s : s + k] = v
    return lengths


def _in_steps(group: list[tuple]) -> Iterator[tuple[list[tuple], list[np.ndarray | None]]]:
    """Parts of a group of streams, longest first, and the pixels of each; None for a stream of several alphas."""
    joined = _Joined([r[2] for r in group])
    pos = joined.begin + np.array([r[3] for r in group], np.int64)
    cache = np.array([r[7] for r in group], np.int64)
    codes = [_lengths_in_step(joined, pos, np.full(len(group), n) if k else n + np.where(cache, 1 << cache, 0)) for k, n in enumerate(ALPHABETS)]
    opaque = (codes[3] > 0).sum(axis=1) < 2
    if not opaque.all():
        other = [r for r, single in zip(group, opaque.tolist()) if not single]
        yield other, [None] * len(other)
    rows = np.flatnonzero(opaque)
    if not len(rows):
        return
    wide = max(1, *(int((x * ((x > 0).sum(axis=1) > 1)[:, None]).max()) for x in (codes[k][rows] for k in (0, 1, 2, 4))))
    most = max(1, _ENTRIES >> wide)
    for i in range(0, len(rows), most):
        own = rows[i : i + most]
        part = [group[r] for r in own.tolist()]
        yield part, _in_step(part, joined, own, pos[own], [c[own] for c in codes], wide)


def _in_step(group: list[tuple], joined: _Joined, own: np.ndarray, pos: np.ndarray, codes: list[np.ndarray], wide: int) -> list[np.ndarray]:
    """Pixels of streams, longest first, as ARGB words; a pixel of each stream in a turn."""
    u64, i64 = np.uint64, np.int64
    n = len(group)
    sizes = np.array([r[0] for r in group], i64)
    stop, peek = joined.stop[own], joined.peek
    greens, reds, fars = (_entries(codes[k], wide) for k in (0, 1, 4))
    blues = reds if np.array_equal(codes[1], codes[2]) else _entries(codes[2], wide)
    mask, table = u64((1 << wide) - 1), np.arange(n, dtype=i64) << wide
    alpha = codes[3].argmax(axis=1).astype(i64) << 24
    width = np.array([r[4] for r in group], i64)
    caches = np.array([r[7] for r in group], i64)
    cached = bool(caches.any())
    held_from = np.cumsum(1 << caches) - (1 << caches)
    held = np.zeros(int((1 << caches).sum()), i64)
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), i64)
    at, end = begin.copy(), begin + sizes
    left, far = np.zeros(n, i64), np.zeros(n, i64)
    live = np.arange(n)

    def number(symbol: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
        more = (window & ((u64(1) << extra.astype(u64)) - u64(1))).view(i64)
        return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << extra) + more + 1), extra

    copying = turn = 0
    while len(live):
        turn += 1
        if turn % _TURNS == 0 and (pos > stop).any():
            raise ValueError("image data ends early")
        here = live if not copying else live[left[live] == 0]
        if len(here):
            p, t = pos[here], table[here]
            window = peek(p)
            g = greens[t + (window & mask).view(i64)].astype(i64)
            size, symbol = g & 15, g >> 4
            rest = window >> size.astype(u64)
            r = reds[t + (rest & mask).view(i64)].astype(i64)
            rest >>= (r & 15).astype(u64)
            b = blues[t + (rest & mask).view(i64)].astype(i64)
            value = (r >> 4) << 16 | symbol << 8 | b >> 4 | alpha[here]
            used = size + (r & 15) + (b & 15)
            other = np.flatnonzero(symbol >= 256)
            if len(other):
                used[other] = size[other]
                stored = other[symbol[other] >= 280]
                if len(stored):
                    value[stored] = held[held_from[here[stored]] + symbol[stored] - 280]
                copies = other[symbol[other] < 280]
                if len(copies):
                    who, start = here[copies], p[copies] + size[copies]
                    length, extra = number(symbol[copies] - 256, peek(start))
                    start += extra
                    d = fars[table[who] + (peek(start) & mask).view(i64)].astype(i64)
                    start += d & 15
                    distance, extra = number(d >> 4, peek(start))
                    near = np.minimum(distance, 120)
                    distance = np.where(distance > 120, distance - 120, np.maximum(1, _FAR[0][near] + _FAR[1][near] * width[who]))
                    if (distance > at[who] - begin[who]).any() or (length > end[who] - at[who]).any():
                        raise ValueError("back-reference out of the image")
                    used[copies] = start + extra - p[copies]
                    left[who], far[who] = length, distance
                    copying += len(copies)
            pos[here] += used
            out[at[here]] = value
        if copying:
            who = live[left[live] > 0]
            out[at[who]] = out[at[who] - far[who]]
            left[who] -= 1
            copying -= int((left[who] == 0).sum())
        if cached:
            p = out[at[live]]
            held[held_from[live] + (((p * CACHE_HASH) & 0xFFFFFFFF) >> (32 - caches[live]))] = p
        at[live] += 1
        done = at[live] == end[live]
        if done.any():
            live = live[~done]
    if (pos > stop).any():
        raise ValueError("image data ends early")
    out = out.astype(np.uint32)
    return [out[a:b] for a, b in zip(begin, end)]


def _split(media: bytes) -> list[bytes]:
    """Lossless streams of the WebP files that stand one after another in ``media``."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        size = int.from_bytes(media[at + 16 : at + 20], "little")
        out.append(media[at + 20 : at + 20 + size])
        at += 8 + int.from_bytes(media[at + 4 : at + 8], "little")
    return out


def decode(media: bytes) -> list[np.ndarray]:
    """Pixel arrays, ``height x width x 3`` (red, green, blue), of one or more WebP files."""
    return decode_all([media])[0]


def decode_all(media: list[bytes]) -> list[list[np.ndarray]]:
    """``decode`` of many values; equal streams are read once."""
    runs = [_split(m) for m in media]
    known: dict[bytes, int] = {}
    for s in (s for run in runs for s in run):
        known.setdefault(s, len(known))
    images = [_channels(argb)[..., 2::-1] for argb in decode_streams(list(known))]
    return [[images[known[s]] for s in run] for run in runs]


def container(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def uses(data: bytes) -> set[str]:
    """Which features of the format a stream without prefix groups uses."""
    bits = Bits(data)
    _, _, undo = _head(bits)
    names = {_unpredict: "predictor", _uncross: "cross-colour", _unindex: "palette"}
    found = {names.get(step, "subtract-green") for step, *_ in undo}
    cache = bits.read(4) if bits.read(1) else 0
    if bits.read(1):
        return found | {"groups"}
    codes = [_read_code(bits, n + (((1 << cache) if cache else 0) if k == 0 else 0)) for k, n in enumerate(ALPHABETS)]
    if any(c.only is None for c in codes):
        found.add("prefix codes")
    if any(256 <= s < 280 for s in codes[0].symbols):
        found.add("back-references")
    if any(s >= 280 for s in codes[0].symbols):
        found.add("colour cache")
    return found
