"""The decoder against streams written bit by bit here, with every feature of the format."""

import collections

import numpy as np
import pytest

from tidemark.llm import media, webp, webpwrite


def both(data):
    """A stream's pixels, alone and in step with another copy."""
    alone = webp.decode_stream(data)
    for other in webp.decode_streams([data, data]):
        assert (other == alone).all()
    return alone


class Stream(webpwrite.Writer):
    def fixed(self, lengths):
        """A normal prefix code from explicit lengths, each stored with a four-bit code."""
        self.put(0, 1), self.put(15, 4)
        for s in webp.LENGTH_ORDER:
            self.put(4 if s < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.put(int(format(n, "04b")[::-1], 2), 4)

    def single(self, symbol):
        self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(symbol, 8)

    def word(self, lengths, symbol):
        """The code word of a symbol."""
        if sum(map(bool, lengths)) == 1:
            return
        code = before = 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            code <<= n - before
            if s == symbol:
                self.put(int(format(code, f"0{n}b")[::-1], 2), n)
                return
            code, before = code + 1, n
        raise KeyError(symbol)

    def data(self):
        return self.value.to_bytes(self.size // 8 + 2, "little")


def header(width, height):
    s = Stream()
    s.put(0x2F, 8), s.put(width - 1, 14), s.put(height - 1, 14), s.put(0, 4)
    return s


def flat(size=256, bits=8):
    return [bits] * (1 << bits) + [0] * (size - (1 << bits))


def image(s, argb, main, cache_bits=0):
    """Literal pixels with eight-bit codes of all channels."""
    if cache_bits:
        s.put(1, 1), s.put(cache_bits, 4)
    else:
        s.put(0, 1)
    if main:
        s.put(0, 1)
    s.fixed(flat(280 + ((1 << cache_bits) if cache_bits else 0))), s.fixed(flat()), s.fixed(flat()), s.fixed(flat()), s.single(0)
    for p in np.ravel(argb).tolist():
        for shift in (8, 16, 0, 24):
            s.word(flat(), p >> shift & 255)


def pixels(width, height, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << 32, (height, width), dtype=np.uint64).astype(np.uint32)


def test_literals_with_alpha():
    want = pixels(7, 5)
    s = header(7, 5)
    s.put(0, 1)
    image(s, want, True)
    assert (both(s.data()) == want).all()


@pytest.mark.parametrize("far_code,far", [(1, 7), (2, 1), (120 + 3, 3)])
def test_back_references_and_cache(far_code, far):
    """Literals, a copy that overlaps itself, then a cached colour."""
    s, width = header(7, 3), 7
    s.put(0, 1)
    s.put(1, 1), s.put(3, 4), s.put(0, 1)  # cache of eight colours, one group
    green = [9] * 280 + [9] * 8 + []
    green = [8] * 224 + [9] * 64 + []  # 224 / 256 + 64 / 512 = 1
    distance = [5] * 24 + [4] * 4 + [0] * 12  # 24 / 32 + 4 / 16 = 1
    s.fixed(green), s.fixed(flat()), s.fixed(flat()), s.fixed(flat()), s.fixed(distance)
    first = [0xFF000000 | i << 16 | (i * 7 % 200) << 8 | i * 3 for i in range(8)]
    for p in first:
        s.word(green, p >> 8 & 255)
        for shift in (16, 0, 24):
            s.word(flat(), p >> shift & 255)

    def number(value, lengths, base):
        value -= 1
        if value < 4:
            s.word(lengths, base + value)
            return
        high = value.bit_length() - 1
        second = value >> (high - 1) & 1
        s.word(lengths, base + 2 * high + second), s.put(value & ((1 << (high - 1)) - 1), high - 1)

    number(12, green, 256)
    number(far_code, distance, 0)
    want = first[:]
    for _ in range(12):
        want.append(want[-far])
    key = ((webp.CACHE_HASH * want[-1]) & 0xFFFFFFFF) >> 29
    s.word(green, 280 + key)
    want.append(want[-1])
    assert both(s.data()).ravel().tolist() == want
    assert width * 3 == len(want)


def test_groups_by_block():
    s = header(8, 8)
    s.put(0, 1), s.put(0, 1)
    s.put(1, 1), s.put(0, 3)  # blocks of four pixels
    which = np.array([[0, 1], [1, 0]], np.uint32) << 8
    image(s, which, False)
    for g in (17, 99):
        s.single(g), s.single(1), s.single(2), s.single(255), s.single(0)
    out = both(s.data())
    assert (out[:4, :4] == 0xFF011102).all() and (out[:4, 4:] == 0xFF016302).all() and (out[4:, 4:] == 0xFF011102).all()


def test_subtract_green():
    want = pixels(5, 4, 3)
    c = webp._channels(want).copy()
    c[..., 0] -= c[..., 1]
    c[..., 2] -= c[..., 1]
    s = header(5, 4)
    s.put(1, 1), s.put(2, 2), s.put(0, 1)
    image(s, webp._words(c), True)
    assert (both(s.data()) == want).all()


def test_cross_colour():
    want, element = pixels(6, 6, 4), [(0, 250, 3, 90), (0, 5, 200, 17), (0, 0, 0, 0), (0, 128, 127, 255)]
    blocks = np.array([(255 << 24) | r << 16 | g << 8 | b for _, r, g, b in element], np.uint32).reshape(2, 2)
    sign = lambda v: v - 256 if v > 127 else v
    coded = np.zeros_like(want)
    for y in range(6):
        for x in range(6):
            p, e = int(want[y, x]), int(blocks[y >> 2, x >> 2])
            rb, gb, gr = sign(e >> 16 & 255), sign(e >> 8 & 255), sign(e & 255)
            a, r, g, b = p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255
            r2 = (r - (gr * sign(g) >> 5)) & 255
            b2 = (b - (gb * sign(g) >> 5) - (rb * sign(r) >> 5)) & 255
            coded[y, x] = a << 24 | r2 << 16 | g << 8 | b2
    s = header(6, 6)
    s.put(1, 1), s.put(1, 2), s.put(0, 3)
    image(s, blocks, False)
    s.put(0, 1)
    image(s, coded, True)
    assert (both(s.data()) == want).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    want = pixels(6, 5, 20 + mode)
    flat_want = webp._channels(want).astype(int).reshape(-1, 4).tolist()
    coded = []
    for i, p in enumerate(flat_want):
        y, x = divmod(i, 6)
        if y == 0:
            guess = flat_want[i - 1] if x else [0, 0, 0, 255]
        elif x == 0:
            guess = flat_want[i - 6]
        else:
            guess = webp._predicted(mode, flat_want[i - 1], flat_want[i - 6], flat_want[i - 7], flat_want[i - 5])
        coded.append([(a - b) & 255 for a, b in zip(p, guess)])
    s = header(6, 5)
    s.put(1, 1), s.put(0, 2), s.put(0, 3)
    image(s, np.full((2, 2), mode << 8, np.uint32), False)
    s.put(0, 1)
    image(s, webp._words(np.array(coded).reshape(5, 6, 4)), True)
    assert (both(s.data()) == want).all()


def test_predictor_values():
    left, top, corner, right = [10, 200, 0, 255], [20, 100, 5, 255], [15, 150, 250, 255], [30, 90, 9, 255]
    assert webp._predicted(5, left, top, corner, right)[0] == ((10 + 30) // 2 + 20) // 2
    assert webp._predicted(12, left, top, corner, right)[:3] == [15, 150, 0]
    assert webp._predicted(13, left, top, corner, right)[0] == 15
    assert webp._predicted(11, left, top, corner, right) in (left, top)


@pytest.mark.parametrize("size", [2, 3, 16, 40])
def test_palette(size):
    table = pixels(size, 1, 5)[0]
    index = np.random.default_rng(6).integers(0, size, (4, 11))
    packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
    width, bits = -(-11 >> packed), 8 >> packed
    coded = np.zeros((4, width), np.uint32)
    for y in range(4):
        for x in range(11):
            coded[y, x >> packed] |= np.uint32(index[y, x] << (8 + (x & ((1 << packed) - 1)) * bits))
    c = webp._channels(table[None]).astype(int)[0]
    deltas = webp._words(((c - np.vstack([np.zeros(4, int), c[:-1]])) & 255)[None])
    s = header(11, 4)
    s.put(1, 1), s.put(3, 2), s.put(size - 1, 8)
    image(s, deltas, False)
    s.put(0, 1)
    image(s, coded, True)
    assert (both(s.data()) == table[index]).all()


def cases():
    draw = np.random.default_rng(1)
    texts = [b"", b"a", b"word " * 40, b"Ther " * 900, b"### $$$ %%% &&& *** " * 300, bytes(range(256)) * 9, draw.bytes(5000), draw.bytes(40000), b"aaabbbccc" * 500, b"\xff" * 600]
    words = [bytes(draw.choice(list(b"etaoin shr"), int(k))) for k in draw.integers(1, 12, 300)]
    texts += [b" ".join(words[i] for i in draw.integers(0, 300, n)) for n in (3, 30, 300, 3000, 9000)]
    texts += [b"\n".join([b"All rights reserved. Terms apply."] * 50), "é 日本語 😀 ".encode() * 120]
    return [media.payload(t) for t in texts]


def joined(images):
    return b"".join(i.tobytes() for i in images)


def test_round_trip_in_step_and_alone():
    files = webpwrite.encode_payloads(cases())
    assert [joined(x) for x in webp.decode_all(files)] == cases()
    for m in files[:14]:
        for s in webp._split(m):
            assert (webp.decode_stream(s) == webp.decode_streams([s])[0]).all()


def test_bytes_do_not_depend_on_neighbours(monkeypatch):
    whole = webpwrite.encode_payloads(cases())
    assert whole == [webpwrite.encode_payloads([p])[0] for p in cases()]
    assert whole[::-1] == webpwrite.encode_payloads(cases()[::-1])
    monkeypatch.setattr(webpwrite, "PIXELS", 1 << 12)
    monkeypatch.setattr(webp, "_PIXELS", 1 << 10)
    assert whole == webpwrite.encode_payloads(cases()) and [joined(x) for x in webp.decode_all(whole)] == cases()


def test_longest_codes():
    """Counts that grow like Fibonacci numbers would need words of any length."""
    counts = [1, 1]
    while len(counts) < 40:
        counts.append(counts[-1] + counts[-2])
    lengths = webpwrite.code_lengths(counts)
    assert max(lengths) <= webpwrite.LONGEST_CODE and sum(2.0**-n for n in lengths) == 1
    assert webpwrite.code_lengths([5, 1]) == [1, 1]


def some_counts():
    draw = np.random.default_rng(3)
    counts = draw.integers(0, 4, (60, 344)) * draw.integers(0, 300, (60, 344)) * (draw.random((60, 344)) < draw.random((60, 1)))
    counts[0], counts[1], counts[2] = 0, 0, 0
    counts[1, 300], counts[2, [5, 9]], counts[3, :40] = 7, 4, [int(1.5**k) + 1 for k in range(40)]
    counts[:5, 280:] *= [[0], [1], [0], [0], [0]]
    return counts


def test_codes_of_many_rows_equal_those_of_one():
    counts = some_counts()
    rows = webpwrite.code_lengths_of(counts)
    assert (rows == [webpwrite._lengths(c) for c in counts]).all()
    assert (webpwrite.code_lengths_of(counts[:, :19], 7) == [webpwrite._lengths(c, 7) for c in counts[:, :19]]).all()
    sizes = np.where((rows[:, 280:] > 0).any(axis=1), 344, 280)
    row, value, width = webpwrite.put_codes(rows, sizes)
    streams = []
    for i, lengths in enumerate(rows):
        one, all_of_them = webpwrite.Writer(), webpwrite.Writer()
        webpwrite.put_code(one, lengths[: sizes[i]])
        for v, n in zip(value[row == i].tolist(), width[row == i].tolist()):
            all_of_them.put(v, n)
        assert (one.value, one.size) == (all_of_them.value, all_of_them.size)
        streams.append(one.value.to_bytes(one.size // 8 + 1, "little"))
    joined = webp._Joined(streams)
    pos = joined.begin.copy()
    read = webp._lengths_in_step(joined, pos, sizes)
    for i, data in enumerate(streams):
        bits = webp.Bits(data)
        assert bytes(read[i, : sizes[i]]) == webp._read_code(bits, int(sizes[i])).key and bits.at == pos[i] - joined.begin[i]


def test_lengths_that_repeat_are_read_in_step():
    """The encoder never repeats a length by symbol 16; others do."""
    w = webpwrite.Writer()
    own = np.zeros(19, np.int64)
    own[[3, 16, 17]] = 1, 2, 2
    words = webpwrite.code_words(own).tolist()
    w.put(0, 1), w.put(15, 4)
    for k in webp.LENGTH_ORDER:
        w.put(int(own[k]), 3)
    w.put(0, 1)
    for symbol, more, n in ((3, 0, 0), (16, 3, 2), (3, 0, 0), (17, 7, 3), (17, 7, 3), (17, 7, 3), (17, 1, 3)):
        w.put(words[symbol], int(own[symbol])), w.put(more, n)
    joined = webp._Joined([w.value.to_bytes(40, "little")] * 2)
    pos = joined.begin.copy()
    read = webp._lengths_in_step(joined, pos, np.array([42, 42]))
    assert read.tolist() == [[3] * 8 + [0] * 34] * 2 and (pos - joined.begin == w.size).all()
    assert webp._read_code(webp.Bits(w.value.to_bytes(40, "little")), 42).key == bytes(read[0])


def test_cut_streams_are_errors_in_step():
    (file,) = webpwrite.encode_payloads([media.payload(b"a stream that is cut somewhere, " * 30 + bytes(range(256)))])
    (stream,) = webp._split(file)
    for n in (len(stream) // 8, len(stream) // 2, len(stream) - 8):
        with pytest.raises(ValueError):
            webp.decode_streams([stream[:n], stream])
        with pytest.raises(ValueError):
            webp.decode_streams([stream[:n]])


def test_codes_are_made_for_many_images(monkeypatch):
    """No code of a plain image is built or read by itself."""
    payloads = [media.payload(f"text {i} of a few words, number {i * i}".encode() * 40) for i in range(30)]
    files = webpwrite.encode_payloads(payloads)
    assert all(not webp.uses(s) & {"palette", "predictor", "cross-colour"} for m in files for s in webp._split(m))
    calls = []
    for module, name in ((webpwrite, "code_lengths"), (webpwrite, "put_code"), (webp, "_read_code")):
        monkeypatch.setattr(module, name, lambda *a, _own=getattr(module, name), _name=name: calls.append(_name) or _own(*a))
    assert webpwrite.encode_payloads(payloads) == files and [joined(x) for x in webp.decode_all(files)] == payloads
    assert not calls


def test_stored_documents_use_the_format(spark, sf_dir):
    """Streams of the documents use each feature that makes some of them smaller, and are under half of them.
    Relative to green none is, so no text has the cross-colour transform (see the next test)."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text").repartition(8)
    rows = media.store(docs).select("media").collect()
    counts = collections.Counter(name for r in rows for s in webp._split(bytes(r["media"])) for name in webp.uses(s))
    assert all(counts[f] for f in ("prefix codes", "back-references", "colour cache", "palette", "predictor")), counts
    size = sum(len(media.payload((r["text"] or "").encode())) for r in docs.collect())
    assert sum(len(r["media"]) for r in rows) < 0.5 * size


def test_grey_pixels_are_relative_to_green():
    draw = np.random.default_rng(8)
    grey = np.repeat(draw.integers(0, 256, 192 * 6, dtype=np.uint8), 3).tobytes()
    (file,) = webpwrite.encode_payloads([grey])
    assert "cross-colour" in webp.uses(webp._split(file)[0]) and joined(webp.decode(file)) == grey and len(file) < 0.5 * len(grey)


def test_bad_streams():
    with pytest.raises(ValueError):
        webp.decode(b"RIFF....")
    with pytest.raises(ValueError):
        webp.decode_stream(b"\x00" * 20)
