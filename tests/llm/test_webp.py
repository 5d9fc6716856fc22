"""The decoder against streams that use every part of the format, written bit by bit."""

import numpy as np
import pytest

from millrace.llm import webp


class Stream(webp.Writer):
    def header(self, width, height):
        self.put(0x2F, 8)
        self.put(width - 1, 14)
        self.put(height - 1, 14)
        self.put(1, 1)
        self.put(0, 3)

    def data(self):
        return self.value.to_bytes(-(-self.n // 8), "little")

    def codes(self, lists):
        for lengths in lists:
            webp.put_code(self, lengths)
        return [(lengths, webp.stream_codes(lengths)) for lengths in lists]

    def symbol(self, code, s):
        lengths, codes = code
        if sum(n > 0 for n in lengths) > 1:
            self.put(codes[s], lengths[s])


def flat(n, size):
    """A complete code over the first n symbols, n a power of two."""
    return [n.bit_length() - 1] * n + [0] * (size - n)


def literals(s, pixels, cache=0):
    """An image of literals, with 8 bits for each channel."""
    codes = s.codes([flat(256, 280 + cache), flat(256, 256), flat(256, 256), flat(256, 256), [1] + [0] * 39])
    for p in pixels:
        for code, v in zip(codes, (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24)):
            s.symbol(code, v)


def image(width, height, transforms, pixels):
    s = Stream()
    s.header(width, height)
    for kind, write in transforms:
        s.put(1, 1)
        s.put(kind, 2)
        write(s)
    s.put(0, 1)
    s.put(0, 2)  # no colour cache, one group
    literals(s, pixels)
    return webp.decode_vp8l(s.data())


def sub_image(s, pixels):
    s.put(0, 1)
    literals(s, pixels)


rng = np.random.default_rng(4)


def noise(n):
    return [int(x) for x in rng.integers(0, 1 << 32, n)]


def test_plain_literals():
    p = noise(15)
    assert image(5, 3, [], p)[2].tolist() == p


def test_subtract_green():
    p = noise(12)
    got = image(4, 3, [(2, lambda s: None)], p)[2].tolist()
    for a, b in zip(p, got):
        g = a >> 8 & 255
        assert b == a & 0xFF00FF00 | ((a >> 16) + g & 255) << 16 | (a + g & 255)


def test_cross_colour():
    f, p = 0x00_20_E0_11, noise(12)
    signed = lambda v: (v & 255) - 256 * ((v & 255) > 127)
    got = image(4, 3, [(1, lambda s: (s.put(0, 3), sub_image(s, [f])))], p)[2].tolist()
    for a, b in zip(p, got):
        g = signed(a >> 8)
        red = (a >> 16) + (signed(f) * g >> 5) & 255
        blue = a + (signed(f >> 8) * g >> 5) + (signed(f >> 16) * signed(red) >> 5) & 255
        assert b == a & 0xFF00FF00 | red << 16 | blue


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    w, h, p = 6, 5, noise(30)
    blocks = [mode << 8] * 4
    got = image(w, h, [(0, lambda s: (s.put(0, 3), sub_image(s, blocks)))], p)[2].tolist()
    ch = lambda v: [v >> k & 255 for k in (24, 16, 8, 0)]
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    for i in range(w * h):
        y, x = divmod(i, w)
        L, T, TL, TR = (ch(got[j]) if 0 <= j < len(got) else None for j in (i - 1, i - w, i - w - 1, i - w + 1))
        if y == 0:
            want = [255, 0, 0, 0] if x == 0 else L
        elif x == 0:
            want = T
        elif mode == 11:
            left = sum(abs(t - c) for t, c in zip(T, TL))
            top = sum(abs(a - c) for a, c in zip(L, TL))
            want = L if left < top else T
        elif mode == 12:
            want = [min(255, max(0, a + t - c)) for a, t, c in zip(L, T, TL)]
        elif mode == 13:
            m = avg(L, T)
            want = [min(255, max(0, a + int((a - c) / 2))) for a, c in zip(m, TL)]
        else:
            want = {0: [255, 0, 0, 0], 1: L, 2: T, 3: TR, 4: TL, 5: avg(avg(L, TR), T), 6: avg(L, TL), 7: avg(L, T), 8: avg(TL, T), 9: avg(T, TR), 10: avg(avg(L, TL), avg(T, TR))}[mode]
        assert ch(got[i]) == [a + b & 255 for a, b in zip(ch(p[i]), want)]


@pytest.mark.parametrize("size", [2, 4, 16, 200])
def test_palette(size):
    colours = noise(size)
    deltas = [colours[0], *(sum((((b >> k) - (a >> k)) & 255) << k for k in (0, 8, 16, 24)) for a, b in zip(colours, colours[1:]))]
    per = {2: 3, 4: 2, 16: 1, 200: 0}[size]
    w, h = 11, 3
    index = rng.integers(0, size, (h, w))
    packed = -(-w // (1 << per))
    p = [int(sum(index[y, x * (1 << per) + k] << k * (8 >> per) for k in range(1 << per) if x * (1 << per) + k < w)) << 8 for y in range(h) for x in range(packed)]
    width, height, got = image(w, h, [(3, lambda s: (s.put(size - 1, 8), sub_image(s, deltas)))], p)
    assert (width, height) == (w, h) and got.tolist() == [colours[k] for k in index.ravel()]


def test_back_references_and_colour_cache():
    a, b, c = noise(3)
    s = Stream()
    s.header(7, 3)
    s.put(0, 1)
    s.put(1, 1)
    s.put(4, 4)
    s.put(0, 1)
    green = [9] * 512 + [0] * 0
    green = [8] * 232 + [9] * 48 + [0] * 16  # 296 = 280 + 16 symbols, made complete below
    n = sum(2 ** (9 - x) for x in green if x)
    assert n == 512
    green[280:296] = [13] * 16
    green[279] = 0  # its 1/512 goes to 16 cache symbols of 13 bits
    codes = s.codes([green, flat(256, 256), flat(256, 256), flat(256, 256), flat(32, 40)])

    def literal(p):
        for code, v in zip(codes, (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24)):
            s.symbol(code, v)

    def reference(length, prefix_far, extra, bits):
        s.symbol(codes[0], 256 + length - 1)
        s.symbol(codes[4], prefix_far)
        s.put(extra, bits)

    def cached(p):
        s.symbol(codes[0], 280 + ((0x1E35A7BD * p & 0xFFFFFFFF) >> 28))

    a, b, c = (x & 0xFFFF00FF | (x >> 8 & 63) << 8 for x in (a, b, c))
    literal(a), literal(b), literal(c)
    cached(c)
    reference(3, 1, 0, 0)  # distance code 2 is one to the left
    reference(4, 13, 121 + 3 - 97, 5)  # code 124 is 4 pixels back
    literal(a)
    cached(a)
    reference(4, 0, 0, 0)  # distance code 1 is the row above
    reference(4, 13, 121 - 97, 5)  # code 121 is one pixel back
    reference(1, 6, 8 + 1 - 9, 2)  # code 9 is a row below 2 rows: (2, 1)
    out = [a, b, c, c, c, c, c]
    out += out[3:7]
    out += [a, a]
    for _ in range(4):
        out.append(out[-7])
    out += [out[-1]] * 4
    out = out[:21]
    s2 = out
    if len(out) < 21:
        pytest.fail("the stream is short")
    got = webp.decode_vp8l(s.data() + bytes(4))[2].tolist()
    assert got[:17] == s2[:17] and len(got) == 21


def test_groups_of_codes():
    s = Stream()
    s.header(8, 4)
    s.put(0, 1)
    s.put(0, 1)
    s.put(1, 1)
    s.put(0, 3)  # blocks of 4 pixels
    sub_image(s, [0 << 8, 1 << 8])
    left = s.codes([[1] + [0] * 279, [1] + [0] * 255, [1] + [0] * 255, [1] + [0] * 255, [1] + [0] * 39])
    right = s.codes([flat(4, 280), [0, 1] + [0] * 254, [1] + [0] * 255, [0] * 255 + [1], [1] + [0] * 39])
    del left
    want = []
    for _ in range(4):
        want += [0] * 4
        for v in (3, 0, 2, 1):
            s.symbol(right[0], v)
            want.append(255 << 24 | 1 << 16 | v << 8)
    assert webp.decode_vp8l(s.data())[2].tolist() == want


def test_limits_of_code_lengths():
    for count in ([1], [5, 5], [1, 2, 3], [2**k for k in range(30)], list(range(1, 256))):
        n = webp.code_lengths(np.array([0, *count]))
        used = n[n > 0]
        assert n.max() <= webp.LIMIT and (len(used) == 0 or len(count) == 1 or sum(2.0**-used) == 1)


def test_broken_streams():
    good = webp.encode_samples(np.arange(64, dtype=np.uint8))
    assert (webp.decode_samples(good) == np.arange(64)).all()
    with pytest.raises(ValueError):
        webp.decode_samples(good[:-20])
    with pytest.raises(ValueError):
        webp.images(b"RIFX" + good[4:])


def test_many_rows_make_several_images():
    x = np.tile(np.arange(256, dtype=np.uint8), 64 * 16384 // 256 + 1)
    media = webp.encode_samples(x)
    assert len(webp.images(media)) == 2 and (webp.decode_samples(media) == x).all()
