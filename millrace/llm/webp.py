"""Lossless WebP (VP8L): a decoder of the whole format and an encoder for byte payloads.

The decoder reads RIFF containers with a VP8L chunk: prefix codes (simple and
normal), groups of codes by an entropy image, back-references, the colour
cache, and the predictor, cross-colour, subtract-green and palette transforms.
An image whose red, blue and alpha codes have one symbol each, and that has
literals only, is decoded with arrays: the code length at every bit position is
looked up at once, and only the walk from code to code is a loop.

The encoder takes 8-bit samples, 64 to a row; more than 64 * 16384 go to
several images, one after the other.  It writes the shortest of: samples in the
green channel of an image 64 wide, with one length-limited prefix code; the
same after a predictor transform (left or above), where the differences have
less entropy; a palette with bundled pixels, for 16 values or fewer; and four
samples a pixel of an image 16 wide, with back-references and a colour cache,
where much of the image has occurred before.  The width tells which it is.

Fixed values follow the published format specification.
"""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np

WIDTH, MOST_ROWS, LIMIT = 64, 16384, 12
#: Bits of the encoder's colour cache, and the share of repeated pixels from which on back-references are tried.
CACHE_BITS, REPEATED = 8, 0.25
# The order in which the lengths of the code-length code are stored.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# The shortest run and the bits for its length of the symbols that repeat the last length, or 0.
_RUNS = {16: (3, 2), 17: (3, 3), 18: (11, 7)}
# The pixels (to the left, up) that distance codes 1 to 120 name.
_NEAR = (
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


class Bits:
    """Reads little-endian bit fields; beyond the end all bits are 0 and ``over`` says so."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def read(self, n: int) -> int:
        i = self.at >> 3
        v = int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return v


def _reversed_codes(lengths: list[int]) -> dict[tuple[int, int], int]:
    """(length, code as the stream has its bits, first bit lowest) -> symbol."""
    return {(lengths[s], c): s for s, c in enumerate(stream_codes(lengths)) if lengths[s]}


class Code:
    """A prefix code by its lengths; one symbol alone takes no bits."""

    def __init__(self, lengths: list[int]) -> None:
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        self.most = max(lengths, default=0)
        if not used:
            raise ValueError("a prefix code without symbols")
        if self.only is None:
            if sum(1 << (self.most - n) for n in lengths if n) != 1 << self.most:
                raise ValueError("a prefix code that is not complete")
            self.symbol, self.length = np.zeros(1 << self.most, np.uint16), np.zeros(1 << self.most, np.uint8)
            for (n, c), s in _reversed_codes(lengths).items():
                self.symbol[c :: 1 << n], self.length[c :: 1 << n] = s, n
            self._table: list[tuple[int, int]] | None = None  # made when symbols are first read one by one

    def next(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self._table is None:
            self._table = list(zip(self.symbol.tolist(), self.length.tolist()))
        i = bits.at >> 3
        s, n = self._table[int.from_bytes(bits.data[i : i + 3], "little") >> (bits.at & 7) & ((1 << self.most) - 1)]
        bits.at += n
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
        return s


@functools.lru_cache(64)
def _small_code(lengths: tuple[int, ...]) -> Code:
    return Code(list(lengths))


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        found = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in found:
            lengths[s] = 1
        return Code(lengths)
    few = [0] * 19
    for k in range(4 + bits.read(4)):
        few[_LENGTH_ORDER[k]] = bits.read(3)
    code = _small_code(tuple(few))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = code.next(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
            continue
        least, more = _RUNS[s]
        run = least + bits.read(more)
        if at + run > size:
            raise ValueError("code lengths run over")
        lengths[at : at + run] = [last if s == 16 else 0] * run
        at += run
    return Code(lengths)


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _entropy_coded(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB pixels of an image or, not ``main``, of a sub-image, which has one group of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, block, of = 1, 0, None
    if main and bits.read(1):
        block = 2 + bits.read(3)
        across = -(-width // (1 << block))
        of = (_entropy_coded(bits, across, -(-height // (1 << block)), False) >> np.uint32(8) & np.uint32(0xFFFF)).reshape(-1, across).tolist()
        groups = max(map(max, of)) + 1
    codes = [[_read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache_bits and all(c.only is not None for c in codes[0][1:4]):
        fast = _literals(bits, codes[0], total)
        if fast is not None:
            return fast
    out, cache, at = [0] * total, [0] * (1 << cache_bits), 0
    inserted = 0

    def remember(upto: int) -> None:
        nonlocal inserted
        if cache_bits:
            for p in out[inserted:upto]:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        inserted = upto

    while at < total:
        green, red, blue, alpha, far = codes[of[at // width >> block][at % width >> block] if of else 0]
        s = green.next(bits)
        if s < 256:
            r, b, a = red.next(bits), blue.next(bits), alpha.next(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n = _value(bits, s - 256)
            d = _value(bits, far.next(bits))
            if d > 120:
                d -= 120
            else:
                x, y = _NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference out of range")
            if d >= n:
                out[at : at + n] = out[at - d : at - d + n]
            else:  # the last d pixels again and again
                out[at : at + n] = (out[at - d : at] * (-(-n // d)))[:n]
            at += n
        else:
            remember(at)
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _literals(bits: Bits, codes: list[Code], total: int) -> np.ndarray | None:
    """The pixels if all are literals, else None; the walk over code lengths is the only loop."""
    green, rest = codes[0], codes[3].only << 24 | codes[1].only << 16 | codes[2].only
    if green.only is not None:
        return np.full(total, rest | green.only << 8, np.uint32) if green.only < 256 else None
    begin, mask = bits.at >> 3, (1 << green.most) - 1
    raw = np.frombuffer(bits.data, np.uint8)[begin:]
    out, done, at = np.empty(total, np.uint32), 0, bits.at & 7
    step = 1 << 16  # bytes whose bit positions are looked up at once
    lo = 0
    while done < total:
        part = raw[lo : lo + step + 2].astype(np.uint32)
        if len(part) <= 2:
            raise ValueError("the stream ends early")
        w = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
        if green.most + 7 > 24:
            more = np.zeros(len(w), np.uint32)
            more[: len(part) - 3] = part[3:]
            w |= more << np.uint32(24)
        windows = ((w[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(mask)).astype(np.uint16).ravel()
        length = green.length[windows].tobytes()
        here, i, n, stop = [], at - 8 * lo, total - done, len(length)
        put = here.append
        while n and i < stop:
            put(i)
            i += length[i]
            n -= 1
        found = green.symbol[windows[here]]
        if len(found) and found.max() > 255:
            return None
        out[done : done + len(here)] = found
        done += len(here)
        at = i + 8 * lo
        lo += len(w)
    bits.at = 8 * begin + at
    if bits.at > bits.end:
        raise ValueError("the stream ends early")
    return out << np.uint32(8) | np.uint32(rest)


# ------------------------------------------------------------------ transforms


def _add(a: int, b: int) -> int:
    """Sum of each channel, modulo 256."""
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _joined(c) -> int:
    a, r, g, b = c
    return a << 24 | r << 16 | g << 8 | b


def _select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for x, t, c in zip(_channels(left), _channels(top), _channels(corner)):
        to_left += abs(t - c)
        to_top += abs(x - c)
    return left if to_left < to_top else top


def _predicted(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """corner is above left, right is above right."""
    if mode == 0 or mode > 13:
        return 0xFF000000
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, right), top)
    if mode < 10:
        return _mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _mean(_mean(left, corner), _mean(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _joined(_clamp(x + t - c) for x, t, c in zip(_channels(left), _channels(top), _channels(corner)))
    m = _mean(left, top)
    return _joined(_clamp(x + int((x - c) / 2)) for x, c in zip(_channels(m), _channels(corner)))


def _undo_predictor(pixels: np.ndarray, width: int, block: int, modes: list[list[int]]) -> np.ndarray:
    used = {m for row in modes for m in row}
    if used in ({1}, {2}):  # sums along rows or columns
        c = pixels.astype("<u4").view(np.uint8).reshape(-1, width, 4).copy()
        c[0, 0, 3:] += np.uint8(255)  # opaque black before the first pixel
        if used == {1}:
            c[:, 0] = np.cumsum(c[:, 0], 0, np.uint8)
            c = np.cumsum(c, 1, np.uint8)
        else:
            c[0] = np.cumsum(c[0], 0, np.uint8)
            c = np.cumsum(c, 0, np.uint8)
        return np.ascontiguousarray(c).view("<u4").ravel().astype(np.uint32)
    p = pixels.tolist()
    for i in range(len(p)):
        y, x = divmod(i, width)
        if y == 0:
            guess = 0xFF000000 if x == 0 else p[i - 1]
        elif x == 0:
            guess = p[i - width]
        else:  # at the right border the pixel above right is the row's own first
            guess = _predicted(modes[y >> block][x >> block], p[i - 1], p[i - width], p[i - width - 1], p[i - width + 1])
        p[i] = _add(p[i], guess)
    return np.array(p, np.uint32)


def _undo_cross_colour(pixels: np.ndarray, width: int, block: int, factors: np.ndarray) -> np.ndarray:
    y, x = np.divmod(np.arange(len(pixels)), width)
    f = factors[y >> block, x >> block]
    signed = lambda v, shift: (v >> np.uint32(shift)).astype(np.uint8).view(np.int8).astype(np.int32)
    green, red, blue = signed(pixels, 8), (pixels >> np.uint32(16)).astype(np.int32) & 255, pixels.astype(np.int32) & 255
    red = (red + (signed(f, 0) * green >> 5)) & 255
    blue = (blue + (signed(f, 8) * green >> 5)) & 255
    blue = (blue + (signed(f, 16) * red.astype(np.uint8).view(np.int8).astype(np.int32) >> 5)) & 255
    return pixels & np.uint32(0xFF00FF00) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def _undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    g = pixels >> np.uint32(8) & np.uint32(255)
    return pixels & np.uint32(0xFF00FF00) | (pixels + (g << np.uint32(16)) & np.uint32(0xFF0000)) | (pixels & np.uint32(255)) + g & np.uint32(255)


def _undo_palette(pixels: np.ndarray, packed: int, width: int, per: int, palette: np.ndarray) -> np.ndarray:
    index = pixels >> np.uint32(8) & np.uint32(255)
    if per:
        many, size = 1 << per, 8 >> per
        index = (index.reshape(-1, packed)[:, :, None] >> (np.arange(many, dtype=np.uint32) * np.uint32(size)) & np.uint32((1 << size) - 1)).reshape(len(index) // packed, -1)[:, :width].ravel()
    table = np.zeros(256, np.uint32)  # an index beyond the palette is transparent black
    table[: len(palette)] = palette
    return table[index]


def decode_vp8l(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and ARGB pixels of a VP8L chunk."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    width, height = 1 + bits.read(14), 1 + bits.read(14)
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, across, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind < 2:
            block = 2 + bits.read(3)
            w, h = -(-across // (1 << block)), -(-height // (1 << block))
            sub = _entropy_coded(bits, w, h, False).reshape(h, w)
            if kind == 0:
                undo.append(functools.partial(_undo_predictor, width=across, block=block, modes=(sub >> np.uint32(8) & np.uint32(255)).tolist()))
            else:
                undo.append(functools.partial(_undo_cross_colour, width=across, block=block, factors=sub))
        elif kind == 2:
            undo.append(_undo_subtract_green)
        else:
            n = 1 + bits.read(8)
            palette = _entropy_coded(bits, n, 1, False)
            whole = np.cumsum(palette.view(np.uint8).reshape(-1, 4).astype(np.int64), 0).astype(np.uint8).view(np.uint32).ravel()
            per = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            packed = -(-across // (1 << per))
            undo.append(functools.partial(_undo_palette, packed=packed, width=across, per=per, palette=whole))
            across = packed
    pixels = _entropy_coded(bits, across, height, True)
    for u in reversed(undo):
        pixels = u(pixels)
    return width, height, pixels


def images(media: bytes) -> list[bytes]:
    """The VP8L chunks of RIFF containers, one after the other."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP container")
        end, k = at + 8 + struct.unpack_from("<I", media, at + 4)[0], at + 12
        while k + 8 <= end:
            size = struct.unpack_from("<I", media, k + 4)[0]
            if media[k : k + 4] == b"VP8L":
                out.append(media[k + 8 : k + 8 + size])
            k += 8 + size + (size & 1)
        at = end
    return out


# --------------------------------------------------------------------- encoder


def code_lengths(count: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of a prefix code for symbols that occur, none over the limit."""
    used = np.flatnonzero(count)
    out = np.zeros(len(count), np.int64)
    n = count[used].tolist()
    while True:
        heap = [(c, k) for k, c in enumerate(n)]
        heapq.heapify(heap)
        up = [0] * (2 * len(n))
        new = len(n)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            up[i] = up[j] = new
            heapq.heapreplace(heap, (a + b, new))
            new += 1
        depth = [0] * new
        for k in range(new - 2, -1, -1):
            depth[k] = depth[up[k]] + 1
        if max(depth[: len(n)]) <= limit:
            out[used] = depth[: len(n)]
            return out
        n = [c // 2 + 1 for c in n]


@functools.cache
def _flipped(n: int, bits: int) -> int:
    return int(format(n, f"0{bits}b")[::-1], 2)


def stream_codes(lengths: list[int]) -> list[int]:
    """Each symbol's code with its first bit lowest."""
    out, code = [0] * len(lengths), 0
    by: dict[int, list[int]] = {}
    for s, n in enumerate(lengths):
        if n:
            by.setdefault(n, []).append(s)
    last = 0
    for n in sorted(by):
        code <<= n - last
        last = n
        for s in by[n]:
            out[s] = _flipped(code, n)
            code += 1
    return out


#: A complete code for code lengths: 13 symbols of 4 bits, 6 of 5.
_META = [4] * 13 + [5] * 6
_META_CODES = stream_codes(_META)


class Writer:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def put_code(out: Writer, lengths: list[int]) -> None:
    """Write a prefix code by its lengths."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and used[-1] < 256:
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        wide = used[0] > 1
        out.put(int(wide), 1)
        out.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    out.put(0, 1)
    out.put(15, 4)
    for s in _LENGTH_ORDER:
        out.put(_META[s], 3)
    out.put(0, 1)
    at = 0
    for s in [*used, len(lengths)]:
        gap = s - at
        while gap:
            if gap < 3:
                run, sym, extra = 1, 0, 0
            elif gap < 11:
                run, sym, extra = gap, 17, 3
            else:
                run, sym, extra = min(gap, 138), 18, 7
            out.put(_META_CODES[sym], _META[sym])
            if extra:
                out.put(run - (3 if sym == 17 else 11), extra)
            gap -= run
        if s < len(lengths):
            out.put(_META_CODES[lengths[s]], _META[lengths[s]])
        at = s + 1


def _pack(codes: np.ndarray, sizes: np.ndarray, first: int, n_first: int) -> bytes:
    """n_first bits of ``first`` and then all codes, as bytes."""
    head = [first >> 32 * k & 0xFFFFFFFF for k in range(-(-n_first // 32))]
    sizes_head = [min(32, n_first - 32 * k) for k in range(len(head))]
    pad = -len(codes) % 4
    c = np.concatenate([codes, np.zeros(pad, np.uint64)]).reshape(-1, 4)
    n = np.concatenate([sizes, np.zeros(pad, np.uint64)]).reshape(-1, 4)
    v, m = c[:, 0], n[:, 0]
    for k in range(1, 4):
        v, m = v | c[:, k] << m, m + n[:, k]
    v, m = np.concatenate([np.array(head, np.uint64), v]), np.concatenate([np.array(sizes_head, np.uint64), m])
    at = np.cumsum(m) - m
    word, shift = at >> np.uint64(6), at & np.uint64(63)
    total = int(at[-1] + m[-1])
    out = np.zeros(total // 64 + 2, np.uint64)
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[starts]] = np.bitwise_or.reduceat(v << shift, starts)
    over = np.flatnonzero(shift + m > 64)  # at most one item crosses into each word
    out[word[over] + np.uint64(1)] |= v[over] >> (np.uint64(64) - shift[over])
    return out.astype("<u8").tobytes()[: -(-total // 8)]


def _lengths(count: np.ndarray) -> np.ndarray:
    """Code lengths for what occurs; one symbol, the first if none does, has length 1."""
    n = np.count_nonzero(count)
    if n > 2:
        return code_lengths(count)
    out = (count > 0).astype(np.int64)
    if not n:
        out[0] = 1
    return out


def _start(width: int, rows: int, alpha: bool = False) -> Writer:
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(rows - 1, 14)
    w.put(int(alpha), 1)
    w.put(0, 3)
    return w


def _put_single(w: Writer, *symbols: int) -> None:
    """Codes of one symbol each, which take no bits in the image."""
    for one in symbols:
        put_code(w, [0] * one + [1])


def _finish(w: Writer, codes: np.ndarray, sizes: np.ndarray) -> bytes:
    if not sizes.any():
        return w.value.to_bytes(-(-w.n // 8), "little")
    return _pack(codes.astype(np.uint64), sizes.astype(np.uint64), w.value, w.n)


def _green(w: Writer, values: np.ndarray, alpha: int) -> bytes:
    """The image's last part: literals whose red and blue are 0 and whose alpha is the same throughout."""
    w.put(0, 1 + 1 + 1)  # no more transforms, no colour cache, one group
    lengths = _lengths(np.bincount(values, minlength=256))
    put_code(w, [*lengths.tolist(), *[0] * 24])
    _put_single(w, 0, 0, alpha, 0)
    if np.count_nonzero(lengths) == 1:
        lengths = np.zeros(256, np.int64)
    return _finish(w, np.array(stream_codes(lengths.tolist()), np.uint64)[values], lengths[values])


def _plain(part: np.ndarray) -> bytes:
    return _green(_start(WIDTH, len(part) // WIDTH), part, 255)


def _differences(part: np.ndarray, mode: int) -> np.ndarray:
    """Samples less the one to the left (1) or above (2); the first row has only left ones, the first column only those above."""
    g = part.reshape(-1, WIDTH)
    out = g.copy()
    out[0, 1:] -= g[0, :-1]
    if mode == 1:
        out[1:, 0] -= g[:-1, 0]
        out[1:, 1:] -= g[1:, :-1]
    else:
        out[1:] -= g[:-1]
    return out.ravel()


def _predicted_image(part: np.ndarray, mode: int) -> bytes:
    w = _start(WIDTH, len(part) // WIDTH)
    w.put(1, 1)
    w.put(0, 2)  # the predictor transform, with blocks of 512
    w.put(7, 3)
    w.put(0, 1)  # its image has no colour cache
    _put_single(w, mode, 0, 0, 0, 0)
    return _green(w, _differences(part, mode), 0)


def _palette_image(part: np.ndarray, values: np.ndarray) -> bytes:
    n = len(values)
    w = _start(WIDTH, len(part) // WIDTH)
    w.put(1, 1)
    w.put(3, 2)
    w.put(n - 1, 8)
    w.put(0, 1)  # the palette's image: colours less the one before, all opaque
    steps = np.diff(values.astype(np.int64), prepend=0)
    lengths = _lengths(np.bincount(steps, minlength=256))
    put_code(w, [*lengths.tolist(), *[0] * 24])
    _put_single(w, 0, 0)
    put_code(w, [int(n > 1), *[0] * 254, 1])
    _put_single(w, 0)
    green = stream_codes(lengths.tolist())
    several = np.count_nonzero(lengths) > 1
    for k, s in enumerate(steps.tolist()):
        if several:
            w.put(green[s], int(lengths[s]))
        if n > 1:
            w.put(int(k == 0), 1)  # alpha 255 first, then 0
    bits = 1 if n <= 2 else 2 if n <= 4 else 4
    many = 8 // bits
    index = np.searchsorted(values, part).reshape(-1, many).astype(np.uint8)
    packed = np.bitwise_or.reduce(index << (np.arange(many, dtype=np.uint8) * np.uint8(bits)), axis=1)
    return _green(w, packed, 255)


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number of lengths or distances."""
    v = value.astype(np.int64) - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    small = v < 4
    symbol = np.where(small, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1))
    extra = np.where(small, 0, high - 1)
    return symbol, v & ((1 << extra) - 1), extra


def _earlier(pixels: np.ndarray, n: int) -> np.ndarray:
    """For each pixel the last earlier place at which the same n pixels seem to begin, or -1."""
    key = pixels[: len(pixels) - n + 1].astype(np.uint64)
    for k in range(1, n):
        key = key * np.uint64(0x9E3779B97F4A7C15) + pixels[k : len(pixels) - n + 1 + k]
    order = np.argsort(key, kind="stable")
    out = np.full(len(pixels), -1, np.int64)
    same = key[order[1:]] == key[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _referring_image(part: np.ndarray, before: np.ndarray, pixels: np.ndarray) -> bytes:
    """Back-references of 4 pixels or more, from the last place where they occurred, and a colour cache for the rest."""
    at, stop = 0, len(pixels)
    starts, lengths, sources = [], [], []
    able = np.flatnonzero(before >= 0)
    while (k := int(np.searchsorted(able, at))) < len(able):
        at = int(able[k])
        source, most = int(before[at]), min(4096, stop - at)
        differ = pixels[at : at + most] != pixels[source : source + most]
        n = int(differ.argmax()) if differ.any() else most
        if n >= 4:
            starts.append(at), lengths.append(n), sources.append(source)
        at += max(n, 1)
    starts, lengths, sources = (np.array(x, np.int64) for x in (starts, lengths, sources))
    copied = np.zeros(stop + 1, np.int64)
    np.add.at(copied, starts, 1)
    np.add.at(copied, starts + lengths, -1)
    alone = np.flatnonzero(np.cumsum(copied[:-1]) == 0)
    slot = (pixels * np.uint32(0x1E35A7BD)) >> np.uint32(32 - CACHE_BITS)
    order = np.argsort(slot, kind="stable")
    last = np.full(stop, -1, np.int64)
    same = slot[order[1:]] == slot[order[:-1]]
    last[order[1:][same]] = order[:-1][same]
    hit = (last >= 0) & (pixels[last] == pixels)
    hit_at, new_at = alone[hit[alone]], alone[~hit[alone]]
    channels = pixels[new_at].astype("<u4").view(np.uint8).reshape(-1, 4)  # blue, green, red, alpha
    length_symbol, length_extra, length_bits = _prefix(lengths)
    far_symbol, far_extra, far_bits = _prefix(starts - sources + 120)
    size = 280 + (1 << CACHE_BITS)
    green = np.bincount(np.concatenate([channels[:, 1].astype(np.int64), 280 + slot[hit_at].astype(np.int64), 256 + length_symbol]), minlength=size)
    codes = [_lengths(c) for c in (green, *(np.bincount(channels[:, k], minlength=256) for k in (2, 0, 3)), np.bincount(far_symbol, minlength=40))]
    w = _start(WIDTH // 4, stop * 4 // WIDTH, alpha=True)
    w.put(0, 1)
    w.put(1, 1)
    w.put(CACHE_BITS, 4)
    w.put(0, 1)
    for c in codes:
        put_code(w, c.tolist())
    sizes = [c if np.count_nonzero(c) > 1 else np.zeros_like(c) for c in codes]
    bits = [np.array(stream_codes(c.tolist()), np.uint64) for c in sizes]
    # four fields for each token, in the order of their pixels: a literal's channels, a cache entry, or a length and a distance
    rows = np.concatenate([new_at, hit_at, starts])
    value, width = np.zeros((len(rows), 4), np.uint64), np.zeros((len(rows), 4), np.uint64)
    a, b = len(new_at), len(new_at) + len(hit_at)
    for field, (code, channel) in enumerate(((0, 1), (1, 2), (2, 0), (3, 3))):
        value[:a, field], width[:a, field] = bits[code][channels[:, channel]], sizes[code][channels[:, channel]]
    s = 280 + slot[hit_at].astype(np.int64)
    value[a:b, 0], width[a:b, 0] = bits[0][s], sizes[0][s]
    value[b:, 0], width[b:, 0] = bits[0][256 + length_symbol], sizes[0][256 + length_symbol]
    value[b:, 1], width[b:, 1] = length_extra, length_bits
    value[b:, 2], width[b:, 2] = bits[4][far_symbol], sizes[4][far_symbol]
    value[b:, 3], width[b:, 3] = far_extra, far_bits
    order = np.argsort(rows, kind="stable")
    return _finish(w, value[order].ravel(), width[order].ravel())


def _entropy(part: np.ndarray) -> float:
    """Bits that a prefix code needs at least."""
    n = np.bincount(part, minlength=256)
    n = n[n > 0]
    return float((n * np.log2(len(part) / n)).sum())


def encode_samples(samples: np.ndarray) -> bytes:
    """RIFF containers with the samples, a multiple of 64."""
    out = []
    for lo in range(0, len(samples), WIDTH * MOST_ROWS):
        part = np.ascontiguousarray(samples[lo : lo + WIDTH * MOST_ROWS])
        bits = [_entropy(part), *(_entropy(_differences(part, mode)) for mode in (1, 2))]
        mode = int(np.argmin(bits))
        tried = [_plain(part) if not mode else _predicted_image(part, mode)]
        values = np.flatnonzero(np.bincount(part, minlength=256))
        if len(values) <= 16:
            tried.append(_palette_image(part, values.astype(np.uint8)))
        four = part.reshape(-1, 4).astype(np.uint32)
        pixels = four[:, 0] << np.uint32(24) | four[:, 1] << np.uint32(16) | four[:, 2] << np.uint32(8) | four[:, 3]
        before = _earlier(pixels, 4)
        if np.count_nonzero(before >= 0) > REPEATED * len(pixels):
            tried.append(_referring_image(part, before, pixels))
        raw = min(tried, key=len)
        pad = b"\0" * (len(raw) & 1)
        out.append(b"RIFF" + struct.pack("<I", 12 + len(raw) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(raw)) + raw + pad)
    return b"".join(out)


def decode_samples(media: bytes) -> np.ndarray:
    """All images' samples, one after the other: the green channel, or of narrow images all four."""
    out = []
    for x in images(media):
        width, _, pixels = decode_vp8l(x)
        out.append((pixels >> np.uint32(8)).astype(np.uint8) if width == WIDTH else pixels.astype(">u4").view(np.uint8))
    return np.concatenate(out)
