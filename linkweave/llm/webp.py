"""Lossless WebP media columns, in numpy.

`decode` reads VP8L: it decodes prefix codes, back-references and the colour cache, and inverts
the predictor, cross-colour, subtract-green and palette transforms into pixel arrays. Pixels of
many images are decoded side by side: step i takes every image's next pixel, with one gather per
channel for all of them, so the interpreter's cost is shared by the batch. Headers that repeat
are parsed once.

`encode_payloads` stores byte payloads as such images. Three bytes make an opaque pixel; pixels
that only fill up the last row are transparent. Copies of earlier pixels and the colour cache stand
for repeats, in prefix codes that serve text, from a rule; images of few colours have a palette,
and those that gain by it have prefix codes of their own. What is smallest is taken, by each
image's own bytes alone.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, texts

# Fixed values of the format: the order in which lengths of the code length code are sent.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)

# Fixed values of the format: (x, y) of the 120 short distances.
NEAR = tuple(
    tuple(map(int, p.split(",")))
    for p in """
    0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0
    1,4 -1,4 4,1 -4,1 3,3 -3,3 2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2
    4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3
    0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 7,3 -7,3 5,6 -5,6 6,5 -6,5
    8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7
    """.split()
)

_NEAR = np.array(NEAR, np.int64)
GREEN_LITERALS, LENGTH_CODES, DISTANCE_CODES = 256, 24, 40
LONGEST = 15
CACHE_HASH = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class BadImage(ValueError):
    """The bytes are not a lossless WebP image."""


class _Bits:
    """Bits of a stream, low ones first."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        if n == 0:
            return 0
        if self.at + n > 8 * len(self.data):
            raise BadImage("the stream ends early")
        first, self.at = self.at, self.at + n
        return int.from_bytes(self.data[first >> 3 : (self.at + 7) >> 3], "little") >> (first & 7) & ((1 << n) - 1)


# ---------------------------------------------------------------- prefix codes


def canonical(lengths: list[int]) -> list[int]:
    """The code of each symbol, with its first bit lowest; 0 where it has none."""
    count = [0] * (LONGEST + 2)
    for n in lengths:
        count[n] += n > 0
    start, code = [0] * (LONGEST + 2), 0
    for n in range(1, LONGEST + 1):
        code = (code + count[n - 1]) << 1 if n > 1 else 0
        start[n] = code
    out = []
    for n in lengths:
        out.append(int(format(start[n], f"0{n}b")[::-1], 2) if n else 0)
        if n:
            start[n] += 1
    return out


def code_table(lengths: list[int]) -> np.ndarray:
    """symbol << 4 | length by the next LONGEST bits; a sole symbol takes no bits."""
    table = np.zeros(1 << LONGEST, np.uint32)
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        table[:] = used[0] << 4
        return table
    if sum(1 << (LONGEST - lengths[s]) for s in used) != 1 << LONGEST:
        raise BadImage("a prefix code is not complete")
    for s, code in enumerate(canonical(lengths)):
        if lengths[s]:
            table[code :: 1 << lengths[s]] = s << 4 | lengths[s]
    return table


def _read_code(bits: _Bits, size: int) -> list[int]:
    """Code lengths of an alphabet."""
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        for s in [first] + ([bits.read(8)] if two else []):
            if s >= size:
                raise BadImage("a symbol beyond its alphabet")
            lengths[s] = 1
        return lengths
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    table = code_table(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    s, before = 0, 8
    data, total = bits.data, 8 * len(bits.data)
    while s < size and left:
        left -= 1
        window = int.from_bytes(data[bits.at >> 3 : (bits.at >> 3) + 4], "little") >> (bits.at & 7)
        got = int(table[window & 0x7FFF])
        bits.at += got & 15
        if bits.at > total:
            raise BadImage("the stream ends early")
        got >>= 4
        if got < 16:
            lengths[s] = got
            before = got or before
            s += 1
            continue
        value, run = (before, 3 + bits.read(2)) if got == 16 else (0, 3 + bits.read(3)) if got == 17 else (0, 11 + bits.read(7))
        if s + run > size:
            raise BadImage("code lengths beyond the alphabet")
        lengths[s : s + run] = [value] * run
        s += run
    return lengths


# ---------------------------------------------------------------- pixels, side by side


class _Stream:
    """What precedes an image's pixels: cache bits, tables, and which tables serve which block."""

    def __init__(self, width: int, height: int, cache_bits: int, tables: np.ndarray, at: int, blocks: np.ndarray | None = None, block_bits: int = 0):
        self.width, self.height, self.cache_bits, self.tables, self.at = width, height, cache_bits, tables, at
        self.blocks, self.block_bits = blocks, block_bits


def _literal(s: _Stream) -> bool:
    """Whether its code gives literals only: neither copies nor the cache."""
    return not s.cache_bits and s.blocks is None and not bool(((s.tables[:, 0] >> 4) >= GREEN_LITERALS).any())


def _div_up(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _read_stream(bits: _Bits, width: int, height: int, main: bool) -> _Stream:
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise BadImage("bad colour cache size")
    blocks, block_bits, groups = None, 0, 1
    if main and bits.read(1):
        block_bits = bits.read(3) + 2
        blocks = _sub_image(bits, _div_up(width, block_bits), _div_up(height, block_bits)) >> 8 & 0xFFFF
        groups = int(blocks.max()) + 1
    sizes = (GREEN_LITERALS + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    tables = np.stack([np.stack([code_table(_read_code(bits, n)) if n else None for n in sizes]) for _ in range(groups)])
    return _Stream(width, height, cache_bits, tables, bits.at, blocks, block_bits)


def _sub_image(bits: _Bits, width: int, height: int) -> np.ndarray:
    """Pixels of an image inside the header; the reader goes on behind it."""
    stream = _read_stream(bits, width, height, False)
    (pixels,), (bits.at,) = _pixels([bits.data], [stream])
    return pixels


class _Window:
    """The next bits of several streams that lie one after the other in one buffer."""

    def __init__(self, datas: list[bytes]):
        starts = np.cumsum([0] + [len(d) for d in datas])
        joined = b"".join(datas) + b"\0" * (16 + -starts[-1] % 4)
        self.words = np.frombuffer(joined, "<u4").astype(np.uint64)
        self.starts, self.ends = 8 * starts[:-1], 8 * starts[1:]

    def at(self, bit: np.ndarray) -> np.ndarray:
        """At least 33 bits from each position."""
        k = bit >> 5
        return (self.words[k] | self.words[k + 1] << np.uint64(32)) >> (bit & 31).astype(np.uint64)


def _pixels(datas: list[bytes], streams: list[_Stream]) -> tuple[list[np.ndarray], list[int]]:
    """ARGB pixels of each image, and the bit behind them. The longest go first, so that the images
    that still have pixels to come are always the first few rows of every array."""
    n = len(streams)
    total = np.array([s.width * s.height for s in streams], np.int64)
    order = np.argsort(-total, kind="stable")
    streams, total = [streams[i] for i in order], total[order]
    window = _Window([datas[i] for i in order])
    bit = window.starts + np.array([s.at for s in streams])
    # tables: one after the other, equal ones once
    place, bases, stacked = {}, np.zeros(n, np.int64), []
    for i, s in enumerate(streams):
        if id(s.tables) not in place:
            place[id(s.tables)] = sum(len(t) for t in stacked)
            stacked.append(s.tables)
        bases[i] = place[id(s.tables)]
    table = np.concatenate(stacked).reshape(-1)
    base = (bases * (5 << LONGEST)).astype(np.int64)
    width = np.array([s.width for s in streams], np.int64)
    meta = np.array([s.blocks is not None for s in streams])
    offset = np.concatenate([[0], np.cumsum(total)])
    out = np.zeros(int(offset[-1]), np.uint32)
    put = offset[:-1].copy()
    left, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    cache_bits = np.array([s.cache_bits for s in streams])
    cache = np.zeros((n, 1 << int(cache_bits.max())), np.uint32) if cache_bits.any() else None
    cache_shift = (32 - cache_bits).astype(np.uint32)
    mask = np.uint64((1 << LONGEST) - 1)
    copying = False

    def take(rows: slice | np.ndarray, w: np.ndarray, channel: int) -> tuple[np.ndarray, np.ndarray]:
        got = table[base_now[rows] + ((w & mask).astype(np.int64) + (channel << LONGEST))]
        return got >> np.uint32(4), (got & np.uint32(15)).astype(np.int64)

    def extra(rows: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        prefix = prefix.astype(np.int64)
        more = np.where(prefix < 4, 0, (prefix - 2) >> 1)
        value = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << more)
        value += (window.at(bit[rows]) & ((np.uint64(1) << more.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        bit[rows] += more
        return value + 1

    # an image whose code gives literals only never needs the checks for the rest
    plain = all(_literal(s) for s in {id(s.tables): s for s in streams}.values()) and not meta.any()
    ends = sorted(set(total.tolist()))
    done = 0
    for end in ends:
        live = int(np.searchsorted(-total, -end, "right"))  # images with at least `end` pixels
        rows = slice(0, live)
        for step in range(done, end):
            base_now = base
            if not plain and meta[rows].any():
                base_now = base.copy()
                for i in np.flatnonzero(meta[rows]):
                    s = streams[i]
                    y, x = divmod(step, s.width)
                    k = s.blocks[(y >> s.block_bits) * _div_up(s.width, s.block_bits) + (x >> s.block_bits)]
                    base_now[i] += int(k) * (5 << LONGEST)
            if not copying:
                b = bit[rows]
                w = window.at(b)
                green, used = take(rows, w, 0)
                if plain or int(green.max(initial=0)) < GREEN_LITERALS:
                    red, more = take(rows, w >> used.astype(np.uint64), 1)
                    b += used + more
                    w = window.at(b)
                    blue, used = take(rows, w, 2)
                    alpha, more = take(rows, w >> used.astype(np.uint64), 3)
                    b += used + more
                    argb = alpha << np.uint32(24) | red << np.uint32(16) | green << np.uint32(8) | blue
                    out[put[rows]] = argb
                    put[rows] += 1
                    if cache is not None:
                        _remember(cache, np.arange(live), argb, cache_bits, cache_shift)
                    continue
            fresh = np.flatnonzero(left[rows] == 0)
            green, used = take(fresh, window.at(bit[fresh]), 0)
            bit[fresh] += used
            lit = green < GREEN_LITERALS
            if lit.any():
                at = fresh[lit]
                w = window.at(bit[at])
                red, used = take(at, w, 1)
                blue, more = take(at, w >> used.astype(np.uint64), 2)
                bit[at] += used + more
                alpha, used = take(at, window.at(bit[at]), 3)
                bit[at] += used
                argb = alpha << np.uint32(24) | red << np.uint32(16) | green[lit] << np.uint32(8) | blue
                out[put[at]] = argb
            kept = green >= GREEN_LITERALS + LENGTH_CODES
            if kept.any():
                at = fresh[kept]
                out[put[at]] = cache[at, green[kept].astype(np.int64) - GREEN_LITERALS - LENGTH_CODES]
            run = ~lit & ~kept
            if run.any():
                at = fresh[run]
                left[at] = extra(at, green[run] - np.uint32(GREEN_LITERALS))
                code, used = take(at, window.at(bit[at]), 4)
                bit[at] += used
                far = extra(at, code)
                short = far <= len(NEAR)
                near = _NEAR[np.minimum(far, len(NEAR)) - 1]
                back[at] = np.where(short, np.maximum(1, near[:, 0] + near[:, 1] * width[at]), far - len(NEAR))
                if (back[at] > step).any() or (left[at] + step > total[at]).any():
                    raise BadImage("a back-reference leaves the image")
            at = np.flatnonzero(left[rows])
            out[put[at]] = out[put[at] - back[at]]
            left[at] -= 1
            copying = bool((left[rows] > 0).any())
            if cache is not None:
                _remember(cache, np.arange(live), out[put[rows]], cache_bits, cache_shift)
            put[rows] += 1
        done = end
    if (bit > window.ends).any():
        raise BadImage("the stream ends early")
    pixels, ended = [np.empty(0)] * n, [0] * n
    for k, i in enumerate(order.tolist()):
        pixels[i], ended[i] = out[offset[k] : offset[k + 1]], int(bit[k] - window.starts[k])
    return pixels, ended


def _remember(cache: np.ndarray, rows: np.ndarray, argb: np.ndarray, bits: np.ndarray, shift: np.ndarray) -> None:
    some = bits[rows] > 0
    rows, argb = rows[some], argb[some]
    cache[rows, (argb * np.uint32(CACHE_HASH)) >> shift[rows]] = argb


# ---------------------------------------------------------------- transforms


def _channels(argb: np.ndarray) -> np.ndarray:
    """uint8 columns alpha, red, green, blue."""
    return argb.astype(">u4").view(np.uint8).reshape(-1, 4)


def _joined(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).view(">u4").reshape(-1).astype(np.uint32)


def predict(mode: int, left: list[int], top: list[int], top_right: list[int], top_left: list[int]) -> list[int]:
    """The predicted channels of a pixel from its neighbours', by mode 0 to 13."""

    def mean(a: list[int], b: list[int]) -> list[int]:
        return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]

    def clip(x: int) -> int:
        return 0 if x < 0 else 255 if x > 255 else x

    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode <= 9:
        return mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        near_left = sum(abs(a - c) for a, c in zip(top, top_left, strict=True))
        near_top = sum(abs(a - c) for a, c in zip(left, top_left, strict=True))
        return left if near_left < near_top else top
    if mode == 12:
        return [clip(a + b - c) for a, b, c in zip(left, top, top_left, strict=True)]
    half = mean(left, top)
    return [clip(m + int((m - c) / 2)) for m, c in zip(half, top_left, strict=True)]


def _predictor_mode(x: int, y: int, width: int, modes: np.ndarray, bits: int) -> int:
    if y == 0:
        return 0 if x == 0 else 1
    if x == 0:
        return 2
    return int(modes[(y >> bits) * _div_up(width, bits) + (x >> bits)] >> 8 & 15)


def _undo_predictor(argb: np.ndarray, width: int, data: np.ndarray, bits: int) -> np.ndarray:
    pixels = _channels(argb).tolist()
    for i, residual in enumerate(pixels):
        y, x = divmod(i, width)
        none = [0, 0, 0, 0]
        # the pixel above and right of a row's last is the first of its own row
        near = (pixels[i - 1] if i else none, *((pixels[i - width], pixels[i - width + 1], pixels[i - width - 1] if i > width else none) if y else (none,) * 3))
        guess = predict(_predictor_mode(x, y, width, data, bits), *near)
        pixels[i] = [(a + b) & 255 for a, b in zip(residual, guess, strict=True)]
    return _joined(np.array(pixels, np.uint8).reshape(-1, 4))


def colour_delta(multiplier: np.ndarray, colour: np.ndarray) -> np.ndarray:
    """What one channel, as a signed byte, adds to another."""
    return (multiplier.astype(np.int8).astype(np.int32) * colour.astype(np.int8).astype(np.int32)) >> 5


def _spread(data: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    """Each pixel's block value."""
    y, x = np.divmod(np.arange(width * height), width)
    return data[(y >> bits) * _div_up(width, bits) + (x >> bits)]


def _undo_cross_colour(argb: np.ndarray, width: int, data: np.ndarray, bits: int) -> np.ndarray:
    c, m = _channels(argb).copy(), _channels(_spread(data, width, len(argb) // width, bits))
    red_to_blue, green_to_blue, green_to_red = m[:, 1], m[:, 2], m[:, 3]
    red = (c[:, 1] + colour_delta(green_to_red, c[:, 2])) & 255
    c[:, 3] = (c[:, 3] + colour_delta(green_to_blue, c[:, 2]) + colour_delta(red_to_blue, red.astype(np.uint8))) & 255
    c[:, 1] = red
    return _joined(c)


def _undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    c = _channels(argb).copy()
    c[:, 1] += c[:, 2]
    c[:, 3] += c[:, 2]
    return _joined(c)


def palette_bits(size: int) -> int:
    """Log2 of the pixels that one bundle holds."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _undo_palette(argb: np.ndarray, width: int, colours: np.ndarray) -> np.ndarray:
    bits = palette_bits(len(colours))
    green = (argb >> 8 & 255).reshape(-1, _div_up(width, bits))
    each = 8 >> bits
    parts = [green >> (each * k) & ((1 << each) - 1) for k in range(1 << bits)]
    index = np.stack(parts, axis=2).reshape(len(green), -1)[:, :width].reshape(-1)
    padded = np.zeros(256, np.uint32)
    padded[: len(colours)] = colours
    return padded[index]


# ---------------------------------------------------------------- whole images


class _Header:
    """What is between the size and the pixels, for one size."""

    def __init__(self, bits: _Bits, width: int, height: int):
        self.undo: list[Callable[[np.ndarray], np.ndarray]] = []
        seen = set()
        while bits.read(1):
            kind = bits.read(2)
            if kind in seen:
                raise BadImage("a transform comes twice")
            seen.add(kind)
            if kind in (PREDICTOR, CROSS_COLOUR):
                size = bits.read(3) + 2
                data = _sub_image(bits, _div_up(width, size), _div_up(height, size))
                f = _undo_predictor if kind == PREDICTOR else _undo_cross_colour
                self.undo.append(lambda a, f=f, w=width, d=data, s=size: f(a, w, d, s))
            elif kind == SUBTRACT_GREEN:
                self.undo.append(_undo_subtract_green)
            else:
                steps = _channels(_sub_image(bits, bits.read(8) + 1, 1))
                colours = _joined(np.cumsum(steps, axis=0, dtype=np.uint8))
                self.undo.append(lambda a, w=width, c=colours: _undo_palette(a, w, c))
                width = _div_up(width, palette_bits(len(colours)))
        self.stream = _read_stream(bits, width, height, True)
        self.fixed = not self.undo and self.stream.blocks is None


def _payload_of(image: bytes) -> bytes:
    """The VP8L data of a file: a plain one, or an extended one that has such a chunk."""
    if len(image) < 20 or image[:4] != b"RIFF" or image[8:12] != b"WEBP":
        raise BadImage("not a WebP file")
    at = 12
    while at + 8 <= len(image):
        size = int.from_bytes(image[at + 4 : at + 8], "little")
        if image[at : at + 4] == b"VP8L":
            return image[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise BadImage("no lossless image data")


def decode(images: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """Width, height and ARGB pixels (uint32, row by row) of each image."""
    datas, sizes, headers = [], [], []
    plain: list[tuple[int, int, _Header]] = []  # headers that don't depend on the size, by their bits
    for image in images:
        data = _payload_of(image)
        if len(data) < 5 or data[0] != 0x2F:
            raise BadImage("not lossless data")
        size = int.from_bytes(data[1:5], "little")
        width, height = (size & 0x3FFF) + 1, (size >> 14 & 0x3FFF) + 1
        if size >> 29:
            raise BadImage("unknown version")
        for k, (n, value, known) in enumerate(plain):
            if int.from_bytes(data[5 : 5 + (n + 7) // 8], "little") & ((1 << n) - 1) == value:
                header = known
                plain.insert(0, plain.pop(k))
                break
        else:
            bits = _Bits(data, 40)
            header = _Header(bits, width, height)
            if header.fixed:
                n = bits.at - 40
                del plain[63:]  # those that come again are in front
                plain.append((n, int.from_bytes(data[5 : 5 + (n + 7) // 8], "little") & ((1 << n) - 1), header))
        s = header.stream
        stream = _Stream(width, height, s.cache_bits, s.tables, s.at) if header.fixed else s
        datas.append(data)
        sizes.append((width, height))
        headers.append((header, stream))
    found, at = [np.empty(0)] * len(datas), 0
    literal = {id(h.stream): _literal(h.stream) for h, _ in headers}
    alone = [literal[id(h.stream)] for h, _ in headers]
    users = Counter(id(s.tables) for _, s in headers)
    # literals alone are read in a shorter way; of images with tables of their own, those of a size go together
    order = sorted(range(len(datas)), key=lambda i: (not alone[i], -users[id(headers[i][1].tables)], sizes[i][0] * sizes[i][1]))
    while at < len(order):
        tables, end = {}, at  # as many images at once as have few enough tables among them
        while end < len(order) and sum(tables.values()) < 64 and alone[order[end]] == alone[order[at]]:
            tables[id(headers[order[end]][1].tables)] = len(headers[order[end]][1].tables)
            end += 1
        for i, pixels in zip(order[at:end], _pixels([datas[i] for i in order[at:end]], [headers[i][1] for i in order[at:end]])[0], strict=True):
            found[i] = pixels
        at = end
    out = []
    for (width, height), (header, _), pixels in zip(sizes, headers, found, strict=True):
        for undo in reversed(header.undo):
            pixels = undo(pixels)
        out.append((width, height, pixels))
    return out


# ---------------------------------------------------------------- payloads


def huffman_lengths(weights: list[int]) -> list[int]:
    """Code lengths of a Huffman code; ties go by symbol. Symbols of weight 0 have none."""
    heap = [(w, s, (s,)) for s, w in enumerate(weights) if w]
    lengths = [0] * len(weights)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, _, x), (b, first, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            lengths[s] += 1
        heapq.heappush(heap, (a + b, first, x + y))
    return lengths


def _text_weights() -> list[int]:
    """A rule for bytes of text: white space, letters, digits and marks, parts of longer code
    points, then any other byte, each class with one weight."""

    def weight(b: int) -> int:
        if b == 32:
            return 600
        if chr(b) in "etaoinshrl":
            return 250
        if 97 <= b <= 122:
            return 64
        if 0x80 <= b < 0xC0 or b in (0xC3, 10):
            return 12
        if 33 <= b <= 126:
            return 8
        return 1

    return [weight(b) for b in range(256)]


class _Writer:
    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.size
        self.size += bits


def write_code(out: _Writer, lengths: list[int]) -> None:
    """Send a code's lengths: runs of a length or of zeros are sent as such."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        out.put(1, 1), out.put(0, 1), out.put(1, 1), out.put(used[0] if used else 0, 8)
        return
    tokens, s, before = [], 0, 8
    while s < len(lengths):
        n, run = lengths[s], 1
        while s + run < len(lengths) and lengths[s + run] == n:
            run += 1
        s += run
        while run:
            if n == 0 and run >= 11:
                took = min(run, 138)
                tokens.append((18, took - 11, 7))
            elif n == 0 and run >= 3:
                took = min(run, 10)
                tokens.append((17, took - 3, 3))
            elif n and n == before and run >= 3:
                took = min(run, 6)
                tokens.append((16, took - 3, 2))
            else:
                took = 1
                tokens.append((n, 0, 0))
                before = n or before
            run -= took
    weights = [0] * 19
    for t, _, _ in tokens:
        weights[t] += 1
    own = huffman_lengths(weights)
    while max(own) > 7:  # the lengths themselves are sent in three bits
        weights = [(w + 1) // 2 for w in weights]
        own = huffman_lengths(weights)
    if sum(map(bool, own)) == 1:
        own[next(t for t in range(19) if own[t] == 0)] = 1
        own[tokens[0][0]] = 1
    last = max(k for k in range(19) if own[LENGTH_ORDER[k]])
    out.put(0, 1), out.put(max(0, last - 3), 4)
    for k in range(max(4, last + 1)):
        out.put(own[LENGTH_ORDER[k]], 3)
    out.put(0, 1)
    codes = canonical(own)
    for t, value, bits in tokens:
        out.put(codes[t], own[t])
        out.put(value, bits)


def _payload_code(transparent: bool) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Lengths and codes of a byte, and the header (its bits and their number)."""
    lengths = huffman_lengths(_text_weights())
    out = _Writer()
    out.put(0, 3)  # no transform, no colour cache, one group of codes
    write_code(out, lengths + [0] * LENGTH_CODES)
    write_code(out, lengths)
    write_code(out, lengths)
    if transparent:
        out.put(1, 1), out.put(1, 1), out.put(1, 1), out.put(0, 8), out.put(255, 8)
    else:
        write_code(out, [0] * 255 + [1])
    write_code(out, [0] * DISTANCE_CODES)
    return np.array(lengths, np.int64), np.array(canonical(lengths), np.uint64), out.value, out.size


#: entries of the colour cache, as bits; least and most pixels of a copy; how far back one reaches
CACHE_BITS, SHORTEST_COPY, LONGEST_COPY, FARTHEST = 8, 3, 4096, (1 << 20) - 120
#: an image gets prefix codes of its own, or a palette, where that leaves one part in so many at most: on
#: reading, its tables are built for it alone
OWN_PART = 3
_OPAQUE = np.uint32(0xFF000000)


def _limited(weights: list[int]) -> list[int]:
    """Code lengths of a Huffman code whose codes the format can send."""
    lengths = huffman_lengths(weights)
    while max(lengths) > LONGEST:
        weights = [(w + 1) // 2 for w in weights]
        lengths = huffman_lengths(weights)
    return [int(w > 0) for w in weights] if sum(map(bool, weights)) == 1 else lengths


class _Codes:
    """Prefix codes of the five alphabets, from weights, and the header that sends them."""

    def __init__(self, weights: list[list[int]], cache_bits: int, out: _Writer):
        out.put(0, 1)  # no further transform
        out.put(cache_bits > 0, 1)
        if cache_bits:
            out.put(cache_bits, 4)
        out.put(0, 1)  # one group of codes
        self.sizes, self.codes = [], []
        for w in weights:
            lengths = _limited(w)
            write_code(out, lengths)
            sole = sum(map(bool, lengths)) <= 1  # takes no bits
            self.sizes.append(np.array([0] * len(w) if sole else lengths, np.int64))
            self.codes.append(np.array([0] * len(w) if sole else canonical(lengths), np.uint64))
        self.header, self.bits = out.value, out.size


def _shared_codes() -> _Codes:
    """For text with copies and the colour cache, from a rule as well."""
    text = [10 * w for w in _text_weights()]
    lengths = [240 if 2 <= k <= 7 else 20 for k in range(LENGTH_CODES)]
    cached = [sum(text) // 2 >> CACHE_BITS] * (1 << CACHE_BITS)
    return _Codes([text + lengths + cached, text, text, [0] * 255 + [1], [30 if 12 <= k <= 20 else 3 for k in range(DISTANCE_CODES)]], CACHE_BITS, _Writer())


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, number of further bits and their value, of numbers from 1 on."""
    u = value - 1
    top = np.maximum(np.frexp(u.astype(np.float64))[1].astype(np.int64) - 2, 0)  # bits under the first two
    more = np.where(u < 4, 0, top)
    return np.where(u < 4, u, 2 * more + (u >> more)), more, u & ((1 << more) - 1)


def _near_codes(width: int) -> np.ndarray:
    """The short code of each distance of a row length, 0 where there is none."""
    if width not in _NEAR_CODES:
        table = np.zeros(7 * width + 9, np.int64)
        for k in range(len(NEAR), 0, -1):
            x, y = NEAR[k - 1]
            if x + y * width >= 1:
                table[x + y * width] = k
        _NEAR_CODES[width] = table
    return _NEAR_CODES[width]


_NEAR_CODES: dict[int, np.ndarray] = {}


def _copies(p: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Starts, lengths and distances of the copies that a greedy reading of an image takes: of the last
    place with the same three pixels, for as long as that stays the last place."""
    n = len(p) - SHORTEST_COPY + 1
    if n < 2:
        return [], [], []
    wide = p.astype(np.uint64)
    key = wide[:n] * np.uint64(0x9E3779B97F4A7C15) + wide[1 : n + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + wide[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(key, kind="stable")
    later, before = order[1:], order[:-1]
    good = (key[later] == key[before]) & (later - before <= FARTHEST)
    for k in range(SHORTEST_COPY):
        good &= p[later + k] == p[before + k]
    far = np.zeros(n, np.int64)
    far[later[good]] = (later - before)[good]
    at = np.flatnonzero(far)
    if not len(at):
        return [], [], []
    d = far[at]
    last = np.append(np.flatnonzero((at[1:] != at[:-1] + 1) | (d[1:] != d[:-1])), len(at) - 1)  # of each run
    ends = at[last[np.searchsorted(last, np.arange(len(at)))]]
    length = np.minimum(ends - at + SHORTEST_COPY, LONGEST_COPY)
    follow = np.searchsorted(at, at + length).tolist()
    chosen, k = [], 0
    while k < len(follow):
        chosen.append(k)
        k = follow[k]
    return at[chosen].tolist(), length[chosen].tolist(), d[chosen].tolist()


def _cached(p: np.ndarray) -> np.ndarray:
    """Where a pixel is the last one of its place in the colour cache."""
    slot = ((p * np.uint32(CACHE_HASH)) >> np.uint32(32 - CACHE_BITS)).astype(np.uint8 if CACHE_BITS <= 8 else np.uint16)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(p), bool)
    hit[order[1:]] = p[order[1:]] == p[order[:-1]]  # equal pixels have equal places
    return hit


class _Tokens:
    """What stands for images' pixels: symbols of the alphabets (green, red, blue, alpha, distance), -1
    for none, and the further bits of copies. ends: behind each image's last token."""

    def __init__(self, images: list[np.ndarray], widths: list[int], cache: bool):
        starts = np.cumsum([0] + [len(p) for p in images])
        p = np.concatenate(images)
        length, code, hit = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.zeros(len(p), bool)
        inside = np.zeros(len(p) + 1, np.int32)
        for a, image, width in zip(starts[:-1].tolist(), images, widths, strict=True):
            at, n, far = _copies(image)
            if at:
                at, n, far, near = a + np.array(at), np.array(n), np.array(far), _near_codes(width)
                short = near[np.minimum(far, len(near) - 1)] * (far < len(near))
                length[at], code[at] = n, np.where(short > 0, short, far + len(NEAR))
                inside[at + 1] += 1
                inside[at + n] -= 1
            if cache:
                hit[a : a + len(image)] = _cached(image)
        keep = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
        self.ends = np.searchsorted(keep, starts[1:])
        p, length, code, hit = p[keep], length[keep], code[keep], hit[keep]
        copy = length > 0
        hit &= ~copy
        literal = ~copy & ~hit
        symbols = np.full((len(p), 5), -1, np.int64)
        for k, shift in enumerate((8, 16, 0, 24)):
            symbols[:, k] = np.where(literal, (p >> np.uint32(shift) & np.uint32(255)).astype(np.int64), -1)
        slot = (p * np.uint32(CACHE_HASH)) >> np.uint32(32 - CACHE_BITS)
        symbols[hit, 0] = GREEN_LITERALS + LENGTH_CODES + slot[hit].astype(np.int64)
        n, n_bits, n_value = _prefixes(length[copy])
        far, far_bits, far_value = _prefixes(code[copy])
        symbols[copy, 0], symbols[copy, 4] = GREEN_LITERALS + n, far
        # fields in the order of the stream: green, further bits or red, blue, distance or alpha, further bits
        self.copy, self.symbols = copy, symbols
        self.more = np.column_stack([n_bits, far_bits]), np.column_stack([n_value, far_value]).astype(np.uint64)

    def fields(self, codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and values of four fields a token."""
        size, value = np.zeros((len(self.symbols), 4), np.int64), np.zeros((len(self.symbols), 4), np.uint64)
        for k in range(4):
            s = self.symbols[:, k]
            there = s >= 0
            size[there, k], value[there, k] = codes.sizes[k][s[there]], codes.codes[k][s[there]]
        far = self.symbols[self.copy, 4]
        size[self.copy, 1], value[self.copy, 1] = self.more[0][:, 0], self.more[1][:, 0]
        size[self.copy, 2], value[self.copy, 2] = codes.sizes[4][far], codes.codes[4][far]
        size[self.copy, 3], value[self.copy, 3] = self.more[0][:, 1], self.more[1][:, 1]
        return size, value

    def weights(self, cache: bool) -> list[list[int]]:
        """How often each symbol stands."""
        sizes = (GREEN_LITERALS + LENGTH_CODES + (1 << CACHE_BITS if cache else 0), 256, 256, 256, DISTANCE_CODES)
        return [np.bincount(s[s >= 0], minlength=n).tolist() for s, n in zip(self.symbols.T, sizes, strict=True)]

    def own_bits(self) -> np.ndarray:
        """About the bits of each image with codes of its own: entropies, some bits for each symbol of a
        code, and the further bits."""
        n = len(self.ends)
        image = np.searchsorted(self.ends, np.arange(len(self.symbols)), "right")
        bits = np.bincount(image[self.copy], self.more[0].sum(axis=1), n) + 100.0
        for s in self.symbols.T:
            there = s >= 0
            wide = int(s.max(initial=0)) + 1
            count = np.bincount(image[there] * wide + s[there], minlength=n * wide).reshape(n, wide).astype(np.float64)
            total = count.sum(axis=1)
            bits += total * np.log2(np.maximum(total, 1)) - (count * np.log2(np.maximum(count, 1))).sum(axis=1) + 3 * (count > 0).sum(axis=1)
        return bits


ROW = 192
_WIDTH = ROW // 3
_MOST = 1 << 14
#: payloads are encoded together up to about this size; a sample takes some hundred bytes on the way
ENCODE_BYTES = 1 << 20
_CODES: dict[bool, tuple[np.ndarray, np.ndarray, int, int]] = {}
_SHARED: list[_Codes] = []


def pad(text: bytes) -> bytes:
    """The payload of a text: spaces fill it up to a positive multiple of ROW bytes."""
    return text + b" " * (ROW if not text else -len(text) % ROW)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Store each payload, of a positive multiple of ROW bytes, as an image of its own.

    An image is the smallest of these: literals in the text code; copies and the colour cache in a
    code for these; copies, with the cache or a palette, in codes of its own (see OWN_PART)."""
    out: list[bytes] = []
    mine: list[bytes] = []
    shapes, size = [], 0
    for i, p in enumerate(payloads):
        rows = len(p) // ROW
        if not rows or len(p) % ROW:
            raise ValueError(f"a payload has a positive multiple of {ROW} bytes")
        wide = -(-rows // _MOST)
        if wide * _WIDTH > _MOST:
            raise ValueError("a payload is larger than an image can be")
        mine.append(p)
        shapes.append((wide * _WIDTH, -(-rows // wide)))
        size += len(p)
        if size >= ENCODE_BYTES or i == len(payloads) - 1:
            out += _encode(mine, shapes)
            mine, shapes, size = [], [], 0
    return out


def _encode(payloads: list[bytes], shapes: list[tuple[int, int]]) -> list[bytes]:
    if not _SHARED:
        _SHARED.append(_shared_codes())
    shared = _SHARED[0]
    images = []
    for p, (w, h) in zip(payloads, shapes, strict=True):
        c = np.frombuffer(p, np.uint8).reshape(-1, 3).astype(np.uint32)
        argb = np.zeros(w * h, np.uint32)  # what fills up the last row is transparent
        argb[: len(c)] = _OPAQUE | c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2]
        images.append(argb)
    clear = [3 * len(a) > len(p) for a, p in zip(images, payloads, strict=True)]
    tokens = _Tokens(images, [w for w, _ in shapes], True)
    size, value = tokens.fields(shared)
    ends = tokens.ends
    body = np.diff(np.concatenate([[0], np.cumsum(size.sum(axis=1))])[np.concatenate([[0], ends])])
    text_sizes = _text_code(False)[0]
    text_bits = [int(text_sizes[np.frombuffer(p, np.uint8)].sum()) + len(a) * c + _text_code(c)[3] for p, a, c in zip(payloads, images, clear, strict=True)]
    shared_bits = [None if c else int(b) + shared.bits for b, c in zip(body, clear, strict=True)]
    guess = tokens.own_bits()
    streams: list[bytes] = [b""] * len(payloads)
    texts_at, shared_at = [], []
    for i, (t, s) in enumerate(zip(text_bits, shared_bits, strict=True)):
        most = min(t, s if s is not None else t)
        own = _own(images[i], shapes[i], most // OWN_PART, float(guess[i]))
        if own is not None:
            streams[i] = own
        else:
            (texts_at if s is None or t <= s else shared_at).append(i)
    for transparent in (False, True):
        at = [i for i in texts_at if clear[i] == transparent]
        if at:
            for i, raw in zip(at, _text_streams([payloads[i] for i in at], [len(images[i]) for i in at], transparent), strict=True):
                streams[i] = raw
    if shared_at:
        first = np.concatenate([[0], ends])
        rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in shared_at])
        for i, raw in zip(shared_at, _streams(size[rows], value[rows], [int(first[i + 1] - first[i]) for i in shared_at], shared.header, shared.bits), strict=True):
            streams[i] = raw
    out = []
    for (w, h), c, raw in zip(shapes, clear, streams, strict=True):
        data = b"\x2f" + struct.pack("<I", (w - 1) | (h - 1) << 14 | int(c) << 28) + raw
        chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
        out.append(b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk)
    return out


def _own(argb: np.ndarray, shape: tuple[int, int], most: int, guess: float) -> bytes | None:
    """An image in codes of its own, with a palette where it has few colours; None where that takes more
    than so many bits."""
    found = []
    colours = np.unique(argb)
    if len(colours) <= 16 or len(colours) <= 256 and 12 * len(colours) <= most:  # about a palette's bits
        found.append(_palette(argb, shape, colours))
    if guess <= most:
        tokens = _Tokens([argb], [shape[0]], True)
        found.append((tokens, _Codes(tokens.weights(True), CACHE_BITS, _Writer())))
    best = None
    for tokens, codes in found:
        size, value = tokens.fields(codes)
        bits = int(size.sum()) + codes.bits
        if bits <= most:
            best, most = _streams(size, value, [len(size)], codes.header, codes.bits)[0], bits - 1
    return best


def _palette(argb: np.ndarray, shape: tuple[int, int], colours: np.ndarray) -> tuple[_Tokens, _Codes]:
    """Indices of colours, several to a pixel where there are few, and codes behind the palette."""
    width, height = shape
    bits = palette_bits(len(colours))
    narrow, each = _div_up(width, bits), 8 >> bits
    index = np.zeros((height, narrow << bits), np.uint32)
    index[:, :width] = np.searchsorted(colours, argb).reshape(height, width)
    parts = index.reshape(height, narrow, 1 << bits) << (each * np.arange(1 << bits, dtype=np.uint32))
    packed = parts.sum(axis=2, dtype=np.uint32).reshape(-1) << np.uint32(8) | _OPAQUE
    out = _Writer()
    out.put(1, 1), out.put(PALETTE, 2), out.put(len(colours) - 1, 8)
    channels = _channels(colours)
    steps = _joined(np.concatenate([channels[:1], channels[1:] - channels[:-1]]))
    table = _Tokens([steps], [len(steps)], False)
    inner = _Writer()
    codes = _Codes(table.weights(False), 0, inner)
    # an image in a header has neither transforms nor groups: the cache's bit, then its codes
    out.put(inner.value >> 1 & 1 | inner.value >> 3 << 1, inner.size - 2)
    for size, value in zip(*(x.reshape(-1).tolist() for x in table.fields(codes)), strict=True):
        out.put(value, size)
    tokens = _Tokens([packed], [narrow], False)
    return tokens, _Codes(tokens.weights(False), 0, out)


def _text_code(transparent: bool) -> tuple[np.ndarray, np.ndarray, int, int]:
    if transparent not in _CODES:
        _CODES[transparent] = _payload_code(transparent)
    return _CODES[transparent]


def _text_streams(payloads: list[bytes], pixels: list[int], transparent: bool) -> list[bytes]:
    """What follows the size of images of literals in the text code."""
    lengths, codes, header, header_bits = _text_code(transparent)
    samples = np.frombuffer(b"".join(p.ljust(3 * n, b"\0") for p, n in zip(payloads, pixels, strict=True)), np.uint8).reshape(-1, 3)
    symbols = samples[:, [1, 0, 2]]  # sent as green, red, blue
    size, code = lengths[symbols], codes[symbols]
    if transparent:
        opaque = np.concatenate([np.arange(n) < len(p) // 3 for p, n in zip(payloads, pixels, strict=True)])
        size = np.column_stack([size, np.ones(len(size), np.int64)])
        code = np.column_stack([code, opaque.astype(np.uint64)])  # of 0 and 255 the latter's code is 1
    return _streams(size, code, pixels, header, header_bits)


def _streams(size: np.ndarray, code: np.ndarray, rows: list[int], header: int, header_bits: int) -> list[bytes]:
    """Each image's header and the fields of its rows, as bits. A field of no bits has the value 0."""
    per = size.shape[1]
    ends = np.cumsum(size.reshape(-1))
    first = np.cumsum([0] + [n * per for n in rows])
    body = np.diff(np.concatenate([[0], ends])[first])
    words = (header_bits + body + 31) // 32
    start = 32 * np.concatenate([[0], np.cumsum(words)[:-1]])
    shift = start + header_bits - np.concatenate([[0], np.cumsum(body)[:-1]])
    at = ends - size.reshape(-1) + np.repeat(shift, np.diff(first))
    stream = np.zeros(int(words.sum()) + 2, np.uint64)
    word = at >> 5
    value = code.reshape(-1) << (at & 31).astype(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    sums = np.add.reduceat(value, new)
    # a field of no bits may stand at the end of one image, before the next one's header
    np.add.at(stream, word[new], sums & np.uint64(0xFFFFFFFF))
    np.add.at(stream, word[new] + 1, sums >> np.uint64(32))
    head = np.frombuffer(header.to_bytes(-(-header_bits // 32) * 4, "little"), "<u4").astype(np.uint64)
    for k, part in enumerate(head):
        stream[start // 32 + k] += part
    raw = stream.astype("<u4").tobytes()
    return [raw[s : s + n] for s, n in zip((start // 8).tolist(), ((header_bits + body + 7) // 8).tolist(), strict=True)]


def decode_payloads(images: list[bytes]) -> list[bytes]:
    """The payloads back: red, green and blue of the opaque pixels."""
    out = []
    for _, _, argb in decode(images):
        rgba = argb.astype(">u4").view(np.uint8).reshape(-1, 4)
        if rgba[-1, 0] != 255:
            rgba = rgba[rgba[:, 0] == 255]
        out.append(rgba[:, 1:].tobytes())
    return out


def features(payloads: list[bytes]) -> list[str]:
    """Shares of the sixteen equal ranges of sample values, each as two hexadecimal digits."""
    out = []
    for p in payloads:
        n = np.bincount(np.frombuffer(p, np.uint8) >> 4, minlength=16)
        out.append(((n * 255 + len(p) // 2) // max(1, len(p))).astype(np.uint8).tobytes().hex())
    return out


def store(docs: DataFrame, *keep: str) -> DataFrame:
    """The keep columns of docs, then n_bytes and media: each text's payload as an image."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        plain = [t or b"" for t in texts(batch.column(0))]
        media = encode_payloads([pad(t) for t in plain])
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([len(t) for t in plain], pa.int64()), pa.array(media, pa.binary())], [*batch.schema.names[1:], "n_bytes", "media"])

    schema = docs.select(*keep).schema.add("n_bytes", "long").add("media", "binary")
    return docs.select(F.col("text").alias("__text"), *keep).mapInArrow(batched(run), schema)


def pixels(images: DataFrame, column: str = "media", *keep: str) -> DataFrame:
    """The keep columns, then width, height and argb (four bytes a pixel, alpha first) of each image
    in a column of lossless WebP files; nulls for a null. A broken file fails the job."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = batch.column(0).to_pylist()
        real = [i for i, f in enumerate(files) if f is not None]
        got = dict(zip(real, decode([files[i] for i in real]), strict=True))
        found = [got.get(i, (None, None, None)) for i in range(len(files))]
        argb = [None if a is None else a.astype(">u4").tobytes() for _, _, a in found]
        columns = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array(argb, pa.binary())]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], "width", "height", "argb"])

    schema = images.select(*keep).schema.add("width", "integer").add("height", "integer").add("argb", "binary")
    return images.select(F.col(column).alias("__media"), *keep).mapInArrow(batched(run), schema)


def digests(docs: DataFrame) -> DataFrame:
    """Store every text as an image, read the stored bytes back and describe what was read.

    Null texts count as empty; an empty text is one row of spaces. Repeated rows each come back,
    equal texts with equal values; no rows: no rows. Columns besides doc_id and text are not read.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        plain = [t or b"" for t in texts(batch.column(1))]
        media = encode_payloads([pad(t) for t in plain])
        back = decode_payloads(media)
        columns = [
            batch.column(0),
            pa.array([len(t) for t in plain], pa.int64()),
            pa.array([len(p) for p in back], pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in back]),
            pa.array([zlib.crc32(p[-16:]) for p in back], pa.int64()),
            pa.array([len(m) for m in media], pa.int64()),
            pa.array([hashlib.sha256(m).hexdigest() for m in media]),
            pa.array(features(back)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(batched(run, 24 << 20), schema)
