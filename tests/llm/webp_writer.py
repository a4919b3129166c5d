"""A plain writer of lossless WebP images that can use every feature of the format."""

import struct

import numpy as np
from linkweave.llm import webp as W


def channels(p):
    return [p >> 24 & 255, p >> 16 & 255, p >> 8 & 255, p & 255]


def joined(c):
    return (c[0] & 255) << 24 | (c[1] & 255) << 16 | (c[2] & 255) << 8 | (c[3] & 255)


def prefix(value):
    for p in range(W.DISTANCE_CODES):
        extra = 0 if p < 4 else (p - 2) >> 1
        first = p if p < 4 else (2 + (p & 1)) << extra
        if first < value <= first + (1 << extra):
            return p, extra, value - 1 - first
    raise AssertionError(value)


def tokens(argb, width, cache_bits, repeats):
    out, cache, i = [], {}, 0

    def slot(p):
        return (p * W.CACHE_HASH & 0xFFFFFFFF) >> (32 - cache_bits)

    while i < len(argb):
        best, far = 0, 0
        if repeats:
            for d in {1, 2, 7, width, width + 1, max(1, width - 3), 3 * width + 2, 200}:
                n = 0
                while d <= i and i + n < len(argb) and n < 4000 and argb[i + n] == argb[i + n - d]:
                    n += 1
                if n > best:
                    best, far = n, d
        if best >= 3:
            code = next((k + 1 for k, (x, y) in enumerate(W.NEAR) if max(1, x + y * width) == far), far + len(W.NEAR))
            out.append(("copy", best, code, i))
        elif cache_bits and cache.get(slot(argb[i])) == argb[i]:
            out.append(("cache", slot(argb[i]), 0, i))
        else:
            out.append(("literal", argb[i], 0, i))
        step = best if best >= 3 else 1
        for p in argb[i : i + step]:
            cache[slot(p) if cache_bits else 0] = p
        i += step
    return out


def write_pixels(out, argb, width, height, cache_bits=0, repeats=False, main=True, blocks=None, block_bits=0):
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(int(blocks is not None), 1)
        if blocks is not None:
            out.put(block_bits - 2, 3)
            write_pixels(out, [b << 8 for b in blocks], W._div_up(width, block_bits), W._div_up(height, block_bits), main=False)
    groups = max(blocks) + 1 if blocks is not None else 1
    sizes = [W.GREEN_LITERALS + W.LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, W.DISTANCE_CODES]
    weights = [[[0] * n for n in sizes] for _ in range(groups)]
    coded = []
    for kind, a, b, i in tokens(argb, width, cache_bits, repeats):
        y, x = divmod(i, width)
        g = blocks[(y >> block_bits) * W._div_up(width, block_bits) + (x >> block_bits)] if blocks is not None else 0
        if kind == "literal":
            alpha, red, green, blue = channels(a)
            parts = [(0, green, 0, 0), (1, red, 0, 0), (2, blue, 0, 0), (3, alpha, 0, 0)]
        elif kind == "cache":
            parts = [(0, W.GREEN_LITERALS + W.LENGTH_CODES + a, 0, 0)]
        else:
            (p, n, v), (q, m, u) = prefix(a), prefix(b)
            parts = [(0, W.GREEN_LITERALS + p, v, n), (4, q, u, m)]
        for k, s, _, _ in parts:
            weights[g][k][s] += 1
        coded.append((g, parts))
    lengths = []
    for g in range(groups):
        row = []
        for w in weights[g]:
            n = W.huffman_lengths(w)
            while max(n) > W.LONGEST:
                w = [(x + 1) // 2 for x in w]
                n = W.huffman_lengths(w)
            if sum(1 for x in w if x) == 1:
                n = [int(x > 0) for x in w]
            W.write_code(out, n)
            row.append((n, W.canonical(n), sum(map(bool, n)) > 1))
        lengths.append(row)
    for g, parts in coded:
        for k, s, value, bits in parts:
            n, codes, real = lengths[g][k]
            if real:
                out.put(codes[s], n[s])
            out.put(value, bits)


def write(argb, width, height, transforms=(), **how):
    """transforms: ("predictor", modes, bits), ("cross", multipliers, bits), ("green",), ("palette",)."""
    out = W._Writer()
    now, w = list(argb), width
    for t in transforms:
        out.put(1, 1)
        if t[0] == "predictor":
            out.put(W.PREDICTOR, 2), out.put(t[2] - 2, 3)
            data = np.array([m << 8 | 0xFF000000 for m in t[1]], np.uint32)
            write_pixels(out, data.tolist(), W._div_up(w, t[2]), W._div_up(height, t[2]), main=False)
            new = []
            for i, p in enumerate(now):
                y, x = divmod(i, w)

                def near(dx, dy):
                    k = i + dx + dy * w
                    return channels(now[k]) if k >= 0 else [0] * 4

                guess = W.predict(W._predictor_mode(x, y, w, data, t[2]), near(-1, 0), near(0, -1), near(1, -1), near(-1, -1))
                new.append(joined([a - b for a, b in zip(channels(p), guess)]))
            now = new
        elif t[0] == "cross":
            out.put(W.CROSS_COLOUR, 2), out.put(t[2] - 2, 3)
            write_pixels(out, t[1], W._div_up(w, t[2]), W._div_up(height, t[2]), main=False)

            def delta(a, b):
                return ((a ^ 128) - 128) * ((b ^ 128) - 128) >> 5

            for i, p in enumerate(now):
                y, x = divmod(i, w)
                _, rb, gb, gr = channels(t[1][(y >> t[2]) * W._div_up(w, t[2]) + (x >> t[2])])
                a, r, g, b = channels(p)
                now[i] = joined([a, r - delta(gr, g), g, b - delta(gb, g) - delta(rb, r)])
        elif t[0] == "green":
            out.put(W.SUBTRACT_GREEN, 2)
            now = [joined([a, r - g, g, b - g]) for a, r, g, b in map(channels, now)]
        else:
            out.put(W.PALETTE, 2)
            colours = sorted(set(now))
            out.put(len(colours) - 1, 8)
            steps = [joined([x - y for x, y in zip(channels(a), channels(b))]) for a, b in zip(colours, [0] + colours)]
            write_pixels(out, steps, len(colours), 1, main=False)
            bits = W.palette_bits(len(colours))
            index = [colours.index(p) for p in now]
            narrow = W._div_up(w, bits)
            now = [0xFF000000 | sum(index[y * w + x] << 8 + (8 >> bits) * (x & (1 << bits) - 1) for x in range(k << bits, min(w, (k + 1) << bits))) for y in range(height) for k in range(narrow)]
            w = narrow
    out.put(0, 1)
    write_pixels(out, now, w, height, **how)
    body = b"\x2f" + struct.pack("<I", (width - 1) | (height - 1) << 14 | 1 << 28) + out.value.to_bytes((out.size + 7) // 8, "little")
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
