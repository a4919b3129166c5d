"""Lossless WebP: exact round trips over every feature, and payload digests."""

import base64
import hashlib
import random
import zlib

import pytest
from linkweave.llm import webp as W

from .webp_writer import write


def picture(rnd, width, height, colours=None):
    colours = colours or [rnd.randrange(1 << 32) for _ in range(40)]
    row, out = [rnd.choice(colours) for _ in range(width)], []
    for _ in range(height):
        for x in range(width):
            if rnd.random() < 0.15:
                row[x] = rnd.choice(colours)
        out += row
    return out


def test_a_published_image():
    one = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")  # one transparent pixel
    ((w, h, argb),) = W.decode([one])
    assert (w, h, argb.tolist()) == (1, 1, [0])


def test_every_feature_in_one_batch():
    rnd, made = random.Random(8), []
    for trial in range(40):
        w, h = rnd.choice([(1, 1), (1, 9), (13, 1), (17, 11), (40, 23)])
        few = rnd.choice([1, 2, 3, 4, 11, 16, 60])
        argb = picture(rnd, w, h, [rnd.randrange(1 << 32) for _ in range(few)])
        steps = []
        if trial % 5 == 4:
            steps.append(("palette",))
        else:
            bits = rnd.choice([2, 3])
            blocks = W._div_up(w, bits) * W._div_up(h, bits)
            options = [("predictor", [rnd.randrange(14) for _ in range(blocks)], bits), ("cross", [rnd.randrange(1 << 32) for _ in range(blocks)], bits), ("green",)]
            steps = rnd.sample(options, rnd.randrange(4))
        how = {"cache_bits": rnd.choice([0, 1, 4, 11]), "repeats": rnd.random() < 0.6}
        if rnd.random() < 0.4:
            now = W._div_up(w, W.palette_bits(len(set(argb)))) if steps == [("palette",)] else w
            n = W._div_up(now, 2) * W._div_up(h, 2)
            how |= {"blocks": [rnd.randrange(3) for _ in range(n)], "block_bits": 2}
        made.append((w, h, argb, write(argb, w, h, steps, **how)))
    got = W.decode([m[3] for m in made])
    for (w, h, argb, _), (gw, gh, pixels) in zip(made, got):
        assert (gw, gh) == (w, h) and pixels.tolist() == argb


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    argb = picture(random.Random(mode), 12, 9)
    ((_, _, pixels),) = W.decode([write(argb, 12, 9, [("predictor", [mode] * 9, 2)])])
    assert pixels.tolist() == argb


def test_broken_images():
    good = W.encode_payloads([W.pad(b"some text")])[0]
    for bad in (b"", b"RIFF", good[:30], good[:12] + b"VP8 " + good[16:], good[:20] + b"\0" + good[21:]):
        with pytest.raises(W.BadImage):
            W.decode([bad])


def test_payloads_of_any_size_and_byte():
    rnd = random.Random(9)
    payloads = [W.pad(bytes(rnd.randrange(256) for _ in range(n))) for n in (0, 1, 191, 192, 193, 5000)] + [bytes(192), b"\xff" * 192 * 3, W.pad(b"z" * 192 * 16385)]
    images = W.encode_payloads(payloads)
    assert W.decode_payloads(images) == payloads
    assert [W.encode_payloads([p])[0] for p in payloads] == images


def test_digests(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "é" * 500), (5, "short"), (5, "short"), (None, "x" * 100000), (6, " " * 192)]
    docs = spark.createDataFrame([(d, t, b"m", "f") for d, t in rows], "doc_id long, text string, media binary, feature string").repartition(3)
    got = W.digests(docs).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    by = {r.doc_id: r for r in got}
    assert by[3].feature == by[5].feature and by[3].media_sha256 == by[5].media_sha256
    assert by[1][1:] == by[2][1:]
    assert W.digests(docs.limit(0)).collect() == []
    stored = W.store(docs, "doc_id")
    shown = W.pixels(stored, "media", "doc_id")
    for r in shown.collect():
        assert len(r.argb) == 4 * r.width * r.height
        raw = (text[r.doc_id] or "").encode()
        assert bytes(b for i, b in enumerate(r.argb) if i % 4).startswith(raw)


def test_stored_images_use_the_format(spark):
    """Copies, the colour cache, codes of their own and palettes are in the images of real documents and of odd ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [r.text or "" for r in docs.orderBy("doc_id").limit(150).collect()]
    rnd = random.Random(4)
    few = [rnd.choice(["abc", "xyz", "tuv", " 1 "]) for _ in range(900)]
    odd = ["", "".join(rnd.choices(["\x01\x02\x03", "\x04\x05\x06"], k=9000)), "".join(chr(rnd.randrange(1, 9)) for _ in range(12000)), "abc abd " * 900, "".join(few), "".join(rnd.choice("한국어의") for _ in range(4000)), "z" * (192 * 16385 - 7)]
    payloads = [W.pad(t.encode()) for t in texts + odd]
    images = W.encode_payloads(payloads)
    assert W.decode_payloads(images) == payloads
    assert [W.encode_payloads([p])[0] for p in payloads] == images
    headers = [W._Header(W._Bits(W._payload_of(i), 40), W._WIDTH, len(p) // W.ROW) for i, p in zip(images[:-1], payloads)]
    cached = [h for h in headers if h.stream.cache_bits]
    assert sum(h.stream.cache_bits > 0 for h in headers[:150]) > 100
    assert len({h.stream.tables.tobytes() for h in cached}) > 1 and any(h.undo for h in headers)
    pixels = [p.astype("uint32") for _, _, p in W.decode(images[:150])]
    assert sum(bool(W._copies(p)[0]) for p in pixels) > 100
    assert sum(map(len, images)) < sum(len(p) for p in payloads) // 2


def test_tokens_against_a_plain_reading():
    """Numbers' prefixes and the short codes of distances, as the decoder reads them."""
    import numpy as np

    value = np.array([*range(1, 300), 4095, 4096, (1 << 20) - 1, 1 << 20])
    symbol, more, rest = W._prefixes(value)
    base = np.where(symbol < 4, symbol, (2 + (symbol & 1)) << more)
    assert (base + rest + 1 == value).all() and (more == np.where(symbol < 4, 0, (symbol - 2) >> 1)).all()
    near = W._near_codes(64)
    assert all(near[d] == 0 or max(1, W.NEAR[near[d] - 1][0] + 64 * W.NEAR[near[d] - 1][1]) == d for d in range(1, len(near)))
