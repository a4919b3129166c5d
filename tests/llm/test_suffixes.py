"""Suffix-array dedup: the suffix sort and the whole operator against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from linkweave.llm import suffixes
from linkweave.llm.suffixes import Settings


def brute(rows, length=50):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1) if d is not None else ():
            k = raw[i : i + length]
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        end = 0
        for i in range(len(raw) - length + 1) if d is not None else ():
            if first[raw[i : i + length]] < d:
                for j in range(max(i, end), i + length):
                    gone[j] = True
                end = i + length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [9, 20, 50, 61, 200])
def test_suffix_order(length):
    rnd = random.Random(length)
    for letters in (b"a", b"ab", b"abcdefgh\0\xff"):
        text = bytes(rnd.choice(letters) for _ in range(700)) + b"ab" * 150
        text += text[100:400]
        starts = np.array(sorted(rnd.sample(range(len(text) - length), 500)))
        got = suffixes.suffix_order(text, starts, length)
        assert sorted(got.tolist()) == starts.tolist()
        prefixes = [text[i : i + length] for i in got.tolist()]
        assert prefixes == sorted(prefixes)


def test_repeated():
    rnd = random.Random(1)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 40))) for _ in range(60)]
    ids = np.array([rnd.randrange(30) for _ in texts])
    got = suffixes.repeated(b"".join(texts), np.array([len(t) for t in texts]), ids, 9)
    want = [any(o[j : j + 9] == t[i : i + 9] for o, e in zip(texts, ids) if e < d for j in range(len(o) - 8)) for t, d in zip(texts, ids) for i in range(len(t) - 8)]
    assert got.tolist() == want


def corpus(rnd, n):
    pool = ["".join(rnd.choice("abcdefg é\n") for _ in range(rnd.randrange(60, 600))) for _ in range(10)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            p = rnd.choice(pool)
            a = rnd.randrange(len(p))
            p = p[a : a + rnd.randrange(30, 300)]
            if rnd.random() < 0.4 and p:
                k = rnd.randrange(len(p))
                p = p[:k] + rnd.choice("XYZ") + p[k + 1 :]
            parts.append(p if rnd.random() < 0.7 else "".join(rnd.choice("hijklmnop ") for _ in range(rnd.randrange(0, 200))))
        rows.append((rnd.randrange(20 * n), "".join(parts)))
    return list({d: (d, t) for d, t in rows}.values())


@pytest.mark.parametrize("s", [Settings(block_bytes=3000, bucket_bytes=2000, sort_bytes=700), Settings(block_bytes=1, bucket_bytes=9000, names=1), Settings(length=30, gram=9, block_bytes=20000, names=3)])
def test_matches_brute_force(spark, s):
    rnd = random.Random(5)
    rows = corpus(rnd, 90) + [(9000 + i, "same sentence " * 20) for i in range(5)] + [(9100, None), (9101, ""), (9102, "x" * 49), (9103, "x" * 50), (9104, "x" * 51), (9105, "y" * 3000), (9106, "é" * 25), (9107, "y" * 60)]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, block int, ids string").repartition(3)
    assert sorted(map(tuple, suffixes.removals(docs, s).collect()), key=str) == brute(rows, s.length)


def test_repeated_null_and_no_rows(spark):
    text = "".join(map(str, range(100)))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = suffixes.removals(docs, keep_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_removed, bytes(r.kept).decode()) for r in got) == [(0, 0, text), (0, 0, text), (1, 0, text), (1, 0, text), (2, len(text), "")]
    assert suffixes.removals(docs.limit(0)).collect() == []


def test_alternating_letters(spark):
    """Texts whose polynomials agree modulo a power of two, whatever the base."""
    def word(a, b, n):
        return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))

    rows = [(1, word("a", "b", 4096)), (2, word("b", "a", 4096)), (3, word("a", "c", 3000)), (4, "z" + word("b", "a", 80)), (5, word("ab", "ba", 600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for s in (Settings(), Settings(names=1)):
        assert sorted(map(tuple, suffixes.removals(docs, s).collect())) == sorted(brute(rows, s.length))


def test_buckets_are_even():
    rnd = np.random.default_rng(3)
    text = bytes(rnd.integers(97, 123, 400_000, np.uint8))
    block = suffixes.Block(pa.array([1]), np.array([len(text)]), text, Settings())
    counts = np.bincount(suffixes._bucket(np.unique(block.key), 64), minlength=64)
    assert counts.max() < 1.5 * counts.mean() and counts.min() > 0.5 * counts.mean()
