"""Substring dedup against brute force over all windows."""

import hashlib
import random
import re

import pytest
from linkweave.llm import substring
from linkweave.llm.substring import Settings


def brute(rows, window=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("period", [1, 2, 7, 13, 21, 31])
def test_difference_covers(period):
    cover = substring.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(cover) <= 1.5 * period**0.5 + 1


def corpus(rnd, n):
    pool = [" ".join("%x" % rnd.randrange(1 << 14) for _ in range(rnd.randrange(20, 200))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            if rnd.random() < 0.6:
                w = rnd.choice(pool).split()
                a = rnd.randrange(0, len(w))
                w = w[a : a + rnd.randrange(30, 150)]
                if rnd.random() < 0.3 and w:
                    w[rnd.randrange(len(w))] = "edit%d" % rnd.randrange(3)
                parts += w
            else:
                parts += ["%x" % rnd.randrange(1 << 20) for _ in range(rnd.randrange(0, 70))]
        rows.append((rnd.randrange(10 * n), rnd.choice([" ", "\n", " \t "]).join(parts)))
    return list({d: (d, t) for d, t in rows}.values())


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = corpus(rnd, 120) + [(5000 + i, "same " * 70) for i in range(6)] + [(6000, None), (6001, ""), (6002, "few words"), (6003, "ab " * 49), (6004, "ab " * 50), (6005, "ab " * 51), (6006, "long " * 20000)]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n_words int, key string").repartition(4)
    assert sorted(map(tuple, substring.digests(docs).collect()), key=str) == brute(rows)
    short = Settings(window=12, period=7)
    assert sorted(map(tuple, substring.digests(docs, short).collect()), key=str) == brute(rows, 12)


def test_repeated_null_and_no_rows(spark):
    text = " ".join(map(str, range(80)))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring.digests(docs).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 80)]
    assert substring.digests(docs.limit(0)).collect() == []


def test_dedup_keeps_rows_and_columns(spark):
    text = " ".join(map(str, range(80)))
    rows = [(1, text, "en", "s", len(text)), (2, "a\nb " + text + " c", "en", None, 7), (3, "x\ny", "de", "s", 3), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = substring.dedup(docs)
    assert got.schema == docs.schema
    assert sorted(map(tuple, got.collect())) == [rows[0], (2, "a b c", "en", None, 5), rows[2], rows[3]]


def thue_morse(a, b, n):
    return [a if bin(i).count("1") % 2 == 0 else b for i in range(n)]


def test_words_that_defeat_hashes_modulo_a_power_of_two(spark):
    """Alternating words and letters whose polynomials agree modulo 2**64 whatever the base."""
    x, y = "".join(thue_morse("a", "b", 2048)), "".join(thue_morse("b", "a", 2048))
    same = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{same} {x}"), (2, f"{same} {y}"), (3, f"{y} {same}"), (4, f"{x} {same} {y}")]
    rows += [(10 + i, " ".join(thue_morse(*p, 256))) for i, p in enumerate([("p", "q"), ("q", "p"), ("p", "r")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, substring.digests(docs).collect()))
    assert got == sorted(brute(rows)) and got[1][2] == 0


def test_normal_words():
    for text in ("", " ", "a", " a", "a\n\t b ", "\x0b\x0cx  y\r", "é\u00a0b c", "\x1c \x85"):
        joined, start, end = substring.normal(text.encode())
        words = text.encode().split()
        assert joined == b" ".join(words) and [joined[a:b] for a, b in zip(start, end)] == words


def test_columns_named_like_helpers(spark):
    text = " ".join(map(str, range(80)))
    rows = [(1, text, 1, 2, 3), (2, text + " x", 4, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, rest int, id int")
    assert sorted(map(tuple, substring.dedup(docs).collect())) == [rows[0], (2, "x", 4, 5, 6)]
