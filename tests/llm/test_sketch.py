"""Fingerprint sketches: recovered differences and successors against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
from linkweave.llm import sketch


def bags(text):
    return Counter(sketch.paragraphs(text.encode()))


def brute(a, b):
    x, y = bags(a), bags(b)
    both, either = (x & y).total(), (x | y).total()
    return both / either if either else 1.0


def test_paragraphs_join_to_the_text():
    rnd = random.Random(5)
    for _ in range(50):
        t = "".join(rnd.choice("ab é\n .") for _ in range(rnd.randrange(0, 400)))
        assert b"".join(sketch.paragraphs(t.encode())) == t.encode()
    assert sketch.paragraphs(b"") == [] and len(sketch.paragraphs(b"\n\n")) == 2


def test_peeling_recovers_the_differing_digests():
    rnd = random.Random(6)
    lines = ["line %d" % i for i in range(400)]
    for size in (3, 40, 400):
        a, b = rnd.sample(lines, size), rnd.sample(lines, size)
        x, y = (sketch.digests([("\n".join(t) + "\n").encode()]) for t in (a, b))
        m = 24
        while True:
            n, whole, found = sketch._peel(*(p - q for p, q in zip(sketch.sketches(x, 1, m), sketch.sketches(y, 1, m))), 1, m)
            if whole[0]:
                break
            m *= 2
        got = {(int(k), int(s)) for _, keys, signs in found for k, s in zip(keys, signs)}
        want = {(int(k), 1) for k in set(x.value) - set(y.value)} | {(int(k), -1) for k in set(y.value) - set(x.value)}
        assert got == want and n[0] == len(want)


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = {}
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        want[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), round(brute(t, edited), 9), round(brute(t, after), 9))
    assert {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got} == want
    assert len(got) == len(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sketch.compared(docs).collect()
    check(rows, got)
    text, prints = dict(rows), {}
    for r in got:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    assert np.mean([r.near_edited > r.near_next or r.near_edited == 1 for r in got]) > 0.9


def test_edges(spark):
    rows = [(5, None), (3, ""), (9, "x" * 100000), (8, "a b\n" * 30000), (None, "tail é" * 9), (1 << 60, "top"), ((1 << 60) + 1, "topper\n"), (-4, "low")]
    docs = spark.createDataFrame([(d, t, 1, "q") for d, t in rows], "doc_id long, text string, n_chars int, fingerprint string")
    check(rows, sketch.compared(docs.repartition(4)).collect())
    assert [(r.near_next, r.near_edited) for r in sketch.compared(docs.where("doc_id = 3")).collect()] == [(1.0, 1.0)]
    assert sketch.compared(docs.limit(0)).collect() == []


def test_repeated_ids(spark):
    rows = [(7, "same text %d" % (i % 3)) for i in range(300)] + [(6, "other")]
    got = sketch.compared(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == 301 and sum(r.near_next == 1 for r in got) >= 297 - 12
