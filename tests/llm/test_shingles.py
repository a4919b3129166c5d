"""Near copies by five-word shingles against brute force."""

import random

import corpus_pipeline
import numpy as np
from linkweave.llm import components, shingles
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, least id of its group); rows of ASCII text."""
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (d, _), c in zip(rows, label):
        least[c] = min(least.get(c, d), d)
    return sorted((d, least[c]) for (d, _), c in zip(rows, label))


def texts():
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rnd.choices(vocabulary, k=40)
    out = []
    for n in (3, 5, 6, 12, 30, 45, 100, 100, 300):
        base = rnd.choices(vocabulary, k=n)
        for edits in (0, 0, 1, 1, 1, 2, 3, 5, 9):
            words = list(base)
            for _ in range(edits):
                words[rnd.randrange(n)] = rnd.choice(vocabulary)
            out.append(" ".join(words[: n - rnd.randrange(min(n, 4))]))
    out += [" ".join(passage + rnd.choices(vocabulary, k=rnd.randrange(15))) for _ in range(30)]  # borders of 0.8
    return out + [None, "", " \n", "one", "One", "a b " * 500]


def test_matches_brute_force(spark):
    rows = [(500 - i, t) for i, t in enumerate(texts())]
    want = brute(rows)
    assert 20 < len({c for _, c in want}) < len(rows) - 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r["head"].doc_id) for r in shingles.groups(docs).collect()) == want


def test_pipeline_drops_near_copies_beyond_two_bits(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(20):
        words = [f"w{rnd.randrange(5000)}" for _ in range(300)]
        rows.append((2 * i, " ".join(words)))
        for at in (40, 140, 240):
            words[at] = "changed"
        rows.append((2 * i + 1, " ".join(words)))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == sorted({c for _, c in brute(rows)}) == list(range(0, 40, 2))


def test_order_does_not_matter(spark, monkeypatch):
    """Shingles of a sample of no text, so that the order is by hash alone, give the same groups."""
    rows = [(500 - i, t) for i, t in enumerate(texts())]
    monkeypatch.setattr(shingles, "SAMPLED", 0)
    got = shingles.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r["head"].doc_id) for r in got.collect()) == brute(rows)


def test_more_centres_make_no_difference(spark, monkeypatch):
    """Other centres as long as they link anything, and none at all, give the same groups."""
    rows = [(500 - i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(shingles, "APART", 1)
    monkeypatch.setattr(shingles, "PROGRESS", 1e-9)
    monkeypatch.setattr(shingles, "CENTRES", 2)
    monkeypatch.setattr(shingles, "FEW", 1)
    assert sorted((r.doc_id, r["head"].doc_id) for r in shingles.groups(docs).collect()) == brute(rows)


def test_parity_never_exceeds_the_difference():
    rnd = np.random.default_rng(9)
    for n in (0, 1, 5, 60, 5000):
        x = np.unique(rnd.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[n // 9 :], rnd.integers(0, 1 << 63, n // 7, np.uint64)]))
        differ = int(np.bitwise_count(shingles.parity(x) ^ shingles.parity(y)).sum())
        assert differ <= len(np.setxor1d(x, y)) and (n != 60 or differ > 8)


def test_empty_and_repeated(spark):
    assert shingles.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = shingles.groups(spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r["head"].doc_id) for r in got) == [(0, 3), (3, 3), (3, 3)]


def test_wide_parity_never_exceeds_the_difference():
    rnd = random.Random(12)
    for n in (500, 513, 700, 1024, 1025, 3000):
        base = [rnd.getrandbits(64) for _ in range(n)]
        for edits in (0, 1, n // 9, n // 2, n):
            x = np.array(sorted(base), np.uint64)
            y = np.array(sorted(base[edits:] + [rnd.getrandbits(64) for _ in range(rnd.randrange(edits + 1))]), np.uint64)
            a, b = shingles.wide_parity(x), shingles.wide_parity(y)
            assert (a is None, b is None) == (len(x) <= 512, len(y) <= 512)
            if a and b:
                differ = shingles.apart(a, b)
                assert differ <= len(np.setxor1d(x, y)) and differ == shingles.apart(b, a)
                assert len(a) != len(b) or differ == int(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum())


def test_long_texts_that_share_much(spark):
    """Texts beyond 512 shingles around the border of 0.8, with sizes on both sides of powers of two."""
    rnd = random.Random(13)
    rows = []
    for n in (540, 1010, 1040, 2070):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        for share in (0.95, 0.9, 0.85, 0.82, 0.78, 0.7, 0.5):
            cut = int(n * share)
            rows.append((len(rows), " ".join(base[:cut] + [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([0, n - cut]))])))
        rows.append((len(rows), " ".join(base)))
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    got = sorted((r.doc_id, r["head"].doc_id) for r in shingles.groups(docs).collect())
    assert got == brute(rows)
    assert 8 < len({h for _, h in got}) < len(rows)


def test_simhash_links_come_first(spark):
    """Near copies within SimHash's bits are linked by it, dissimilar sets of one fingerprint are not."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words + ["end"])), (3, " ".join(words[::-1])), (4, " ".join(words[:150] + ["new"] * 30 + words[150:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    filed = shingles.signatures(docs).withColumn("first", F.struct("doc_id", "text_hash")).cache()
    of = {r.fp: (r.doc_id, r.sim) for r in filed.collect()}
    near = {tuple(sorted((d, e))) for d, x in of.values() for e, y in of.values() if d < e and (x ^ y).bit_count() <= 2}
    assert (1, 2) in near
    found, tried = shingles.simhash_links(filed, docs)
    got = {tuple(sorted((of[r.a][0], of[r.b][0]))) for r in found.collect()}
    assert (1, 2) in got and got <= near
    same = filed.withColumn("sim", F.lit(7).cast("long"))
    found, tried = shingles.simhash_links(same, docs)
    assert tried.count() == 3 and (3 not in {of[f][0] for r in found.collect() for f in (r.a, r.b)})
    want = shingles.groups(docs).collect()
    assert {r.doc_id: r["head"].doc_id for r in want}[2] == 1


def test_links_of_a_group_take_no_rounds(spark, monkeypatch):
    """The links of a group of near copies are joined in one task, where each round took plans and tasks."""
    rnd = random.Random(14)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(60):
        words = list(base)
        words[rnd.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rounds, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda *a: rounds.append(1) or star(*a))
    got = shingles.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r["head"].doc_id) for r in got.collect()) == brute(rows) == [(i, 0) for i in range(60)]
    assert not rounds


def test_components_in_one_task_and_by_rounds(spark):
    rnd = random.Random(15)
    for n, m in ((1, 0), (40, 20), (300, 250), (300, 900)):
        pairs = [(rnd.randrange(-n, n), rnd.randrange(-n, n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1000 + n // 10)]
        edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
        once = sorted(map(tuple, components.connected(edges, at_once=10**6).collect()))
        assert once == sorted(map(tuple, components.connected(edges).collect())) and (once or not m)
        assert once == sorted(map(tuple, components.connected(edges, at_once=1).collect()))


def test_links_by_rounds_make_no_difference(spark, monkeypatch):
    """More links than go to one task, and no first shingles, give the same groups."""
    rows = [(500 - i, t) for i, t in enumerate(texts())]
    monkeypatch.setattr(shingles, "AT_ONCE", 1)
    monkeypatch.setattr(shingles, "LEADS", 0)
    got = shingles.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r["head"].doc_id) for r in got.collect()) == brute(rows)
