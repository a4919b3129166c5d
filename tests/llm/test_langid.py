"""Language identification: held-out accuracy and edge rows."""

import math
import zlib

import numpy as np
from linkweave.llm import langid
from linkweave.llm.queries import op6_language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op6_language(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.97
    assert sum(got[d.doc_id].accepted for d in docs) / len(docs) > 0.99
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    rows = [(i, "the cat and the hat %d" % i, "en", "s") for i in range(40)] + [(100 + i, "der hund und das haus %d" % i, "de", "s") for i in range(40)]
    odd = [(200, None, "en", "s"), (201, "", "de", None), (202, "123 --- !!", None, None), (203, "the", None, None), (203, "the", None, None), (None, "das haus", None, None), (204, "and the hat " * 50000, None, None), (205, "é", None, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    model = langid.train(docs.where("doc_id < 200"))
    got = langid.predict(docs.repartition(3), model)
    assert got.columns == ["doc_id", "lang_pred", "score", "accepted"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.lang_pred, round(r.score, 6), r.accepted))
    assert by[200] == by[201] == by[202] == [("und", 0.0, False)]
    assert len(by[203]) == 2 and len(set(by[203])) == 1
    assert by[None][0][0] == "de" and by[204][0][0] == "en" and by[205][0][0] in ("de", "en")
    again = langid.train(docs.where("doc_id < 200").repartition(5))
    assert (again.table == model.table).all() and again.threshold == model.threshold


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(none)
    assert langid.predict(none, model).collect() == []
    one = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.predict(one, model).collect()] == [(1, "und", 0.0, False)]


def test_subwords_by_brute_force():
    s = langid.Settings()
    texts = ["The cat's hat", "", "é à", "a"]
    ids, counts = langid.buckets(texts, s)
    at = 0
    for t, n in zip(texts, counts):
        alone, _ = langid.buckets([t], s)
        assert (ids[at : at + n] == alone).all()
        at += n
        clean = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in t.lower().encode())
        want = 0
        for word in clean.split():
            w = b" " + word + b" "
            want += sum(max(0, len(w) - k + 1) for k in s.grams)
        assert n == want
    assert at == len(ids)


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(i, "the cat sat", "en") for i in range(20)] + [(i, "der hund lag", "de") for i in range(20, 40)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    odd = ["½ ² Ⅷ", "ⅷ", "①②", "٣", "_", "\u0301", "ª", "x", "字"]
    got = {t: p for t, p in zip(odd, langid.classify(odd, model)[0])}
    assert {t for t, p in got.items() if p == "und"} == {t for t in odd if not any(c.isalpha() for c in t)} == set(odd[:6])


def test_descent_by_hand():
    """Two texts, two passes: embeddings and weights after steps written out number by number."""
    s = langid.Settings(buckets=8, dims=3, epochs=2, rate=0.5, seed=3)
    rows = [(np.array([1, 5]), np.array([0.25, 0.75], np.float32), "b"), (np.array([2]), np.array([1.0], np.float32), "a")]
    got = langid.fit(rows, s)
    rng = np.random.default_rng(3)
    rows = [rows[i] for i in rng.permutation(2)]
    e = rng.normal(0, 1 / 3, (8, 3)).astype(np.float32).tolist()
    w, bias, order, done = [[0.0] * 2 for _ in range(3)], [0.0] * 2, np.arange(2), 0
    for _ in range(2):
        rng.shuffle(order)
        for i in order:
            ids, share, lang = rows[i]
            rate = 0.5 * (1 - done / 4)
            done += 1
            x = [sum(p * e[k][d] for k, p in zip(ids, share)) for d in range(3)]
            z = [sum(x[d] * w[d][c] for d in range(3)) + bias[c] for c in range(2)]
            p = [math.exp(v) / sum(map(math.exp, z)) for v in z]
            p["ab".index(lang)] -= 1
            back = [sum(w[d][c] * p[c] for c in range(2)) for d in range(3)]
            for d in range(3):
                for c in range(2):
                    w[d][c] -= rate * x[d] * p[c]
                for k, q in zip(ids, share):
                    e[k][d] -= rate * q * back[d]
            for c in range(2):
                bias[c] -= 0.1 * rate * p[c]
    want = [[sum(e[k][d] * w[d][c] for d in range(3)) for c in range(2)] for k in range(8)]
    assert got.labels == ("a", "b") and np.allclose(got.table, want, atol=1e-5) and np.allclose(got.bias, bias, atol=1e-6)
