"""Rule ensemble: held-out accuracy, the compiled expression against Python, edge rows."""

import math
import random
import re
import unicodedata
import zlib

import numpy as np
from linkweave.llm import rules
from linkweave.llm.queries import op9_quality

SF = "/root/testdata/sf0.1"


def by_hand(model, stat):
    total = model.bias + sum(w for rule, w in model.rules if all((stat[k] > c) == up for k, c, up in rule))
    return 1 / (1 + math.exp(-total))


def test_held_out_accuracy_and_compiled_rules(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op9_quality(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.97


def test_statistics_and_edges(spark):
    texts = ["One one one TWO 22 ###!", "", None, "a a b\na  a", "|x| , y.", "é" * 50000, "w " * 50000]
    docs = spark.createDataFrame([(i if i != 4 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    from pyspark.sql import functions as F

    got = docs.select(*[c.alias(k) for k, c in rules.statistics(F.col("text")).items()]).collect()
    assert tuple(got[0].asDict()) == rules.STATISTICS
    for t, r in zip(texts, got):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert r.chars == len(t)
        assert math.isclose(r.distinct, len(set(words)) / len(words) if words else 0)
        assert math.isclose(r.capitals, sum(c.isupper() for c in t) / len(t) if t else 0)
        gaps = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]?", t)
        twice = sum(a.strip() == b.strip() and len(a) > len(a.strip()) for a, b in zip(gaps, gaps[1:]) if t.find(a + b) >= 0)
        if "  " not in t:
            assert math.isclose(r.repeats, twice / len(words) if words else 0)
    model = rules.Model(0.5, (((("chars", 3.0, True), ("distinct", 0.9, False)), 1.25), ((("bars", 0.1, True),), -2.0)))
    scored = rules.score(docs, model).collect()
    assert [r.score for r in scored] == [by_hand(model, r.asDict()) for r in got]
    assert scored[4].doc_id is None and rules.score(docs.limit(0), model).collect() == []


def test_one_class_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in rules.score(docs, rules.train(docs, none)).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(1, 1), (2, 1), (None, 1), (2, None)], "doc_id long, quality int")
    model = rules.train(docs, ones)
    assert model.rules == () and rules.score(docs, model).first().score > 0.5


def test_sampling_keeps_the_ratio(spark):
    """1000 to 200 labels on texts that say nothing: scores near 5/6, whether or not classes are sampled."""
    import random

    rnd = random.Random(3)
    rows = [(i, " ".join("ab1,"[rnd.randrange(4)] * rnd.randrange(1, 9) for _ in range(20)), int(i >= 200)) for i in range(1200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int").cache()
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "quality")
    for most in (150, 3000):
        model = rules.train(docs, labels, rules.Settings(per_class=most, trees=5, penalty=0.02))
        assert abs(rules.score(docs, model).agg({"score": "avg"}).first()[0] - 5 / 6) < 0.08


def test_lasso_by_its_conditions():
    """At the minimum the loss's gradient, summed row by row, is the penalty against each weight's sign, at
    most the penalty where the weight is nought, and nothing for the bias."""
    rnd = random.Random(6)
    r = [[rnd.randrange(2) for _ in range(5)] for _ in range(80)]
    y = [int(rnd.random() < (0.85 if a[0] and not a[1] else 0.25)) for a in r]
    u = [2.0 if t else 0.5 for t in y]
    u = [v * len(u) / sum(u) for v in u]
    penalty = 0.05
    bias, w = rules._lasso(np.array(r, float), np.array(y, float), rules.Settings(steps=20000, penalty=penalty), np.array(u))
    slope = [0.0] * 6
    for row, t, v in zip(r, y, u):
        p = 1 / (1 + math.exp(-(bias + sum(a * b for a, b in zip(row, w)))))
        for k, a in enumerate([1, *row]):
            slope[k] += v * (p - t) * a / len(y)
    assert abs(slope[0]) < 1e-6
    assert any(w) and not all(w)
    for g, b in zip(slope[1:], w):
        assert abs(g + penalty * (1 if b > 0 else -1)) < 1e-6 if b else abs(g) <= penalty + 1e-6


def test_counts_by_hand_and_repeated_rows(spark):
    texts = ["Ab|c ab AB!? the the  the | a.b,;: #$%\\_ 12 ٣", "x x\nx\tx xy x", "|||", "...", "$0 $1 \\1", "ǅ ª º"]
    docs = spark.createDataFrame([(1, t) for t in texts * 2], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = {r.text: r for r in docs.select("text", *[c.alias(k) for k, c in rules.statistics(F.col("text")).items()]).collect()}
    for t, r in got.items():
        n, words = len(t), re.findall(r"[^\x20\x09-\x0D]+", t)
        want = {
            "letters": sum(unicodedata.category(c)[0] == "L" for c in t), "capitals": sum(unicodedata.category(c) == "Lu" for c in t),
            "digits": sum(unicodedata.category(c) == "Nd" for c in t), "symbols": sum(c in "#$%&*@^~<>{}=+\\_" for c in t),
            "bars": t.count("|"), "shouts": sum(c in "!?" for c in t), "stops": sum(c in ".,;:" for c in t), "lines": t.count("\n"),
        }
        for k, v in want.items():
            assert math.isclose(r[k], v / n), (t, k)
        tokens = re.split(r"([\x20\x09-\x0D]+)", t)
        twice = sum(tokens[i] == tokens[i + 2] != "" and len(tokens[i + 1]) == 1 for i in range(0, len(tokens) - 2, 2))
        assert math.isclose(r.repeats, twice / len(words)), t
    model = rules.Model(math.log(0.7 / 0.3), ())
    scored = rules.score(docs, model).collect()
    assert len(scored) == 12 and {r.predicted for r in scored} == {int(1 / (1 + math.exp(-model.bias)) >= 0.7)}
