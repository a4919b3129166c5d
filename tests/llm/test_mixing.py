"""Mixing: exponents against direct evaluation, quotas by source and block, edge rows."""

import math
import random
from collections import Counter, defaultdict

import pytest
from linkweave.llm import mixing
from linkweave.llm.mixing import Settings

SCHEMA = "doc_id long, text string, source string, epoch int"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 40))), "big" if i % 3 else rnd.choice(["a", "b", "c", None]), 9) for i in range(3000)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def by_source(rows):
    out = Counter()
    for r in rows:
        out[r.source] += len((r.text or "").split())
    return out


def direct(total, x):
    z = sum(t**x for t in total.values())
    return {k: t**x / z for k, t in total.items()}


@pytest.mark.parametrize("s", [Settings(repeats=1.5), Settings(repeats=2.25, range_rows=50, block_tokens=3000), Settings(entropy=0.9, repeats=None), Settings(entropy=0.95, repeats=None, budget=0.5), Settings(repeats=3.0, budget=1.0)])
def test_weights_and_quotas(spark, docs, s):
    rows = docs.collect()
    total = by_source(rows)
    x = mixing.exponent(mixing.totals(docs.withColumn("tokens", mixing.tokens(docs.text))), s)
    p = direct(total, x)
    entropy = -sum(q * math.log(q) for q in p.values()) / math.log(len(p))
    budget = sum(total.values()) * s.budget if s.budget else max(t / p[k] for k, t in total.items())
    epochs = {k: budget * p[k] / t for k, t in total.items()}
    if s.entropy:
        assert abs(entropy - s.entropy) < 1e-6
    else:
        assert x == 0 or abs(max(epochs.values()) - s.repeats) < 1e-5
    got = mixing.mix(docs, s).collect()
    shown = Counter(r.doc_id for r in got)
    for r in rows:
        e = epochs[r.source]
        assert math.floor(e + 1e-9) <= shown[r.doc_id] <= math.ceil(e - 1e-9)
    out = by_source(got)
    for k in total:
        assert abs(out[k] - epochs[k] * total[k]) <= 41
    blocks = defaultdict(Counter)
    for r in got:
        blocks[r.__getitem__("__block")][r.source] += r["__tokens"]
    n = max(1, math.ceil(budget / s.block_tokens))
    assert set(blocks) == set(range(n))
    for b in blocks.values():
        for k in total:
            assert abs(b[k] - epochs[k] * total[k] / n) <= 82
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7), s).collect())) or any(r.source is None for r in got)


def test_edges(spark):
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "x y", "a", 1), (3, "x y", "a", 1), (None, "z", None, 1), (4, "long " * 30000, "b", 1), (5, None, "empty", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, Settings(repeats=2.0))
    assert got.columns[:4] == docs.columns
    shown = Counter((r.doc_id, r.source) for r in got.collect())
    assert set(shown) == {(1, "a"), (2, "a"), (3, "a"), (None, None), (4, "b"), (5, "empty")} and shown[3, "a"] >= 2
    assert mixing.mix(docs.limit(0)).collect() == []
    one = mixing.mix(docs.where("doc_id = 3")).collect()
    assert len(one) == 2


def test_columns_named_like_helpers(spark):
    names = ["row", "name", "none", "id", "hash", "total", "rows", "weight", "epochs", "blocks", "span", "u", "range", "sum", "before", "within", "t", "block", "__u", "__range", "__epochs"]
    rows = [(i, "a b c", "s%d" % (i % 2), *range(len(names))) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, "__epoch", "__block", "__tokens", "__weight"]
    plain = mixing.mix(docs.select("doc_id", "text", "source")).collect()
    assert sorted(r[:3] for r in map(tuple, got.collect())) == sorted(r[:3] for r in map(tuple, plain))
    inner = mixing.place(docs).select("row.*")
    assert inner.columns == docs.columns and {tuple(r) for r in inner.collect()} == set(rows)


def test_a_tiny_source_goes_through_very_many_epochs(spark):
    rows = [(1, "x", "tiny", 1), *[(2 + i, "w " * 30, "big", 1) for i in range(100)]]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), Settings(entropy=1.0, repeats=None)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 3000, **{2 + i: 1 for i in range(100)}}
