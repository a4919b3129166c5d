"""SimHash groups against a brute-force restatement."""

import random

import xxhash
from linkweave.llm import simhash

SCHEMA = "doc_id long, text string, fp string, label string"


def brute(rows):
    fps = []
    for _, text in rows:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for (d, _), c in zip(rows, label):
        least[c] = min(least.get(c, d), d)
    return sorted((d, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, label))


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    base = [" ".join(rnd.choice("the of AND to Été in that rain sun moon").split() * 1 + [str(rnd.randrange(40))]) for _ in range(40)]
    texts = [" ".join(rnd.choice(base) for _ in range(rnd.randrange(2, 60))) for _ in range(40)]
    texts += [t + " x" for t in texts[:20]] + texts[:10] + [None, "", "  \n ", "one", "One two", "x" * 30000, "a b " * 20000]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    for limit in (64, 1):  # by pairs, and by flipped values
        got = simhash.groups(spark.createDataFrame([(d, t, "a", "b") for d, t in rows], SCHEMA).repartition(3), pair_limit=limit)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted(map(tuple, got.collect())) == brute(rows)


def test_dense_block_by_flips_equals_pairs(spark):
    rnd = random.Random(2)
    values = sorted({(7 << 40) ^ (1 << rnd.randrange(30)) ^ (1 << rnd.randrange(30)) ^ (1 << rnd.randrange(64)) for _ in range(150)})
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    from linkweave.llm.components import connected

    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    a, b = (sorted(map(tuple, connected(simhash.links(fps, pair_limit=n)).collect())) for n in (10**6, 3))
    assert a == b and a


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c")]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert simhash.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
