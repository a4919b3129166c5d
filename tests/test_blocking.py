"""Candidate generation against a plain Python restatement, and its invariants."""

import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from linkweave.operators import blocking as B
from linkweave.plans.queries import ORACLES, QUERIES

WORDS = "ACME GLOBAL TRADE NORTH SOUTH RIVER STONE LTD 12 34 560 MAIN ROAD PARK".split()
SCHEMA = "entity_id string, name string, address string, country string"


def world(seed, n_query=25, n_pool=120):
    rnd = random.Random(seed)

    def one(i, p):
        name = " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(0, 5))) or None
        addr = " ".join(rnd.choice(WORDS + ["12", "7"]) for _ in range(rnd.randrange(0, 6)))
        return (f"{p}-{i}", name, rnd.choice([addr, None, addr + "!"]), rnd.choice(["US", "FR", None]))

    return [one(i, "S1") for i in range(n_query)], [one(i, "S2") for i in range(n_pool)]


def norm(t):
    return re.sub(r"\s+", " ", re.sub(r"[!-/:-@\[-`{-~]", "", (t or "").upper())).strip()


def parts(row, bag):
    keep = list if bag else lambda x: list(dict.fromkeys(x))
    out = {"N": keep(re.findall(r"\w+", norm(row[1]))), "A": keep(re.findall(r"\w+", norm(row[2]))), "M": keep(re.findall(r"\d{2,}", norm(row[2])))}
    return out | {"X": [norm(row[1])] if row[1] is not None else []}


def restated(queries, pool, b):
    solo, pairs, country = defaultdict(list), defaultdict(set), {r[0]: r[3] for r in pool}
    order = {"N": 0, "A": 1, "M": 2}

    def pair_keys(p):
        tokens = sorted({(order[k], k, t) for k in "NAM" for t in p[k]})
        return [((a[1], a[2]), (c[1], c[2])) for a, c in itertools.combinations(tokens, 2)]

    for r in pool:
        p = parts(r, b.bag)
        for k in "NAMX":
            for t in p[k]:
                solo[k, t].append(r[0])
        for key in pair_keys(p):
            pairs[key].add(r[0])
    out = {}
    for r in queries:
        p = parts(r, False)
        ev = [(len(solo[k, t]), f"{k}:{t}", solo[k, t]) for k in "NAMX" for t in p[k] if solo[k, t]]
        if not b.solo_only:
            ev += [(len(pairs[key]), "+".join(":".join(x) for x in key), sorted(pairs[key])) for key in pair_keys(p) if 0 < len(pairs[key]) <= b.max_pair]
        union, seen = [], set()
        for df, _, ids in sorted(ev, key=lambda e: (e[0], e[1])):
            if df > b.budget:
                break
            ids = [i for i in ids if not b.by_country or (country[i] is not None and country[i] == r[3])]
            fresh = [i for i in ids if i not in seen]
            if len(union) + len(fresh) <= b.budget:
                for i in fresh:
                    if i not in seen:
                        seen.add(i)
                        union.append(i)
        if union:
            out[r[0]] = set(union)
    return out


@pytest.mark.parametrize("b", [B.Blocking(budget=10), B.Blocking(budget=50), B.Blocking(budget=100, by_country=True), B.Blocking(budget=30, bag=True), B.Blocking(budget=40, solo_only=True), B.Blocking(budget=60, max_pair=5)])
def test_candidates_match_the_restatement(spark, b):
    queries, pool = world(b.budget)
    got = defaultdict(set)
    rows = B.candidates(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(pool, SCHEMA).repartition(3), b).collect()
    for r in rows:
        got[r.s1_id].add(r.cand_id)
    assert sum(map(len, got.values())) == len(rows)
    assert dict(got) == restated(queries, pool, b)


def test_many_budgets_at_once(spark):
    queries, pool = world(3)
    s1, rest = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(pool, SCHEMA)
    grid = B.candidates_by(s1, rest, (5, 20, 60), (20, 200)).collect()
    for budget, limit in itertools.product((5, 20, 60), (20, 200)):
        want = restated(queries, pool, B.Blocking(budget=budget, max_pair=limit))
        got = {r.s1_id: set(r.cands) for r in grid if (r.budget, r.max_pair) == (budget, limit) and r.cands}
        assert got == want
    # a pair limit from the budget on changes nothing
    assert {(r.s1_id, r.budget): sorted(r.cands) for r in grid if r.max_pair == 20 and r.budget <= 20} == {(r.s1_id, r.budget): sorted(r.cands) for r in grid if r.max_pair == 200 and r.budget <= 20}


def test_autopsy_covers_every_true_pair(spark):
    queries, pool = world(4)
    s1, rest = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(pool, SCHEMA)
    truth = [(q[0], p[0]) for q in queries for p in pool if hash((q[0], p[0])) % 40 == 0]
    b = B.Blocking(budget=8)
    got = B.autopsy(s1, rest, spark.createDataFrame(truth, "s1_id string, cand_id string"), b).collect()
    assert sorted((r.s1_id, r.cand_id) for r in got) == sorted(truth)
    chosen = restated(queries, pool, b)
    assert all((r.reason == "covered") == (r.cand_id in chosen.get(r.s1_id, ())) for r in got)
    assert len(Counter(r.reason for r in got)) > 1


def test_entities_with_pair_keys_only(spark):
    pool = [(f"S2-{i}", t, None, c) for i, (t, c) in enumerate([("RIVER STONE", "US"), ("RIVER PARK", "US"), ("STONE PARK", "FR"), ("MAIN", "US")])]
    queries = [("S1-0", "STONE RIVER", None, "US"), ("S1-1", "STONE RIVER", None, "FR"), ("S1-2", "MAIN", None, "FR"), ("S1-3", "ROAD", None, "US")]
    s1, rest = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(pool, SCHEMA)

    def found(**given):
        return {r.s1_id: r.cands for r in B.candidates_by(s1, rest, (1,), solo_only=True, b=B.Blocking(**given)).collect()}

    assert found() == {"S1-0": [], "S1-1": [], "S1-2": ["S2-3"]}
    assert found(by_country=True) == {"S1-0": []}
    assert found(solo_only=True) == {"S1-2": ["S2-3"]}


def test_solo_budget_counts_entities_as_its_sql(spark, tmp_path):
    texts = ["river stone", *["stone north"] * 51, *["river north"] * 51, "stone of river"]
    rows = [(i, t, "en", f"src{min(i, 1)}", 7 if i else 8) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["budget_recall_solo"]).fetchall()
    got = QUERIES["budget_recall_solo"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == want == [(50, 200, 1, 0, 0, 0)]
