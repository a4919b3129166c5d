"""Training, linking, rescoring, streaming and the command line on a small world."""

import random

from linkweave.operators import blocking as B
from linkweave.operators import model
from linkweave.plans import linkage
from linkweave.sources import results as R
from linkweave.streaming.link import link_stream, read_queries


def write(path, rows):
    path.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(r) + "\n" for r in rows))


def world(tmp_path):
    rnd = random.Random(0)
    words = [f"{a}{b}" for a in ("ACO", "BEL", "CIR", "DOM", "EST", "FAR") for b in ("TA", "LI", "MO", "RU", "SEN")]
    s1, pool, truth = [], [], []
    for i in range(60):
        name, addr = " ".join(rnd.sample(words, 3)), f"{rnd.randrange(10, 999)} {rnd.choice(words)} ROAD"
        country = rnd.choice(["US", "FR"])
        s1.append((f"S1-{i}", name, addr, country))
        ids = []
        for k in range(rnd.randrange(0, 3)):
            ids.append(f"S{2 + k % 2}-{i}{k}")
            pool.append((ids[-1], name + rnd.choice([" LTD", " INC", ""]), addr, country))
        pool.append((f"S2-x{i}", " ".join(rnd.sample(words, 3)), f"{rnd.randrange(10, 999)} {rnd.choice(words)} ROAD", country))
        truth.append((f"S1-{i}", ",".join(ids)))
    write(tmp_path / "s1.tsv", s1)
    write(tmp_path / "pool.tsv", pool)
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(r) + "\n" for r in truth))
    return {q: set(ids.split(",")) - {""} for q, ids in truth}


def test_train_link_rescore_validate(spark, tmp_path, monkeypatch):
    truth = world(tmp_path)
    at = [str(tmp_path / x) for x in ("s1.tsv", "pool.tsv", "truth.tsv", "model", "run", "run2")]
    common = ["--s1", at[0], "--pool", at[1]]
    assert linkage.main(["train", *common, "--truth", at[2], "--out", at[3], "--rounds", "5", "--arms", "A1", "A3"]) == 0
    assert linkage.main(["link", *common, "--model", at[3], "--out", at[4], "--threshold", "0.5"]) == 0
    lists = spark.read.option("sep", "\t").option("header", True).csv(f"{at[4]}/{R.MATCHES[1]}")
    got = {r[0]: set((r[1] or "").split(",")) - {""} for r in lists.collect()}
    assert set(got) == set(truth) and sum(got[q] == truth[q] for q in truth) > 50
    assert linkage.main(["rescore", *common, "--run", at[4], "--model", at[3], "--out", at[5], "--threshold", "0.5"]) == 0
    again = spark.read.option("sep", "\t").option("header", True).csv(f"{at[5]}/{R.MATCHES[1]}")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, lists.collect()), key=str)
    s1, pool = (linkage.load(spark, [p]) for p in at[:2])
    found = linkage.check_files(spark, f"{at[4]}/{R.MATCHES[1]}", f"{at[4]}/{R.CANDIDATES[1]}", s1, pool)
    assert found.collect() == []
    assert linkage.main(["validate", "--matches", at[1], "--s1", at[0]]) == 1
    monkeypatch.setenv("LINK_BUDGET", "7")
    assert linkage.Config.from_env(threshold=0.25).budget == 7 and linkage.Config.from_env(budget=9).budget == 9


def test_ensemble_weights(spark):
    rows = spark.createDataFrame([(float(i), float(i % 3), 1 if i > 20 else 0, 1.0, i % 5 > 0) for i in range(40)], "a double, b double, y int, w double, is_train boolean")
    fitted = [(model.fit(rows, k, ("a", "b"), 4), w) for k, w in (("forest", 3.0), ("linear", 1.0))]
    each = [[r.score for r in model.score(rows, [(m, 9.0)]).orderBy("a").collect()] for m, _ in fitted]
    both = [r.score for r in model.score(rows, fitted).orderBy("a").collect()]
    assert all(abs(z - (0.75 * x + 0.25 * y)) < 1e-6 for x, y, z in zip(*each, both))
    (top, share, alarm), *_ = model.importances(fitted[0][0], ("a", "b"))
    assert top == "a" and alarm == (share > model.IMPORTANCE_ALARM)
    spec = model.Spec(("a", "b"), (model.Part("forest", "p", 3.0),), 0.5, "A3", 0.9)
    assert model.Spec.of(spec.as_dict()) == spec


def test_stream(spark, tmp_path):
    world(tmp_path)
    (tmp_path / "in").mkdir()
    lines = (tmp_path / "s1.tsv").read_text().splitlines(keepends=True)
    for k in range(3):
        (tmp_path / "in" / f"{k}.tsv").write_text(lines[0] + "".join(lines[1 + 20 * k : 21 + 20 * k]))
    pool, b = linkage.load(spark, [str(tmp_path / "pool.tsv")]), B.Blocking(budget=20, by_country=True)
    link_stream(read_queries(spark, f"{tmp_path}/in", 1), pool, f"{tmp_path}/out", f"{tmp_path}/cp", b).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.select("batch").distinct().count() == 3
    # frequencies are the pool's, so batches change nothing
    want = B.candidates(linkage.load(spark, [str(tmp_path / "s1.tsv")]), pool, b)
    assert sorted(map(tuple, got.select("s1_id", "cand_id").collect())) == sorted(map(tuple, want.collect()))
