"""Labels, metrics, post-processing, result files and their rules."""

import pytest
from linkweave.operators import features, labels, metrics, postproc, validate
from linkweave.plans import linkage
from linkweave.sources import entities as E
from linkweave.sources import results as R
from linkweave.sources import stages

PAIRS = "s1_id string, cand_id string"


def test_f05_by_hand(spark):
    truth = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("d", "9")], PAIRS)
    scored = spark.createDataFrame([("a", "1", 0.9), ("a", "7", 0.8), ("c", "5", 0.6), ("d", "8", 0.7)], PAIRS + ", score double")
    spine = spark.createDataFrame([(x,) for x in "abcde"], "s1_id string")
    per = metrics.per_entity(scored, truth, spine, [0.5, 0.85])
    got = {(r.thr, r.s1_id): r.f for r in per.collect()}
    assert got[0.5, "a"] == pytest.approx(1.25 * 0.25 / (0.125 + 0.5)) and got[0.85, "a"] == pytest.approx(1.25 * 0.5 / (0.25 + 0.5))
    assert (got[0.5, "b"], got[0.5, "c"], got[0.5, "d"], got[0.5, "e"], got[0.85, "c"]) == (0.0, 0.0, 0.0, 1.0, 1.0)
    s = {r.thr: r for r in metrics.sweep(per).collect()}
    assert s[0.5].macro_all == pytest.approx((0.5 + 1) / 5) and s[0.5].micro_p == pytest.approx(1 / 4) and s[0.5].micro_r == pytest.approx(1 / 4)
    assert (s[0.5].empty_emitting, s[0.5].all_missed, s[0.85].empty_emitting) == (1, 2, 0)
    assert metrics.best(metrics.sweep(per)).first().thr == 0.85
    flattered = {(r.thr, r.s1_id): r.truth for r in metrics.per_entity(scored, truth, spine, [0.5], restrict=True).collect()}
    assert flattered[0.5, "a"] == 1 and flattered[0.5, "b"] == 0


def test_one_to_one_and_country(spark):
    scored = spark.createDataFrame([("S1-10", "x", 0.9), ("S1-1", "x", 0.9), ("S1-2", "x", 0.3), ("S1-2", "y", 0.4)], PAIRS + ", score double")
    want = [("S1-1", "x", 0.9), ("S1-2", "y", 0.4)]
    assert sorted(map(tuple, postproc.one_to_one(scored).collect())) == want == sorted(map(tuple, postproc.one_to_one_ranked(scored).collect()))
    s1 = spark.createDataFrame([("S1-1", "US"), ("S1-10", None), ("S1-2", "FR")], "entity_id string, country string")
    pool = spark.createDataFrame([("x", "US"), ("y", None)], "entity_id string, country string")
    assert [tuple(r) for r in postproc.same_country(scored, s1, pool).collect()] == [("S1-1", "x", 0.9)]


def test_labels(spark):
    pairs = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")], PAIRS)
    truth = spark.createDataFrame([("a", "1"), ("a", "1")], PAIRS)
    got = labels.class_weight(labels.label(pairs, truth)).collect()
    assert sorted((r.s1_id, r.cand_id, r.y, r.w) for r in got) == [("a", "1", 1, 3.0), ("a", "2", 0, 1.0), ("b", "1", 0, 1.0), ("b", "2", 0, 1.0)]


def test_lists_there_and_back(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-2",)], "entity_id string")
    pairs = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-1"), ("S1-1", "S2-1")], PAIRS)
    lists = R.assemble(s1, pairs)
    R.write_lists(lists.coalesce(1), f"{tmp_path}/m")
    text = sorted(line for r in spark.read.text(f"{tmp_path}/m").collect() for line in [r.value])
    assert text == ["S1-1\tS2-1,S3-2", "S1-2\t", "source1_entity_id\tmatched_entity_ids"]
    lines = R.read_lines(spark, f"{tmp_path}/m", R.MATCHES)
    assert sorted((r.key, r.ids) for r in lines.where("not is_header").collect()) == [("S1-1", "S2-1,S3-2"), ("S1-2", "")]
    assert sorted(map(tuple, R.explode_lists(lists).collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]
    assert sorted(r.id for r in R.first_column(spark, f"{tmp_path}/m").collect()) == ["S1-1", "S1-2"]
    odd = spark.createDataFrame([("a", "1;2"), ("b", "3;4"), ("c", None), ("d", "5 6")], "k string, ids string")
    assert R.separator(odd, "ids").first().separator == ";" and sorted(r.n for r in odd.select(R.n_matches(odd.ids, ";").alias("n")).collect()) == [0, 1, 2, 2]


RULES = [
    ("malformed_row", [("S1-1", None), ("S1-2", "")]),
    ("duplicate_key", [("S1-1", ""), ("S1-1", ""), ("S1-2", "")]),
    ("duplicate_id_in_list", [("S1-1", "S2-1,S2-1"), ("S1-2", "")]),
    ("self_match", [("S1-1", "S1-2"), ("S1-2", "")]),
    ("wrong_prefix", [("S1-1", "Q-1"), ("S1-2", "")]),
    ("unknown_id", [("S1-1", "S2-99"), ("S1-2", "")]),
    ("missing_key", [("S1-1", "")]),
    ("unexpected_key", [("S1-1", ""), ("S1-2", ""), ("S1-3", "")]),
]


@pytest.mark.parametrize("rule,rows", [*RULES, (None, [("S1-1", "S2-1, S2-2"), ("S1-2", "")])])
def test_each_rule(spark, rule, rows):
    known, need = spark.createDataFrame([("S2-1",), ("S2-2",)], "id string"), spark.createDataFrame([("S1-1",), ("S1-2",)], "id string")
    found = validate.lists(spark.createDataFrame(rows, "key string, ids string"), known, need)
    rules = {r.rule for r in found.collect()}
    assert (rule in rules if rule else not rules) and validate.passed(found) == (rule is None)
    assert rules <= {rule, "missing_key"}


def test_headers_and_subset(spark):
    assert validate.header("\t".join(R.MATCHES), R.MATCHES) == [] and validate.header(None, R.MATCHES) == [("empty_file", "error")]
    assert validate.header("a,b", R.MATCHES) == [("comma_separated", "error")] and validate.header("a\tb", R.MATCHES) == [("bad_header", "error")]
    a, b = spark.createDataFrame([("S1-1", "x"), ("S1-1", "y")], PAIRS), spark.createDataFrame([("S1-1", "x")], PAIRS)
    found = validate.subset(a, b)
    assert [tuple(r) for r in found.collect()] == [("match_not_candidate", "warning", 1, ["S1-1 -> y"])] and validate.passed(found)


def test_columns_are_found_by_name(spark):
    assert E.resolve_column(["Entity_ID", "Business_Name", "x"], "business_name", "name") == "Business_Name"
    with pytest.raises(ValueError):
        E.resolve_column(["a"], "name")
    with pytest.raises(ValueError):
        E.resolve_column(["the_name"], "name", exact=True)
    with pytest.raises(ValueError):
        E.check_rows(spark.range(3), 4)


def test_stages_go_on(spark, tmp_path):
    made = []

    def work(df):
        made.append(1)
        return df.selectExpr("id", "id * 2 as twice")

    path = f"{tmp_path}/t"
    a = stages.run_buckets(spark, spark.range(100), "id", path, 4, work)
    assert a.count() == 100 and len(made) == 4 and stages.todo(spark, path, 4) == []
    (tmp_path / "t" / "bucket=2" / "_SUCCESS").unlink()
    b = stages.run_buckets(spark, spark.range(100), "id", path, 4, work)
    assert len(made) == 5 and sorted(r.id for r in b.collect()) == list(range(100))
    stages.write_json(spark, {"a": [1, 2.5]}, f"{tmp_path}/x.json")
    assert stages.read_json(spark, f"{tmp_path}/x.json") == {"a": [1, 2.5]}


def test_features_of_edge_rows(spark):
    rows = [("q1", None, None, None), ("q2", "Café SARL", "00 Main", "FR"), ("q3", "A", "1", "US")]
    other = [("p1", None, None, None), ("p2", "CAFE", "00 Main", "FR"), ("p3", "B", "12345", "US")]
    schema = "entity_id string, name string, address string, country string"
    pairs = spark.createDataFrame([("q1", "p1"), ("q2", "p2"), ("q3", "p3")], PAIRS)
    got = {r.s1_id: r for r in features.featurize(pairs, spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)).collect()}
    assert len(features.FEATURES) == 36 and got["q1"].__fields__ == ["s1_id", "cand_id", *features.FEATURES]
    one, two, three = got["q1"], got["q2"], got["q3"]
    assert (one.nratio, one.nexact, one.addr_missing, one.country_eq, one.n_jw, one.n_token_set, one.lognum_sim) == (1, 0, 1, 1, 1, 0, 0)
    assert (two.nexact, two.nexact_suf, two.addr_exact, two.shared_num2, two.sc_A, two.sc_diff) == (0, 0, 1, 1, 1, 1) and two.lognum_sim != two.lognum_sim
    assert (three.nratio, three.a_lendiff, three.both_num, three.pref4_eq) == (0, pytest.approx(4 / 7), 0, 0)
    strict = features.featurize(pairs, spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema), ("country_eq",), null_country_equal=False)
    assert {r.s1_id: r.country_eq for r in strict.collect()} == {"q1": 0, "q2": 1, "q3": 1}


def test_absent_texts(spark):
    s1 = spark.createDataFrame([("S1-1", "a", "b"), ("S1-2", "", None), (None, "x", "y")], "entity_id string, name string, address string")
    pool = spark.createDataFrame([("S2-1", "a", ""), ("S2-1", "", "")], s1.schema)
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-1"), ("S1-2", "S2-9"), ("S1-9", None), (None, "S2-1")], "s1_id string, cand_id string")
    found = {r.side: (r.n_pairs, r.n_absent, r.n_blank) for r in features.absent(pairs, s1, pool).collect()}
    assert found == {"s1_id": (5, 2, 1), "cand_id": (5, 2, 0)}
    assert features.absent(pairs.limit(0), s1, pool).collect() == []


def test_files_that_are_no_lists(spark, tmp_path):
    def rules(text=None, at="matches.tsv"):
        if text is not None:
            (tmp_path / at).write_text(text)
        return sorted(r.rule for r in linkage.check_files(spark, str(tmp_path / at), None, None, None).collect())

    head = "\t".join(R.MATCHES)
    assert rules(at="none.tsv") == ["missing_file"] and rules("") == ["empty_file"]
    assert rules("a\tb\nno tab\nS1-1\tS1-2\n") == ["bad_header"] and rules("a,b\nno tab\n") == ["comma_separated"]
    assert rules(f" {head.upper()} \nS1-1\tS2-1\n\n  \n") == [] and rules(f"{head}\nS1-1\n\n") == ["malformed_row"]
