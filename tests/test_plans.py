"""Plans are the ones wanted: pruned scans, no Python in blocking, no product of tables."""

import re

import pytest
from linkweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
NATIVE = [n for n in QUERIES if n not in ("features_all", "name_jaro_winkler", "model_scores", "score_separation", "feature_importance")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_no_products_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas", text)


def test_scans_are_pruned(spark):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["hash_sample"](spark, SF)))
    assert read and all({c.split(":")[0] for c in r.split(",")} <= {"doc_id", "source", "lang"} for r in read)


def test_features_use_python_once(spark):
    assert plan(QUERIES["features_all"](spark, SF)).count("ArrowEvalPython") == 1
