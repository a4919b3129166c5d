"""The learners' table: written once, labelled as by the whole truth."""

import os
import subprocess
import sys

from linkweave.operators import blocking as B
from linkweave.operators import features as FT
from linkweave.operators import labels
from linkweave.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_labelled_features(spark):
    s1, pool = Q._sides(spark, SF)
    made = Q.labelled_features(spark, SF)
    pairs = B.candidates(s1, pool, B.Blocking(budget=25))
    want = FT.featurize(labels.label(pairs, Q._truth(s1, pool)), s1, pool).drop("w")
    got = made.select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("y = 1").count() > 0


def test_learners_read_a_written_table(spark, monkeypatch):
    """Blocking and features ran anew in every pass of a learner."""
    passes, fit = [], Q.model.fit
    monkeypatch.setattr(Q.model, "fit", lambda rows, *a, **b: (passes.append(rows.inputFiles()), fit(rows, *a, **b))[1])
    shared = Q.materialize(spark.range(1), "place")
    folder = os.path.dirname(shared._linkweave_path).removeprefix("file:")
    Q.forget(shared)
    before = set(os.listdir(folder))
    assert Q.feature_importance(spark, SF).count() == len(FT.FEATURES)
    assert passes and all("documents.parquet" not in f for p in passes for f in p)
    assert set(os.listdir(folder)) == before


FRESH = """
from pyspark.sql import SparkSession
from linkweave.operators import blocking as B
from linkweave.plans import queries as Q
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
made = [B.prepare(e).select(*B.PREPARED) for e in Q._sides(spark, "{sf}")]
threads = spark._jvm.java.lang.management.ManagementFactory.getThreadMXBean()
before = threads.getCurrentThreadAllocatedBytes()
for df in made:
    df._jdf.queryExecution().optimizedPlan()
print("MB", (threads.getCurrentThreadAllocatedBytes() - before) // 2**20)
"""


def test_planning_leaves_the_drivers_heap_small():
    """In a driver of its own, as what made the garbage is loaded once: 3.4 GB before."""
    out = subprocess.run([sys.executable, "-c", FRESH.format(sf=SF)], cwd=os.path.dirname(os.path.dirname(__file__)), capture_output=True, text=True, timeout=120)
    assert int(out.stdout.rpartition("MB")[2]) < 500, out.stderr[-500:]
