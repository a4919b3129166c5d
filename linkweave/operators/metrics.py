"""Linkage quality: per-entity F0.5, macro and micro figures, threshold sweeps.

Thresholds are a small table beside the scored pairs and one aggregation gives all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Beta squared of F0.5, and the share of query entities that have a match in production.
BETA2 = 0.25
MATCHED_SHARE = 0.9442


def f_beta(tp: Column, predicted: Column, truth: Column) -> Column:
    """F0.5 of one entity. No truth: 1 if nothing is predicted, else 0. Truth but no prediction: 0."""
    p = F.when(predicted > 0, tp.cast("double") / F.when(predicted > 0, predicted)).otherwise(1.0)
    r = tp.cast("double") / F.when(truth > 0, truth)
    f = F.when(BETA2 * p + r > 0, (1 + BETA2) * p * r / F.when(BETA2 * p + r > 0, BETA2 * p + r)).otherwise(0.0)
    return F.when(truth == 0, F.when(predicted == 0, 1.0).otherwise(0.0)).otherwise(f)


def thresholds(first: int, last: int, step: int, scale: int) -> list[float]:
    """first, first + step, … last, over scale."""
    return [k / scale for k in range(first, last + 1, step)]


def per_entity(scored: DataFrame, truth: DataFrame, spine: DataFrame, grid: list[float], restrict: bool = False) -> DataFrame:
    """(thr, s1_id, predicted, tp, truth, f) for every entity of spine and threshold of an ascending grid.

    scored: (s1_id, cand_id, score). truth: distinct pairs, counted in full, or with restrict only
    those that are candidates. spine: (s1_id); entities without candidates count, too. An entity's
    pairs are first counted by how many thresholds they pass, so the grid multiplies counts, not pairs.
    """
    steps = F.array(*map(F.lit, grid))
    marked = scored.join(truth.withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    counted = marked.groupBy("s1_id").agg(F.count("hit").alias("known")) if restrict else truth.groupBy("s1_id").agg(F.count("*").alias("known"))
    passed = F.size(F.filter(steps, lambda t: t <= F.col("score")))
    by_step = marked.groupBy("s1_id", passed.alias("passed")).agg(F.count("*").alias("predicted"), F.count("hit").alias("tp")).where("passed > 0")
    emitted = by_step.select("s1_id", "predicted", "tp", F.explode(F.slice(steps, F.lit(1), F.col("passed"))).alias("thr")).groupBy("thr", "s1_id").agg(F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    rows = spine.select("s1_id").distinct().join(counted, "s1_id", "left").select("*", F.explode(steps).alias("thr"))
    full = rows.join(emitted, ["thr", "s1_id"], "left").select("thr", "s1_id", *[F.coalesce(c, F.lit(0)).alias(k) for c, k in (("predicted", "predicted"), ("tp", "tp"), ("known", "truth"))])
    return full.withColumn("f", f_beta(F.col("tp"), F.col("predicted"), F.col("truth")))


def sweep(entities: DataFrame) -> DataFrame:
    """Figures by threshold: macro_all, macro_matched, micro precision, recall and F, empties that
    predict something, entities that miss everything, and the production-weighted macro."""
    tp, predicted, truth = F.sum("tp"), F.sum("predicted"), F.sum("truth")
    empty = F.col("truth") == 0
    emit = F.avg(F.when(empty, (F.col("predicted") > 0).cast("double")))
    matched = F.avg(F.when(~empty, F.col("f")))
    return entities.groupBy("thr").agg(
        F.avg("f").alias("macro_all"),
        matched.alias("macro_matched"),
        F.coalesce(tp / F.when(predicted > 0, predicted), F.lit(1.0)).alias("micro_p"),
        F.coalesce(tp / F.when(truth > 0, truth), F.lit(0.0)).alias("micro_r"),
        F.count_if(empty & (F.col("predicted") > 0)).alias("empty_emitting"),
        F.count_if(~empty & (F.col("tp") == 0)).alias("all_missed"),
        (MATCHED_SHARE * matched + (1 - MATCHED_SHARE) * (1 - F.coalesce(emit, F.lit(0.0)))).alias("weighted"),
    ).withColumn("micro_f", F.when(BETA2 * F.col("micro_p") + F.col("micro_r") > 0, (1 + BETA2) * F.col("micro_p") * F.col("micro_r") / F.when(BETA2 * F.col("micro_p") + F.col("micro_r") > 0, BETA2 * F.col("micro_p") + F.col("micro_r"))).otherwise(0.0))


def best(swept: DataFrame, by: str = "macro_all") -> DataFrame:
    """The threshold with the greatest figure; the least of equal ones."""
    return swept.orderBy(F.desc(by), "thr").limit(1)


def recall(cands: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """Blocking by country, and for ALL: true pairs, found ones, recall, and the number of candidates
    per entity (mean, median, 99th percentile, most, share of entities without any)."""
    found = cands.select("s1_id", "cand_id").distinct()
    per = found.groupBy("s1_id").agg(F.count("*").alias("n"))
    hits = truth.join(found.withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left").groupBy("s1_id").agg(F.count("*").alias("t"), F.count("hit").alias("h"))
    spine = s1.select(F.col("entity_id").alias("s1_id"), "country").join(per, "s1_id", "left").join(hits, "s1_id", "left").fillna(0, ["n", "t", "h"])
    return (
        spine.rollup("country")
        .agg(
            F.count("*").alias("entities"),
            F.sum("t").alias("true_pairs"),
            F.sum("h").alias("found_pairs"),
            F.avg("n").alias("mean_cands"),
            F.percentile("n", 0.5).alias("median_cands"),
            F.percentile("n", 0.99).alias("p99_cands"),
            F.max("n").alias("max_cands"),
            F.avg((F.col("n") == 0).cast("double")).alias("zero_share"),
            F.grouping("country").alias("g"),
        )
        .select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("country")).alias("country"), "entities", "true_pairs", "found_pairs", (F.col("found_pairs") / F.when(F.col("true_pairs") > 0, F.col("true_pairs"))).alias("recall"), "mean_cands", "median_cands", "p99_cands", "max_cands", "zero_share")
    )
