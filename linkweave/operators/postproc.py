"""From scored pairs to results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def emit(scored: DataFrame, threshold: float) -> DataFrame:
    """Pairs that score at least the threshold."""
    return scored.where(F.col("score") >= threshold)


def same_country(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs whose entities have one country; a null country equals none."""
    left = s1.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("c1"))
    right = pool.select(F.col("entity_id").alias("cand_id"), F.col("country").alias("c2"))
    return pairs.join(left, "s1_id").join(right, "cand_id").where("c1 = c2").select(*pairs.columns)


def one_to_one(scored: DataFrame) -> DataFrame:
    """Each pool entity goes to its best-scoring query entity; the least id of equal ones.

    An aggregation to a maximum, so a pool entity with many pairs is not gathered.
    """
    best = scored.groupBy("cand_id").agg(F.min(F.struct((-F.col("score")).alias("worse"), F.col("s1_id"), F.col("score"))).alias("b"))
    return best.select("b.s1_id", "cand_id", "b.score")


def one_to_one_ranked(scored: DataFrame) -> DataFrame:
    """The same by a window, for further columns of the pairs."""
    rank = F.row_number().over(Window.partitionBy("cand_id").orderBy(F.desc("score"), "s1_id"))
    return scored.withColumn("__r", rank).where("__r = 1").drop("__r")


POSTPROCESS = {
    "none": lambda scored, s1, pool: scored,
    "country": same_country,
    "country+1to1": lambda scored, s1, pool: one_to_one_ranked(same_country(scored, s1, pool)),
}
