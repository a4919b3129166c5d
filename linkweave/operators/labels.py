"""Labels and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sampling


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Add y: 1 where (s1_id, cand_id) is in truth, else 0. truth may repeat pairs."""
    known = truth.select("s1_id", "cand_id").distinct().withColumn("y", F.lit(1).cast("byte"))
    return pairs.join(known, ["s1_id", "cand_id"], "left").withColumn("y", F.coalesce("y", F.lit(0).cast("byte")))


def class_weight(labelled: DataFrame) -> DataFrame:
    """Add w: negatives per positive for positives, 1 for negatives."""
    n = labelled.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    return labelled.withColumn("w", F.when(F.col("y") == 1, float(n.n - n.p) / max(1, n.p)).otherwise(1.0))


def same_country_negatives(s1: DataFrame, pool: DataFrame, n: int, seed: int) -> DataFrame:
    """(s1_id, cand_id): n query entities, each with a pool entity of its country by hash order.

    Both sides are numbered within their country and joined on the number modulo the country's pool.
    Numbers come from counts per country and hash range, so a large country isn't gathered to be
    numbered. A null country has no partner.
    """
    drawn = sampling.sample(s1.where("country is not null"), "entity_id", n, seed).select(F.col("entity_id").alias("s1_id"), "country")
    left = drawn.withColumn("i", F.row_number().over(Window.partitionBy("country").orderBy(sampling.order_key(F.col("s1_id"), seed), "s1_id")) - 1)
    right = _numbered(pool.where("country is not null"), "entity_id", "country", seed + 1).select(F.col("entity_id").alias("cand_id"), "country", F.col("i").alias("slot"))
    sizes = right.groupBy("country").agg(F.count("*").alias("size"))
    placed = left.join(sizes, "country").withColumn("slot", F.col("i") % F.col("size"))
    return placed.join(right, ["country", "slot"]).select("s1_id", "cand_id")


def _numbered(df: DataFrame, key: str, stratum: str, seed: int) -> DataFrame:
    """Add i: 0, 1, … within each stratum by hash order."""
    hashed = df.select(key, stratum, sampling.order_key(F.col(key), seed).alias("h")).withColumn("r", F.left("h", F.lit(2)))
    per = hashed.groupBy(stratum, "r").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(stratum).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select(stratum, "r", before.alias("start"))
    inner = F.row_number().over(Window.partitionBy(stratum, "r").orderBy("h", key)) - 1
    return hashed.withColumn("k", inner).join(starts, [stratum, "r"]).select(key, stratum, (F.col("start") + F.col("k")).alias("i"))
