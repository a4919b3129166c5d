"""Repeatable randomness from ids: the same rows whatever the partitions, and in other engines too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DIGITS = 12


def order_key(c: Column, seed: int) -> Column:
    """A hash to sort by, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws("#", c.cast("string"), F.lit(str(seed))))


def unit(c: Column, seed: int) -> Column:
    """A number from 0 to 1, neither of them, from a hash."""
    return (F.conv(F.left(order_key(c, seed), F.lit(_DIGITS)), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(order_key(F.col(key), seed), F.col(key)).limit(n)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, each draw in proportion to weight: the least -ln(u) / weight go
    first. Rows without a positive weight are never drawn."""
    drawn = -F.log(unit(F.col(key), seed)) / F.col(weight)
    return df.where(F.col(weight) > 0).orderBy(drawn, F.col(key)).limit(n)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum. Spark keeps only the first n of a partition's strata before it
    shuffles, so a large stratum is not gathered."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(order_key(F.col(key), seed), F.col(key)))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def split(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """Add is_train: whole groups, about `share` of them."""
    return df.withColumn("is_train", unit(F.col(group), seed) < share)
