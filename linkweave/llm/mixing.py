"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised. The exponent is
bisected until the weights have a wanted entropy or no source repeats more often than allowed.
Weights are then realised as block permutations: every source is shuffled anew for each epoch,
runs through its share of a token budget, and is spread evenly over the blocks of the output, so
each block holds the sources in their weights up to the size of a document.

Sums over sources and running sums within them are distributed: a large source's permutation is
cut into hash ranges of bounded expected size, and only their totals are ordered together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, settle

#: exponents that one pass over the sources' totals tries
TRIES = 16
#: epochs that a row is multiplied by at once
SPAN = 1024


@dataclass(frozen=True)
class Settings:
    """Give entropy (a share, 0 to 1, of the logarithm of the number of sources) or repeats (the
    most epochs of any source); with both, the flatter weights that keep to the latter.

    budget: tokens to emit as a multiple of all tokens; None for as many as it takes to show every
    document at least once.
    """

    entropy: float | None = None
    repeats: float | None = 1.5
    budget: float | None = None
    block_tokens: int = 1 << 20
    range_rows: int = 4096
    seed: int = 0


def tokens(text: Column) -> Column:
    """The words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def totals(sized: DataFrame) -> DataFrame:
    """(source, total, rows) with at least one token each; a null source is a source of its own."""
    return sized.groupBy("source").agg(F.greatest(F.sum("tokens"), F.lit(1)).cast("double").alias("total"), F.count("*").alias("rows"))


def _measures(sums: DataFrame, exponents: list[float], s: Settings) -> list[tuple[float, float]]:
    """Entropy and most epochs of the weights under each exponent, in one pass."""
    logs, columns = F.log("total"), []
    top = sums.agg(F.max("total").alias("most"), F.min("total").alias("least"), F.sum("total").alias("all")).first()
    for x in exponents:
        p = F.pow(F.col("total") / top.most, F.lit(x))
        columns += [F.sum(p), F.sum(p * (logs - math.log(top.most)))]
    got = sums.agg(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    out = []
    for k, x in enumerate(exponents):
        z, zl = got[2 * k], got[2 * k + 1]
        # the largest or the smallest source has the most epochs
        tokens_out = s.budget * top.all if s.budget is not None else z * top.most
        epochs = max(tokens_out * (t / top.most) ** x / z / t for t in (top.most, top.least))
        out.append((math.log(z) - x * zl / z, epochs))
    return out


def exponent(sums: DataFrame, s: Settings) -> float:
    """The least exponent from 0 (all sources alike) to 1 (as they are) within the limits.

    Entropy falls and, as far as small sources go, so do the epochs as the exponent grows; each
    pass narrows the range TRIES-fold. 1 where nothing less will do.
    """
    if s.entropy is None and s.repeats is None:
        return 1.0
    n = sums.count()
    if n <= 1:
        return 1.0
    wanted = math.inf if s.entropy is None else s.entropy * math.log(n)

    def fits(measured: tuple[float, float]) -> bool:
        return measured[0] <= wanted + 1e-12 and (s.repeats is None or measured[1] <= s.repeats * (1 + 1e-12))

    low, high = 0.0, 1.0
    if fits(_measures(sums, [low], s)[0]):
        return low
    while high - low > 1e-9:
        grid = [low + (high - low) * k / TRIES for k in range(1, TRIES + 1)]
        good = [fits(m) for m in _measures(sums, grid[:-1], s)] + [True]
        k = good.index(True)
        low, high = grid[k - 1] if k else low, grid[k]
    return high


def weights(sums: DataFrame, s: Settings) -> DataFrame:
    """(source, total, rows, weight, epochs, blocks): how often each source is gone through."""
    x = exponent(sums, s)
    top = sums.agg(F.max("total").alias("most"), F.sum("total").alias("all")).first()
    if top.most is None:
        return sums.select("source", "total", "rows", F.lit(0.0).alias("weight"), F.lit(0.0).alias("epochs"), F.lit(1).cast("long").alias("blocks"))
    p = F.pow(F.col("total") / top.most, F.lit(x))
    z = sums.agg(F.sum(p)).first()[0]
    emitted = s.budget * top.all if s.budget is not None else z * top.most
    epochs = F.lit(emitted / z) * p / F.col("total")
    # the largest source's one epoch must not end a rounding error early
    epochs = F.when(F.abs(epochs - F.round(epochs)) < 1e-9, F.round(epochs)).otherwise(epochs)
    return sums.select("source", "total", "rows", (p / z).alias("weight"), epochs.alias("epochs"), F.lit(max(1, math.ceil(emitted / s.block_tokens))).cast("long").alias("blocks"))


def place(docs: DataFrame, s: Settings = Settings(), carry: tuple[str, ...] | None = None) -> DataFrame:
    """(row, epoch, block, tokens, weight): the rows of docs, each as often as its source's weight asks.

    row: a struct of the carried columns (None: all of docs), which so may have any names.
    A row is shown once in every whole epoch of its source, and in the part of an epoch that is
    left over if it starts within it in that epoch's permutation. Null texts have no tokens and are
    shown like others. A null source is a source of its own. Repeated rows are rows of their own.
    No rows: no rows. docs needs doc_id, text and source and must give the same rows when read
    again.
    """
    carry = tuple(docs.columns) if carry is None else carry
    # no keys are null, so that joins on them and the window need one and the same partitioning
    source = [F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none")]
    sized = docs.select(F.struct(*carry).alias("row"), *source, F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), tokens(F.col("text")).alias("tokens"))
    sums = materialize(totals(docs.select("source", tokens(F.col("text")).alias("tokens"))), "sources")
    plan = settle(weights(sums, s).select(*source, "total", "rows", "weight", "epochs", "blocks"), "weights", sums)
    # the sources' table is small next to the rows; Spark broadcasts it only if its size allows
    joined = sized.join(plan, ["name", "none"], "left").where("epochs > 0")
    last = F.ceil("epochs") - 1
    spans = joined.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / SPAN))))  # no long array in a row
    shown = (
        spans.withColumn("epoch", F.explode(F.sequence(F.col("span") * SPAN, F.least(F.col("span") * SPAN + (SPAN - 1), last))))
        .withColumn("epoch", F.col("epoch").cast("int"))
        .withColumn("u", F.xxhash64(F.lit(s.seed), F.col("epoch"), F.col("id"), F.col("hash")))
        .withColumn("range", F.floor((F.col("u") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("rows") / s.range_rows)))
        .drop("rows", "hash", "span")
    )
    key = ["name", "none", "epoch", "range"]
    of_ranges = shown.groupBy(*key).agg(F.sum("tokens").alias("sum"))
    before = W.partitionBy("name", "none", "epoch").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = of_ranges.select(*key, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy(*key).orderBy("u", "id").rowsBetween(W.unboundedPreceding, -1)
    placed = shown.withColumn("within", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(starts, key)
    t = F.col("epoch") + (F.col("before") + F.col("within")) / F.col("total")
    done = placed.withColumn("t", F.least(t, F.col("epoch") + F.lit(1.0 - 1e-12))).where(F.col("t") < F.col("epochs"))
    block = F.least(F.floor(F.col("t") / F.col("epochs") * F.col("blocks")), F.col("blocks") - 1)
    return done.select("row", "epoch", block.alias("block"), "tokens", "weight")


def mix(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of docs as `place` gives them, with __epoch, __block, __tokens and __weight added."""
    added = ["epoch", "block", "tokens", "weight"]
    return place(docs, s).select("row.*", *[F.col(c).alias(f"__{c}") for c in added])
