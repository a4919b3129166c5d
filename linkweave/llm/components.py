"""Connected components by alternating large-star and small-star rounds, or of few edges in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over rows (a, b) with a < b.

    large: each node ties its larger neighbours to the least of its neighbours and itself.
    small: each node ties its smaller neighbours, and itself, to the least of them.
    Only a minimum per node is gathered, never a node's list of neighbours.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        tied = both.where("b > a").join(least, "a").select("m", "b")
    else:
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        tied = edges.join(least, "b").select("m", F.col("a").alias("b")).unionByName(least.select("m", "b"))
    return tied.where("m < b").select(F.col("m").alias("a"), "b").distinct()


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), sorted, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[label]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sides = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if sides:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in least_nodes(*map(np.concatenate, zip(*sides, strict=True)))], ["node", "label"])


def connected(edges: DataFrame, max_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label is the least node of its component.

    Up to `at_once` edges, of a written table, are joined in one task, which saves the driver and the
    executors the plans and tasks of some rounds; more go by rounds.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs
    one round at most. No edges: no rows. Ends when a round changes nothing; raises if that
    takes more than max_rounds, rather than return unfinished components.
    """
    if at_once and edges.count() <= at_once:
        return materialize(edges.where("a <> b").select("a", "b").coalesce(1).mapInArrow(_in_one_task, "node long, label long"), "components")
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        # a sum of 64-bit hashes can wrap; as decimals it can't, and equal sets have equal sums
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            labels = now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
            return settle(labels, "components", now)
        seen = state
        was, now = now, materialize(_star(_star(now, True), False), "edges")
        forget(was)
    raise RuntimeError(f"components still change after {max_rounds} rounds")
