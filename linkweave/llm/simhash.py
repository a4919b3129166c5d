"""SimHash near-duplicate groups: pigeonhole blocks, a join on blocks, a Hamming check.

A fingerprint is cut into `blocks` blocks. Two that differ in at most `distance` bits agree on
at least blocks - distance whole blocks, so each fingerprint is filed under every choice of that
many blocks and close pairs meet under at least one key. Documents are first reduced to distinct
fingerprints, which takes copies out of every later step.

A key that holds many distinct fingerprints is not paired up. Its members are filed again under
each value that differs from theirs in up to distance / 2 bits outside the key: two members share
such a value just if they are within `distance`, so linking each to the least member there finds
the same components with rows linear in the members. Every link is checked.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, forget, materialize, settle, texts
from .components import connected

BITS = 64
SEED = 42


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The SimHash of a text's word shingles; 0 for a text without words."""
    tokens = (text or b"").lower().split()  # bytes.lower: A-Z only; bytes.split: ASCII white space
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(tokens) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 15):  # bounds the bit matrix of a very long text
        spans = zip(starts[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], np.dtype("<u8"))
        ones += _ones(h)
    return _majority(ones, len(starts))


def _ones(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def of_hashes(h: np.ndarray) -> int:
    """The SimHash of shingles that are hashed already; 0 for none."""
    h = h.astype("<u8")
    return _majority(sum((_ones(h[at : at + (1 << 15)]) for at in range(0, len(h), 1 << 15)), np.zeros(BITS, np.int64)), len(h))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row of docs; null and wordless texts get 0."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words) for t in texts(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batched(of), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _masks(blocks: int, distance: int) -> list[int]:
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    whole = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(whole, blocks - distance)]


def _near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def links(fps: DataFrame, distance: int = 2, blocks: int = 4, pair_limit: int = 64) -> DataFrame:
    """Edges (a, b), a < b, over the distinct values of fps.fp, whose components are those of
    all pairs within `distance` bits. distance: an even number, so that both sides of a link can
    carry half of it each."""
    if distance % 2:
        raise ValueError("distance must be even")
    masks = _masks(blocks, distance)
    filed = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block")) for i, m in enumerate(masks)])).alias("k"),
    ).select("fp", "k.i", "k.block")
    sizes = filed.groupBy("i", "block").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(filed.join(sizes, ["i", "block"]), "simhash-blocks")

    few = met.where(F.col("n") <= pair_limit)
    pairs = (
        few.select("i", "block", F.col("fp").alias("a"))
        .join(few.select("i", "block", F.col("fp").alias("b")), ["i", "block"])
        .where((F.col("a") < F.col("b")) & _near("a", "b", distance))
        .select("a", "b")
    )

    half = distance // 2
    flips = []
    for m in masks:
        free = [1 << i for i in range(BITS) if not m >> i & 1]
        flips.append([0, *(sum(c) for k in range(1, half + 1) for c in combinations(free, k))])
    many = met.where(F.col("n") > pair_limit)
    chosen = reduce(lambda rest, i: F.when(F.col("i") == i, F.array(*[F.lit(_signed(x)) for x in flips[i]])).otherwise(rest), range(len(masks)), F.array().cast("array<bigint>"))
    near = many.select("i", "fp", F.explode(chosen).alias("flip")).select("i", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), "fp")
    least = near.groupBy("i", "value").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").drop("z")
    stars = near.join(least, ["i", "value"]).where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b")).distinct().where(_near("a", "b", distance))
    return settle(pairs.unionByName(stars).distinct(), "simhash-edges", met)


def groups(docs: DataFrame, distance: int = 2, blocks: int = 4, pair_limit: int = 64, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the least doc_id that is reachable over
    links of at most `distance` differing bits. Null or wordless text: fingerprint zero, linked
    like any other. Fewer than `words` words: one shingle of all. Repeated rows each come back.
    A null doc_id keeps its row and never is a component's id while another id is there. No rows:
    no rows. Other columns are not read.
    """
    fps = materialize(fingerprints(docs, words), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = links(distinct, distance, blocks, pair_limit)
    joined = connected(edges)
    forget(edges)
    labelled = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(lowest, "label").select("fp", "component_id")
    found = fps.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return settle(found, "simhash-groups", fps, joined)
