"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 4/5 or more.

All pairs are found, by prefix filtering. Shingles have a total order. Of two similar sets, the
larger one's first n - ceil(4n/5) + 1 shingles and the smaller one's first n - ceil(8n/9) + 1 share
one, and what is left after the first shared one bounds the overlap. Any order gives the same pairs;
here shingles that are frequent in a sample of the texts come last, so what many texts quote is
seldom filed. Every link is confirmed by the exact similarity of the texts.

A pair only comes up if its parity fingerprints are close: bit i tells whether an odd number of the
set's shingles fall to i. Each shingle that only one of two sets has flips one bit, so their Hamming
distance is never more than the number of such shingles, and similar sets can't be lost. Sets of more
shingles than such a fingerprint has bits have a wide one too, of at least a bit a shingle, by which pairs
are checked before any text is moved for them.

Texts with the same set are one from the start. Sets whose SimHash fingerprints are the same or link, as in
`simhash`, are compared next, and with them each set and the least one under each of its first few shingles:
two similar sets have the same first shingle as often as they are similar. Those that are alike are joined
before the other shingles are looked at, so copies don't meet again under each of the many that they share.
What is left is found by all shingles of the prefixes that have sets of several components. Under a shingle of
more than a few sets, every set is
first compared with some centres; what that connects needs no further pairs, so a large group of
copies costs rows linear in its members. As long as that connects many where many are still apart, it
goes on with other centres. Then sets under one shingle that are still apart are compared, without a
cap.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import batched, forget, materialize, settle, texts
from .components import connected

WORDS = 5
SEED = 42
#: 64-bit words of a parity fingerprint
PARITY = 8
#: under so many of its first shingles a set is compared with the least set, before anything else
LEADS = 4
#: at most so many links are joined to groups in one task (2 longs each), more by rounds over all executors
AT_ONCE = 1 << 18
#: under a shingle of more sets than FEW, that many centres are first compared with all of them
FEW, CENTRES = 16, 8
#: with more sets apart under one shingle, and this share of them linked by the last centres, others are tried
APART, PROGRESS = 256, 0.1
#: about as many texts show which shingles are frequent, and at most as many shingles are told
SAMPLED, TOLD = 10_000, 200_000


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; one shingle of all for fewer words."""
    tokens = (text or b"").lower().split()  # words as in simhash
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, ends, at = b" ".join(tokens), [], -1
    for t in tokens:
        at += len(t) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = zip(starts, ends[words - 1 :] or ends[-1:], strict=False)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64))


def parity(keys: np.ndarray) -> np.ndarray:
    """The parity fingerprint of a set, as PARITY signed 64-bit numbers."""
    n = 64 * PARITY
    odd = np.bincount((keys >> np.uint64(32)).astype(np.int64) % n, minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_parity(keys: np.ndarray) -> bytes | None:
    """The parity fingerprint of a set in the least power of two of bits that is no less than its size; None
    where `parity` has that many."""
    if len(keys) <= 64 * PARITY:
        return None
    n = 1 << (len(keys) - 1).bit_length()
    odd = np.bincount((keys >> np.uint64(32)).astype(np.int64) % n, minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Hamming distance of two wide fingerprints, the longer one folded to the bits of the other."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)))).sum())


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity is 4/5 or more; two empty sets are alike."""
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that several texts of a sample have, and in how many they are."""
    share = min(1.0, SAMPLED / max(1, docs.count()))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t) for t in texts(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["shingle"])

    unit = F.xxhash64(F.lit(SEED), "doc_id", "text").bitwiseAND((1 << 52) - 1) / float(1 << 52)
    counted = docs.where(unit < share).select("text").mapInArrow(batched(each), "shingle long").groupBy("shingle").agg(F.count("*").alias("df")).where("df > 2")
    got = counted.orderBy(F.desc("df"), "shingle").limit(TOLD).toArrow()
    hashes, df = got["shingle"].to_numpy().view(np.uint64), got["df"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], df[order]


def _ordered(keys: np.ndarray, hashes: np.ndarray, df: np.ndarray) -> np.ndarray:
    """A set's shingles, those of the least known frequency first, then by hash."""
    if not len(hashes) or not len(keys):
        return keys
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return keys[np.lexsort((keys, np.where(hashes[at] == keys, df[at], 0)))]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, size, sim, parity, wide, prefix) for every row: the set's hash, its size, its
    SimHash (each shingle once) and parity fingerprints, and the shingles that it is filed under."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs))  # TOLD shingles at most

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, sizes, sims, parities, wides, prefixes = [], [], [], [], [], []
        for text in texts(batch.column(2)):
            keys = shingles(text)
            n = len(keys)
            fps.append(xxhash.xxh64_intdigest(keys.tobytes(), SEED))
            sizes.append(n)
            sims.append(simhash.of_hashes(keys))
            parities.append(parity(keys))
            wides.append(wide_parity(keys))
            prefixes.append(_ordered(keys, *shared.value)[: n - -(-4 * n // 5) + 1].view(np.int64))
        columns = [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(sims, np.uint64).view(np.int64)), pa.array(parities, pa.list_(pa.int64())), pa.array(wides, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp", "size", "sim", "parity", "wide", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(batched(of), "doc_id long, text_hash long, fp long, size int, sim long, parity array<long>, wide binary, prefix array<long>")


def _may(x: str, y: str) -> Column:
    """Whether two sets, as structs of size, fp and at, may have a similarity of 4/5: by their sizes and by
    what follows the shared shingle at `at`."""
    a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
    left = F.least(a("size") - a("at"), b("size") - b("at"))
    return (F.least(a("size"), b("size")) * 5 >= F.greatest(a("size"), b("size")) * 4) & (left * 9 >= (a("size") + b("size")) * 4)


def _close(x: str, y: str) -> Column:
    """Whether the parity fingerprints of two sets, as structs of size and parity, allow it."""
    differ = F.lit(0)
    for i in range(PARITY):
        differ = differ + F.bit_count(F.col(f"{x}.parity")[i].bitwiseXOR(F.col(f"{y}.parity")[i]))
    return differ * 9 <= F.col(f"{x}.size") + F.col(f"{y}.size")


def _smaller(x: str, y: str) -> Column:
    return F.struct(f"{x}.size", f"{x}.fp") < F.struct(f"{y}.size", f"{y}.fp")


def _ordered_pairs(found: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of the structs s and l."""
    return found.select(F.least("s.fp", "l.fp").alias("a"), F.greatest("s.fp", "l.fp").alias("b")).distinct()


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(t or b"") for t in texts(batch.column(1))], pa.binary())], ["fp", "text"])


def _wanted(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of `of` whose fp is in a pair; written, so that Spark knows how few they may be."""
    wanted = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    return materialize(of.join(wanted, "fp", "left_semi"), "shingle-wanted")


def _within(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The pairs whose wide fingerprints, where both sets have one, allow a similarity of 4/5."""
    rows = zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)
    kept = [x is None or y is None or 9 * apart(x, y) <= m + n for m, x, n, y in rows]
    return batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of fps whose texts are alike."""
    known = _wanted(pairs, sets.select("fp", "size", "parity", "wide", "first.doc_id", "first.text_hash"))
    x, y = (known.select(F.col("fp").alias(c), F.struct("size", "parity", "wide").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    both = pairs.join(y, "b").join(x, "a").where(_close("x", "y")).select("a", "b", "x.size", "x.wide", F.col("y.size").alias("size_y"), F.col("y.wide").alias("wide_y"))
    pairs = materialize(both.mapInArrow(batched(_within), "a long, b long"), "shingle-within")
    reps = _wanted(pairs, known.select("fp", "doc_id", "text_hash"))
    forget(known)
    keyed = docs.select(_id(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = keyed.join(reps, ["doc_id", "text_hash"]).select("fp", "text")
    # a text is dealt by its set and then goes along with each of its pairs, so it is packed
    found = settle(found.mapInArrow(batched(_packed), "fp long, text binary").dropDuplicates(["fp"]), "shingle-texts", reps)
    both = pairs.join(found.select(F.col("fp").alias("b"), F.col("text").alias("y")), "b").join(found.select(F.col("fp").alias("a"), F.col("text").alias("x")), "a")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        last, kept = (None, None), []
        for a, x, y in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
            if a != last[0]:
                last = (a, shingles(zlib.decompress(x)))
            kept.append(alike(last[1], shingles(zlib.decompress(y))))
        return batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return settle(both.select("a", "b", "x", "y").mapInArrow(batched(check), "a long, b long"), "shingle-links", pairs, found)


def _id(c: Column) -> Column:
    """Ids with null last."""
    return F.coalesce(c.cast("long"), F.lit((1 << 63) - 1))


def _leads(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each set and the least one under each of its first shingles, where sizes allow it."""
    filed = sets.select("fp", "size", F.explode(F.slice("prefix", 1, LEADS)).alias("shingle"))
    least = filed.groupBy("shingle").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.min_by("size", "fp").alias("a_size")).where("a < z").drop("z")
    met = filed.join(least, "shingle").where((F.col("fp") != F.col("a")) & (F.least("size", "a_size") * 5 >= F.greatest("size", "a_size") * 4))
    return met.select("a", F.col("fp").alias("b"))


def simhash_links(sets: DataFrame, docs: DataFrame, besides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between similar sets whose SimHash fingerprints link, and the pairs that were tried. Sets
    of one fingerprint are compared with the least of them, and those of linked ones by their least. Pairs
    besides, a < b, are tried along with them."""
    least = sets.groupBy("sim").agg(F.min("fp").alias("least"))
    near = simhash.links(least.select(F.col("sim").alias("fp")))
    x, y = (least.select(F.col("sim").alias(c), F.col("least").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    across = near.join(x, "a").join(y, "b").select("x", "y")
    within = sets.select("sim", "fp").join(least, "sim").where("fp <> least").select(F.col("least").alias("x"), F.col("fp").alias("y"))
    pairs = across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = (pairs if besides is None else pairs.unionByName(besides)).distinct()
    pairs = settle(pairs, "shingle-simhash", near)
    return _confirmed(pairs, sets, docs), pairs


def links(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (a, b) over sets.fp whose components are those of all pairs of similar sets."""
    edges, tested = simhash_links(sets, docs, _leads(sets))
    filed = sets.select("fp", "size", F.posexplode("prefix").alias("at", "shingle"))
    low = F.col("at") <= F.col("size") - F.ceil(F.col("size") * 8 / 9)
    # most shingles are one set's: they are counted by themselves, so that little moves for them
    several = filed.groupBy("shingle").agg(F.count("*").alias("n"), F.max(low).alias("low")).where("n > 1 and low").select("shingle", "n")
    several = materialize(several, "shingle-several")
    blocks = filed.join(several, "shingle").select("shingle", "n", low.alias("low"), F.struct("size", "fp", "at").alias("l"), F.col("fp").alias("label"))
    now = _still_apart(settle(blocks, "shingle-blocks", several), edges)

    # under a shingle of a few sets, these are compared at once
    few = now.where(F.col("n") <= FEW).select("shingle", "low", "l", "label")
    small = few.where("low").select("shingle", F.col("l").alias("s"), F.col("label").alias("own"))
    few_pairs = _ordered_pairs(small.join(few.drop("low"), "shingle").where((F.col("own") != F.col("label")) & _smaller("s", "l") & _may("s", "l")))
    few_pairs = materialize(few_pairs.join(tested, ["a", "b"], "left_anti"), "shingle-few")

    many = now.where(F.col("n") > FEW).withColumn("fp", F.col("l.fp")).join(sets.select("fp", "parity"), "fp")
    now = settle(many.select("shingle", "n", "low", F.struct("l.size", "l.fp", "l.at", "parity").alias("l"), "label"), "shingle-apart", now)
    turn = 0
    while True:
        found, tried = _around_centres(now, few_pairs if not turn else None, tested, sets, docs, turn)
        linked = found.count()
        edges = settle(edges.unionByName(found), "shingle-edges", edges, found)
        tested = settle(tested.unionByName(tried), "shingle-tested", tested, tried)
        now = _still_apart(now, edges)
        most = now.groupBy("shingle").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        turn += 1
        if most <= APART or linked < PROGRESS * now.select("l.fp").distinct().count():
            break
    small = now.where("low").select("shingle", F.col("l").alias("s"), F.col("label").alias("own"))
    crossed = small.join(now.drop("low"), "shingle").where((F.col("own") != F.col("label")) & _smaller("s", "l") & _may("s", "l") & _close("s", "l"))
    rest = settle(_ordered_pairs(crossed).join(tested, ["a", "b"], "left_anti"), "shingle-rest", now, tested)
    more = _confirmed(rest, sets, docs)
    return settle(edges.unionByName(more), "shingle-edges", edges, rest, more)


def _around_centres(now: DataFrame, besides: DataFrame | None, tested: DataFrame, sets: DataFrame, docs: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links between sets under a shingle and a few centres there, and among pairs besides; and the pairs that
    were tried. Half of the centres are drawn from all sets, half from all components, anew in each turn."""
    drawn = [F.min(F.struct(F.xxhash64(F.lit(CENTRES * turn + i), "l.fp" if i % 2 else "label").alias("by"), F.col("l.fp").alias("fp")))["fp"] for i in range(CENTRES)]
    chosen = now.groupBy("shingle").agg(F.array_distinct(F.array(*drawn)).alias("c")).select("shingle", F.explode("c").alias("fp"))
    centred = now.withColumn("fp", F.col("l.fp")).join(chosen, ["shingle", "fp"]).select("shingle", F.col("l").alias("s"), F.col("label").alias("own"))
    centred = materialize(centred, "shingle-centres")
    pairs = _ordered_pairs(now.join(centred, "shingle").where((F.col("own") != F.col("label")) & _may("s", "l") & _close("s", "l")))
    pairs = pairs.join(tested, ["a", "b"], "left_anti")
    pairs = pairs if besides is None else pairs.unionByName(besides).distinct()
    pairs = settle(pairs, "shingle-stars", centred, *([besides] if besides is not None else []))
    return _confirmed(pairs, sets, docs), pairs


def _still_apart(now: DataFrame, edges: DataFrame) -> DataFrame:
    """The sets under shingles that have several components, with their components' labels."""
    joined = connected(edges, at_once=AT_ONCE)
    label = joined.select(F.col("node").alias("fp"), F.col("label").alias("new"))
    split = now.withColumn("fp", F.col("l.fp")).join(label, "fp", "left").select("shingle", "n", "low", "l", F.coalesce("new", "fp").alias("label"))
    split = settle(split, "shingle-labels", now, joined)
    mixed = materialize(split.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("z")).where("x < z").select("shingle"), "shingle-mixed")
    return settle(split.join(mixed, "shingle"), "shingle-apart", split, mixed)


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, head) for every row of docs; head: the least (doc_id, text_hash) that is
    reachable over pairs of similar texts, with null ids last, as the greatest long.

    Null and wordless texts have the empty set and are alike. Repeated rows each come back. No rows:
    no rows. Columns besides doc_id and text are not read.
    """
    filed = materialize(signatures(docs), "shingles")
    one = filed.groupBy("fp").agg(F.min(F.struct(_id(F.col("doc_id")).alias("doc_id"), "text_hash")).alias("first"), F.first("size").alias("size"), F.first("sim").alias("sim"), F.first("parity").alias("parity"), F.first("wide").alias("wide"), F.first("prefix").alias("prefix"))
    sets = materialize(one, "shingle-sets")
    rows = settle(filed.select("doc_id", "text_hash", "fp"), "shingle-rows", filed)  # without the prefixes
    edges = links(sets, docs)
    joined = connected(edges, at_once=AT_ONCE)
    labelled = sets.select("fp", "first").join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    labelled = settle(labelled, "shingle-groups", edges, sets, joined)
    heads = materialize(labelled.groupBy("label").agg(F.min("first").alias("head")), "shingle-heads")
    found = rows.join(labelled.join(heads, "label").select("fp", "head"), "fp").select("doc_id", "text_hash", "fp", "head")
    return settle(found, "shingle-members", rows, labelled, heads)
