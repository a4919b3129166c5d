"""Substring dedup over words: difference-cover anchors, extended to whole windows.

A window is `window` consecutive words. Positions are anchors where their number modulo `period`
is in a difference cover: for any two positions there is a shift under `period` that takes both
to anchors. So two equal windows hold an aligned pair of equal anchors, if an anchor's hash spans
the first window - period + 1 words from it, and only anchors are hashed and compared.

An anchor whose words stand in two documents is extended to its context, the span of all windows
that hold it. Where another document with a smaller id has the same context, all of those windows
repeat at once. That settles the inside of copied text. Where contexts differ, at the edges of
copied text, the least document of each context also files the single windows that hold the
anchor, and the least document of each window decides.

Contexts and windows are told apart by 128-bit XXH3 hashes of their words as bytes, not by the words
themselves: of n different ones, two are taken for equal with a probability of about n * n / 2**129.

Every step is an aggregation to a minimum or an equi-join, so no group of copies is gathered.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, materialize, settle, texts

_SEED = 50
_ODD = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Settings:
    window: int = 50
    period: int = 31


def difference_cover(period: int) -> tuple[int, ...]:
    """A small set whose differences give every number modulo period. Greedy from 0 and 1, it
    tries sets of growing size, so perfect difference sets are found where they exist."""

    def grow(chosen: tuple[int, ...], size: int) -> tuple[int, ...] | None:
        if len(chosen) == size:
            return chosen if len({(a - b) % period for a in chosen for b in chosen}) == period else None
        left = size - len(chosen)
        seen = len({(a - b) % period for a in chosen for b in chosen})
        # each further element adds two differences to every one before it
        if seen + sum(2 * (len(chosen) + k) for k in range(left)) < period:
            return None
        for x in range(chosen[-1] + 1, period):
            found = grow((*chosen, x), size)
            if found:
                return found
        return None

    if period == 1:
        return (0,)
    size = 2
    while True:
        found = grow((0, 1), size)
        if found:
            return found
        size += 1


def normal(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words joined by one space, and where each starts and ends."""
    a = np.frombuffer(text, np.uint8)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    a = np.where(space, np.uint8(32), a)[keep]
    a = a[:-1] if len(a) and a[-1] == 32 else a
    edges = np.flatnonzero(a == 32)
    if not len(a):
        return b"", edges, edges
    return a.tobytes(), np.concatenate([[0], edges + 1]), np.concatenate([edges, [len(a)]])


def _keys(joined: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes."""
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], _SEED) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), "<u8")


def _names(joined: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit hashes of spans of bytes, as two columns."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(joined[a:b], _SEED) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), "<u8").reshape(-1, 2)


def _anchors(n: int, s: Settings, cover: tuple[int, ...]) -> np.ndarray:
    """Anchor positions of a document of n words whose span fits."""
    at = np.arange(max(0, n - (s.window - s.period)))
    return at[np.isin(at % s.period, cover)] if n >= s.window else at[:0]


def _context(p: np.ndarray, n: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows that hold the anchors at p."""
    return np.maximum(0, p - s.period + 1), np.minimum(p, n - s.window)


def _occurrences(docs: DataFrame, s: Settings, contexts: bool) -> DataFrame:
    """(key, doc_id) for each anchor, or (key, c1, c2, doc_id, reach) with its context's name; documents
    without a window have none. reach: the first and the last start of the windows that hold the
    anchor, in one number."""
    cover = difference_cover(s.period)
    span = s.window - s.period + 1
    names = ["key", "doc_id", "c1", "c2", "reach"] if contexts else ["key", "doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts: list[list[np.ndarray]] = [[] for _ in names]
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            if text is None or len(text) < 2 * s.window - 1:
                continue
            joined, start, end = normal(text)
            p = _anchors(len(start), s, cover)
            if not len(p):
                continue
            found = [_keys(joined, start[p], end[p + span - 1]).view(np.int64), np.full(len(p), doc_id)]
            if contexts:
                first, last = _context(p, len(start), s)
                name = _names(joined, start[first], end[last + s.window - 1])
                # where the anchor lies in its context belongs to the context
                found += [(name[:, 0] + (p - first).astype(np.uint64) * np.uint64(_ODD)).view(np.int64), np.ascontiguousarray(name[:, 1]).view(np.int64), first << 32 | last]
            for out, col in zip(parts, found, strict=True):
                out.append(col)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in parts], names)

    usable = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    return usable.mapInArrow(batched(run, 4 << 20), ", ".join(f"{n} long" for n in names))


def _single_windows(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(h1, h2, doc_id, at) of the windows whose starts are listed for their documents."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts: list[list[np.ndarray]] = [[] for _ in range(4)]
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2), strict=True):
            joined, start, end = normal(text or b"")
            n = len(start)
            if n < s.window:
                continue
            bounds = np.asarray(spans.values).reshape(-1, 2)
            marks = np.zeros(n + 2, np.int64)
            # a repeated id may have a shorter text than the spans are of
            np.add.at(marks, np.minimum(bounds[:, 0], n), 1)
            np.add.at(marks, np.minimum(bounds[:, 1] + 1, n), -1)
            at = np.flatnonzero(np.cumsum(marks)[: n - s.window + 1] > 0)
            name = _names(joined, start[at], end[at + s.window - 1])
            for out, col in zip(parts, (name[:, 0].copy().view(np.int64), name[:, 1].copy().view(np.int64), np.full(len(at), doc_id), at), strict=True):
                out.append(col)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(parts, kinds, strict=True)], ["h1", "h2", "doc_id", "at"])

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").select("doc_id", "text", "spans")
    return joined.mapInArrow(batched(run, 4 << 20), "h1 long, h2 long, doc_id long, at int")


def repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, spans): word ranges [start, end) of each document, as a flat list of bounds, that
    together cover just the words in windows which also start in a document with a smaller id.

    Documents without such words have no row.
    """
    # aggregates are written before they are joined: both sides of each join are then plain
    # shuffles, whose large partitions Spark can split
    shared = _occurrences(docs, s, False).groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("key")
    shared = materialize(shared, "anchors")
    met = settle(_occurrences(docs, s, True).join(shared, "key"), "met", shared)
    context = ["key", "c1", "c2"]
    owners = met.groupBy(*context).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("z")).where("owner < z").drop("z")
    owners = materialize(owners, "contexts")
    several = met.groupBy("key").agg(F.min(F.struct("c1", "c2")).alias("a"), F.max(F.struct("c1", "c2")).alias("z")).where("a < z").select("key")
    several = materialize(several, "several")
    marked = met.join(owners, context, "left")
    first, last = F.shiftright("reach", 32).cast("int"), F.col("reach").bitwiseAND(0xFFFFFFFF).cast("int")
    settled = marked.where("owner < doc_id").select("doc_id", first.alias("first"), (last + s.window).alias("end"))
    # what no earlier document has in full: the windows are looked at one by one, if any can differ
    left = marked.where("owner is null or owner >= doc_id").join(several, "key", "left_semi")
    wanted = materialize(_merged(left.select("doc_id", first.alias("first"), last.alias("last")), "first", "last"), "open")
    windows = settle(_single_windows(docs, wanted, s), "windows", wanted)
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("z")).where("owner < z").drop("z")
    least = materialize(least, "least")
    single = windows.join(least, ["h1", "h2"]).where("owner < doc_id").select("doc_id", F.col("at").alias("first"), (F.col("at") + s.window).alias("end"))
    return settle(_merged(settled.unionByName(single), "first", "end"), "spans", met, owners, several, windows, least)


def _merged(rows: DataFrame, first: str, end: str) -> DataFrame:
    """(doc_id, spans): each document's distinct ranges as a flat, ascending list of bounds. There
    are at most as many as the document has words, however often they were found."""
    pairs = rows.select("doc_id", F.array(F.col(first), F.col(end)).alias("pair")).distinct()
    return pairs.groupBy("doc_id").agg(F.flatten(F.array_sort(F.collect_list("pair"))).alias("spans"))


def cover(n: int, spans: np.ndarray) -> np.ndarray:
    """Which of n words the ranges cover."""
    bounds = np.minimum(spans.reshape(-1, 2), n)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, bounds[:, 0], 1)
    np.add.at(marks, bounds[:, 1], -1)
    return np.cumsum(marks)[:n] > 0


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Remove repeated windows' words: doc_id, n_words, n_removed, kept_sha256.

    Kept words are joined by one space. Null text has no words. Rows that repeat an id are judged
    by that id, so they never remove each other's words; windows of any of them count as that
    document's. A null id removes nothing and loses nothing. No rows: no rows. Columns besides doc_id
    and text are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, spans in zip(texts(batch.column(1)), batch.column(2), strict=True):
            words = (text or b"").split()
            if spans.is_valid:
                gone = cover(len(words), np.asarray(spans.values))
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                kept = words
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, removed, sha = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = repeats(docs, s).withColumnRenamed("doc_id", "id")
    joined = docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("id")).join(found, "id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(batched(run), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with repeated words taken out of text; a text that loses none stays as it is, and one
    that loses some becomes its kept words joined by one space. n_chars, where there is one, follows.
    Every row stays, with all its columns."""
    columns = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, spans in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if spans.is_valid and text is not None:
                words = text.encode().split()
                gone = cover(len(words), np.asarray(spans.values))
                if gone.any():
                    text = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode()
            out.append(text)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])

    # the other columns ride in a struct, so they may have any names
    rest = [c for c in columns if c != "text"]
    rows = docs.select("text", F.struct(*rest).alias("rest"), F.col("doc_id").cast("long").alias("id"))
    joined = rows.join(repeats(docs, s).withColumnRenamed("doc_id", "id"), "id", "left")
    cut = joined.select("text", "spans", "rest").mapInArrow(batched(run), rows.select("text", "rest").schema)

    def column(c: str) -> Column:
        own = F.col("text") if c == "text" else F.col("rest")[c]
        if c == "n_chars":
            own = F.when(F.col("text").isNull(), own).otherwise(F.length("text").cast(docs.schema[c].dataType))
        return own.alias(c)

    return cut.select(*map(column, columns))
