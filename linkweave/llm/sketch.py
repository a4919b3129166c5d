"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs, at line ends and, within lines, after words picked by their own
bytes, so an edit moves no cut but those beside it. Each paragraph's digest, numbered where it
repeats, goes into three cells of a sketch; a cell holds a count, a sum of digests and a sum of
checks. Subtracting two sketches leaves what differs, and peeling cells that hold one digest
recovers it. Where peeling gets stuck, both sides are sketched again in twice the cells. All
documents of a batch are sketched and peeled together.

The module also orders a table by descending doc_id and gives each row its successor without a
global window: rows are dealt to id ranges, and the first row of a range is also sent to the
range before it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: digests go to one cell in each of this many equal parts of a sketch
WAYS = 3
#: cells of the sketch that the fingerprint shows
CELLS = 24
#: one word in this many ends a paragraph within a line
WORDS = 16
#: ranges that the successors are looked up in; rows stream through a range, so it may be large
MOST_RANGES = 30_000

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX[k]
    x = (x ^ (x >> np.uint64(32))) * _MIX[(k + 1) % 4]
    return x ^ (x >> np.uint64(31))


def paragraphs(text: bytes) -> list[bytes]:
    """The text cut after every line end and after about one word in WORDS, chosen by the eight
    bytes before the space; joined they give the text again. An empty text has none."""
    a = np.frombuffer(b"\0" * 8 + text, np.uint8)
    space = np.flatnonzero(a[8:] == 32)
    last = np.lib.stride_tricks.sliding_window_view(a, 8)[space]
    word = np.ascontiguousarray(last).view("<u8").reshape(-1).astype(np.uint64)
    cuts = np.concatenate([space[_mix(word, 0) % np.uint64(WORDS) == 0], np.flatnonzero(a[8:] == 10)]) + 1
    edges = np.unique(np.concatenate([[0], cuts, [len(text)]])).tolist()
    return [text[i:j] for i, j in zip(edges, edges[1:], strict=False)]


@dataclass(frozen=True)
class Digests:
    """Paragraph digests of several texts: text number and digest, distinct within a text."""

    of: np.ndarray
    value: np.ndarray
    count: np.ndarray


def digests(texts: list[bytes]) -> Digests:
    """64-bit digests of every paragraph; the k-th repeat of one in a text gets a digest of its own."""
    found = [[xxhash.xxh64_intdigest(p, 0) for p in paragraphs(t)] for t in texts]
    count = np.array([len(f) for f in found], np.int64)
    of = np.repeat(np.arange(len(texts)), count)
    value = np.array([x for f in found for x in f], np.uint64)
    order = np.lexsort((value, of))
    o, v = of[order], value[order]
    new = np.ones(len(v), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    at = np.arange(len(v))
    nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return Digests(o, np.where(nth > 0, _mix(v + nth * _MIX[2], 1), v), count)


def _cells(of: np.ndarray, value: np.ndarray, m: int) -> Iterator[np.ndarray]:
    for k in range(WAYS):
        yield of * m + k * (m // WAYS) + (_mix(value, k) % np.uint64(m // WAYS)).astype(np.int64)


def sketches(d: Digests, n: int, m: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest sums and check sums (both modulo 2**64), each n texts by m cells."""
    counts, keys, checks = np.zeros(n * m, np.int64), np.zeros(n * m, np.uint64), np.zeros(n * m, np.uint64)
    check = _mix(d.value, 3)
    for cell in _cells(d.of, d.value, m):
        np.add.at(counts, cell, 1)
        np.add.at(keys, cell, d.value)
        np.add.at(checks, cell, check)
    return counts, keys, checks


def fingerprints(d: Digests, n: int) -> list[str]:
    """The sketches of n texts, in CELLS cells each, as base64 text."""
    counts, keys, checks = sketches(d, n)
    cells = np.zeros(n * CELLS, [("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
    cells["count"], cells["key"], cells["check"] = counts, keys, checks & np.uint64(0xFFFFFFFF)
    width = cells.itemsize * CELLS
    raw = cells.tobytes()
    return [base64.b64encode(raw[i * width : (i + 1) * width]).decode() for i in range(n)]


def _peel(counts: np.ndarray, keys: np.ndarray, checks: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Recover differences from subtracted sketches: how many per text, whether all, and which."""
    recovered, found = np.zeros(n, np.int64), []
    look = np.arange(n * m)
    while len(look):
        look = look[np.abs(counts[look]) == 1]
        sign = counts[look]
        key = np.where(sign > 0, keys[look], np.uint64(0) - keys[look])
        check = np.where(sign > 0, checks[look], np.uint64(0) - checks[look])
        pure = _mix(key, 3) == check
        of, key, sign = look[pure] // m, key[pure], sign[pure]
        if not len(of):
            break
        order = np.lexsort((key, of))
        of, key, sign = of[order], key[order], sign[order]
        once = np.ones(len(of), bool)
        once[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
        of, key, sign = of[once], key[once], sign[once]
        found.append((of, key, sign))
        np.add.at(recovered, of, 1)
        plus = sign > 0
        signed, check = np.where(plus, key, np.uint64(0) - key), _mix(key, 3)
        signed_check = np.where(plus, check, np.uint64(0) - check)
        touched = []
        for cell in _cells(of, key, m):
            np.subtract.at(counts, cell, sign)
            np.subtract.at(keys, cell, signed)
            np.subtract.at(checks, cell, signed_check)
            touched.append(cell)
        look = np.unique(np.concatenate(touched))
    whole = ((counts == 0) & (keys == 0) & (checks == 0)).reshape(n, m).all(axis=1)
    return recovered, whole, found


def _some(d: Digests, which: np.ndarray) -> Digests:
    place = np.full(len(d.count), -1)
    place[which] = np.arange(len(which))
    mine = place[d.of] >= 0
    return Digests(place[d.of[mine]], d.value[mine], d.count[which])


def differences(a: Digests, b: Digests, cells: int = CELLS) -> np.ndarray:
    """For each pair of texts, how many digests only one of them has, from subtracted sketches.

    Pairs whose sketch doesn't peel whole are sketched again in twice the cells, until all do.
    """
    out, left, m = np.zeros(len(a.count), np.int64), np.arange(len(a.count)), cells
    while len(left):
        n = len(left)
        x, y = _some(a, left), _some(b, left)
        recovered, whole, _ = _peel(*(p - q for p, q in zip(sketches(x, n, m), sketches(y, n, m), strict=True)), n, m)
        out[left[whole]] = recovered[whole]
        left, m = left[~whole], 2 * m
    return out


def likeness(a: Digests, b: Digests) -> np.ndarray:
    """Shared digests over all digests of both, for each pair of texts; 1 where both are empty."""
    apart = differences(a, b)
    both = (a.count + b.count - apart) / 2
    return np.where(both + apart > 0, both / np.maximum(both + apart, 1), 1.0)


_LEAST = -(1 << 63)


def _ranges(docs: DataFrame, n: int) -> tuple[np.ndarray, dict[int, int], dict[int, tuple[int, int]]]:
    """Bounds of about n ranges of descending (id, text hash), the range after each, and the first
    key of each range. All are as many as the ranges, whatever the rows hold."""
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("id"), F.xxhash64("text").alias("hash"))
    cuts = keys.select(F.col("id").cast("double")).approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = np.sort(np.array([max(_LEAST, min(int(c), -_LEAST - 1)) for c in cuts], np.int64))

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, hashes = (c.to_numpy() for c in batch.columns)
        return pa.RecordBatch.from_arrays([pa.array(_range_of(ids, hashes, bounds)), *batch.columns], ["range", "id", "hash"])

    per = keys.mapInArrow(lambda it: map(dealt, it), "range long, id long, hash long").groupBy("range").agg(F.max(F.struct("id", "hash")).alias("first")).collect()
    first = {r.range: (r.first.id, r.first.hash) for r in per}
    order = sorted(first)
    return bounds, dict(zip(order, order[1:] + order[:1], strict=True)), first


def _range_of(ids: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Range number, lower for greater keys. An id that fills several ranges is spread by hash."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    part = ((hashes.astype(np.float64) / 2.0**64 + 0.5) * (high - low + 1)).astype(np.int64)
    return len(bounds) - np.minimum(low + part, high)


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprint every row of docs and compare it with an edited text and with its successor.

    Rows are taken in descending (doc_id, text hash); a null doc_id comes last; the last row is
    followed by the first, and a sole row by itself. The edited text has the last third of the
    code points, rounded down, replaced by the first as many (or all) of the successor. Null texts
    count as empty; empty ones have an empty sketch and are alike. Repeated rows each come back.
    No rows: no rows. Columns besides doc_id and text are not read.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    docs = docs.select("doc_id", "text")
    parts = max(1, min(docs.rdd.getNumPartitions(), MOST_RANGES // 3))
    bounds, after, first = _ranges(docs, 3 * parts)
    before = {b: a for a, b in after.items()}
    heads = {key: before[r] for r, key in first.items()}  # one for each range

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, hashes = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        own = _range_of(ids, hashes, bounds)
        extra = [(i, heads[k]) for i, k in enumerate(zip(ids.tolist(), hashes.tolist(), strict=True)) if k in heads]
        rows = pa.array(np.concatenate([np.arange(len(ids)), [i for i, _ in extra]]).astype(np.int64))
        place = np.concatenate([own, [r for _, r in extra]]).astype(np.int64)
        ahead = np.arange(len(rows)) >= len(ids)
        return pa.RecordBatch.from_arrays([*batch.take(rows).columns, pa.array(place), pa.array(ahead)], [*batch.schema.names, "range", "ahead"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("id"), F.xxhash64("text").alias("hash"))
    ranged = keyed.mapInArrow(lambda it: map(deal, it), f"doc_id {kind}, text string, id long, hash long, range long, ahead boolean")
    ordered = ranged.repartition(parts, "range").sortWithinPartitions("range", "ahead", F.desc("id"), F.desc("hash")).select("doc_id", "text", "range", "ahead")
    return ordered.mapInArrow(_walk, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _walk(batches: Iterator[pa.RecordBatch], flush_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pair each row with the one after it in its range, and compare the pairs in batches."""
    last, held, size = None, [], 0
    for batch in batches:
        kind = batch.schema.field(0).type
        for doc_id, text, place, ahead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is not None and last[2] == place:
                held.append((last[0], last[1], text))
                size += len(last[1]) + len(text)
            last = None if ahead else (doc_id, text, place)
            if size > flush_bytes:
                yield _compare(held, kind)
                held, size = [], 0
    if held:
        yield _compare(held, kind)


def _compare(pairs: list[tuple[int | None, str, str]], kind: pa.DataType) -> pa.RecordBatch:
    edited = []
    for _, text, following in pairs:
        cut = len(text) // 3
        edited.append((text[: len(text) - cut] + following[:cut]).encode())
    n = len(pairs)
    here = digests([t.encode() for _, t, _ in pairs])
    changed = digests(edited)
    ahead = digests([t.encode() for _, _, t in pairs])
    columns = [
        pa.array([p[0] for p in pairs], kind),
        pa.array([len(p[1]) for p in pairs], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
        pa.array(fingerprints(here, n)),
        pa.array(fingerprints(changed, n)),
        pa.array(likeness(here, changed)),
        pa.array(likeness(here, ahead)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
