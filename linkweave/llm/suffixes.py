"""Suffix-array dedup of bytes: a distributed suffix sort by difference cover.

Two equal strings of `length` bytes hold the same minimizer, the k-gram of least hash in them. A
run is the consecutive strings of a document that share their minimizer's place, so only runs of
equal minimizers can hold equal strings, and runs are dealt out by them. That splits one suffix
sort of the corpus into many small ones that miss no match:

1. Runs whose minimizer stands in one document only drop out.
2. Equal runs get equal names, XXH3 hashes of their bytes under their minimizer; all but the least document's hold strings that repeat, and a run
   that is alone in its minimizer's runs, or whose minimizer has one name, needs no more.
3. The other named runs are gathered by minimizer and their suffixes sorted with the difference
   cover {1, 2} modulo 3: sampled suffixes by triples of words, then by triples of the names
   found, until names span the length; the suffixes in between by a byte and the rank behind it,
   and merged. Neighbours in that order that agree on `length` bytes are one class, and its least
   document decides.

A minimizer with very many names, or very long runs, would be a large sort; their strings are named
one by one instead, as runs are in step 2, by 128 bits. Names stand for bytes that are not compared: with
64 bits each under one minimizer, n different runs of it hold two equal names with a probability of
about n * n / 2**65.

Documents are kept in blocks, in a table bucketed by block. A block asks the holders of its
minimizers with packed arrays in which every key comes once, and gets back a few bits for each
key, so text is shuffled once, into that table, and hot keys cost a holder one entry per block.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, freeing_shuffles, give_back, materialize, texts

_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_BYTES = np.random.default_rng(_BASE & 0xFFFF).integers(0, 1 << 64, 256, np.uint64)
_POWERS: list[np.ndarray] = []
_SETTLED, _OPEN = 1, 2


@dataclass(frozen=True)
class Settings:
    """block_bytes: text of a block, which is at least a document. bucket_bytes: what a holder is asked.
    sort_bytes: text that it sorts at once. names: of one minimizer, beyond which its strings are
    named one by one."""

    length: int = 50
    gram: int = 24
    block_bytes: int = 384 << 10
    bucket_bytes: int = 4 << 20
    sort_bytes: int = 256 << 10
    names: int = 1 << 14


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse; a worker keeps those of the largest block so far."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, np.uint64(b), np.uint64)
            p[:1] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def gram_hashes(a: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram of some bytes: polynomials modulo 2**64, mixed. They only pick minimizers
    and bring equal ones together; where two grams share a hash, names tell their runs apart."""
    n = len(a)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[a] * up[:n], out=sums[1:])
    return _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


# ---------------------------------------------------------------- blocks


class Block:
    """Texts in one buffer, cut into runs: strings first..last (by start) whose minimizer is at place."""

    def __init__(self, ids: pa.Array, ends: np.ndarray, text: bytes, s: Settings):
        self.s, self.text, self.ends = s, text, ends
        self.has_id = ~np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.bytes = np.frombuffer(text, np.uint8)
        lens = np.diff(np.concatenate([[0], ends]))
        n, w = len(text), s.length - s.gram + 1
        none = np.zeros(0, np.int64)
        self.first = self.last = self.place = self.doc = none
        self.key = none.astype(np.uint64)
        if n < s.length:
            return
        grams = gram_hashes(self.bytes, s.gram)
        # the least hash and, among equals, the first place, in one number
        packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        place = (_sliding_min(packed, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        of = np.repeat(np.arange(len(ends), dtype=np.int32), lens)
        inside = (of[: n - s.length + 1] == of[s.length - 1 :]) & self.has_id[of[: n - s.length + 1]]
        change = np.ones(len(place), bool)
        change[1:] = (place[1:] != place[:-1]) | ~inside[:-1] | (of[1 : len(place)] != of[: len(place) - 1])
        first = np.flatnonzero(change & inside)
        stop = np.flatnonzero(np.concatenate([change[1:] | ~inside[1:], [True]]) & inside)
        self.first, self.last, self.place = first, stop, place[first]
        # a minimizer's hash is a low one; mixed again, keys are even over the buckets
        self.doc, self.key = of[first], _mix(grams[self.place])

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, each run's number among them, and whether a key is in two documents here."""
        keys, inverse = np.unique(self.key, return_inverse=True)
        low = np.full(len(keys), np.iinfo(np.int64).max)
        high = np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, self.ids[self.doc])
        np.maximum.at(high, inverse, self.ids[self.doc])
        return keys, inverse, low < high

    def names(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For some runs: distinct (key, name) pairs, the least id of each, each run's number
        among them, and the first run that has the least id."""
        first, end, place = self.first[runs], self.last[runs] + self.s.length, self.place[runs]
        digest, text = xxhash.xxh3_64_digest, self.text
        name = np.frombuffer(b"".join([digest(text[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)]), ">u8").astype(np.uint64)
        name = _mix(name + (place - first).astype(np.uint64) * np.uint64(_OTHER))
        return _least(self.key[runs], name, self.ids[self.doc[runs]])


def _least(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (a, b) in order, as a two-column array; the least id of each; each row's pair;
    and the first row that has its pair's least id."""
    order = np.lexsort((ids, b, a))
    x, y = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    return np.column_stack([x[new], y[new]]).reshape(-1, 2), ids[order[new]], pair, order[new]


def _make_blocks(s: Settings) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, found, size = TaskContext.get().partitionId() << 32, [], [], 0

        def block() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in found])
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([b"".join(found)], pa.binary())], ["block", "ids", "ends", "text"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids.append(doc_id)
                found.append(text or b"")
                size += len(found[-1])
                if size >= s.block_bytes or len(ids) >= 1 << 16:
                    yield block()
                    number, ids, found, size = number + 1, [], [], 0
        if ids:
            yield block()

    return run


# ---------------------------------------------------------------- asking and answering


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    """Bucket numbers, ascending with the key."""
    return ((key >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def _parts(key: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Buckets of ascending keys, with their slices."""
    of = _bucket(key, n)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if a < b:
            yield int(of[a]), slice(a, b)


_ASK = "block long, kind int, bucket int, blob binary"


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["block", "kind", "bucket", "blob"])


def _round(blocks: DataFrame, answers: list[DataFrame], ask: Callable[[Block, dict], list[tuple[int, int, bytes]]], answer: Callable[[int, list[bytes]], list[bytes]], s: Settings, name: str) -> DataFrame:
    """Each block asks buckets (kind, bucket, blob) and gets one blob back from each it asked.

    answer: takes a kind and all blocks' blobs of one bucket; gives each its answer.
    """

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, got in _blocks(batches, s):
            yield _rows([(number, *row) for row in ask(block, got)])
        give_back()

    def answered(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        replies = answer(group["kind"][0].as_py(), group["blob"].to_pylist())
        return group.set_column(3, "blob", pa.array(replies, pa.binary()))

    asks = _with_answers(blocks, answers).mapInArrow(asked, _ASK)
    return materialize(asks.groupBy("kind", "bucket").applyInArrow(answered, _ASK), name)


def _with_answers(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Blocks with their answers beside them. The blocks' table is bucketed, so only answers move."""
    if not answers:
        return blocks.select("*", F.lit(None).cast("array<struct<kind:int,bucket:int,blob:binary>>").alias("answers"))
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    own = every.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "blob")).alias("answers"))
    return blocks.join(own.hint("shuffle_hash"), "block", "left").select("block", "ids", "ends", "text", "answers")


def _blocks(batches: Iterable[pa.RecordBatch], s: Settings) -> Iterator[tuple[int, Block, dict[int, dict[int, bytes]]]]:
    for batch in batches:
        for k in range(batch.num_rows):
            number, ids, ends, text, answers = (batch.column(i)[k] for i in range(5))
            got: dict[int, dict[int, bytes]] = {}
            for row in answers.as_py() or []:
                got.setdefault(row["kind"], {})[row["bucket"]] = row["blob"]
            yield number.as_py(), Block(ids.values, ends.values.to_numpy(), text.as_py(), s), got


def _read(key: np.ndarray, replies: dict[int, bytes], n: int, kind: type, packed: bool = False) -> np.ndarray:
    """Answers to ascending keys, put together from the buckets' blobs."""
    out = np.zeros(len(key), kind)
    for bucket, part in _parts(key, n):
        raw = np.frombuffer(replies[bucket], np.uint8 if packed else kind)
        out[part] = np.unpackbits(raw, count=part.stop - part.start) if packed else raw
    return out


# kinds of questions
_SHARED, _NAMED, _SORTED, _SINGLE = range(4)


def _ask_shared(n: int) -> Callable[[Block, dict], list[tuple[int, int, bytes]]]:
    def ask(block: Block, _: dict) -> list[tuple[int, int, bytes]]:
        keys, _, twice = block.keys()
        out = []
        for bucket, part in _parts(keys, n):
            low = keys[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]  # the bucket holds the high bits
            count = part.stop - part.start
            out.append((_SHARED, bucket, count.to_bytes(4, "little") + low.tobytes() + np.packbits(twice[part]).tobytes()))
        return out

    return ask


def _answer_shared(blobs: list[bytes]) -> list[bytes]:
    """One bit per key: whether it stands in two documents."""
    keys, twice = [], []
    for b in blobs:
        n = int.from_bytes(b[:4], "little")
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = np.frombuffer(b, np.uint8, 6 * n, 4).reshape(-1, 6)
        keys.append(wide.view("<u8").reshape(-1))
        twice.append(np.unpackbits(np.frombuffer(b, np.uint8, offset=4 + 6 * n), count=n).astype(bool))
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    shared = np.concatenate(twice)
    # of equal keys all are marked: runs of equal ones, or ones marked by their own block
    group = np.concatenate([[0], np.cumsum(~same)])
    marked = np.zeros(group[-1] + 1, bool)
    np.logical_or.at(marked, group, shared[order])
    marked[group[1:][same]] = True
    bits = np.empty(len(every), bool)
    bits[order] = marked[group]
    edges = np.cumsum([0] + [len(k) for k in keys])
    return [np.packbits(bits[a:b]).tobytes() for a, b in zip(edges, edges[1:], strict=False)]


def _met(block: Block, got: dict, n: int) -> np.ndarray:
    """The runs whose key stands in two documents."""
    keys, inverse, _ = block.keys()
    return np.flatnonzero(_read(keys, got.get(_SHARED, {}), n, bool, True)[inverse]) if len(keys) else np.zeros(0, np.int64)


def _pairs_blob(pairs: np.ndarray, ids: np.ndarray) -> bytes:
    return pairs.astype("<u8").T.tobytes() + ids.astype("<i8").tobytes()


def _answer_named(blobs: list[bytes], most: int) -> list[bytes]:
    """For each (key, name, id): settled if the name has a smaller id; open if not and the key has
    other names; with a third bit where it has more than `most` names."""
    parts = [np.frombuffer(b, "<u8").reshape(3, -1) for b in blobs]
    key, name, ids = np.concatenate(parts, axis=1)
    ids = ids.view(np.int64)
    pairs, least, pair, _ = _least(key, name, ids)
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] != pairs[:-1, 0]
    group = np.cumsum(new) - 1
    count = np.bincount(group)[group]
    state = np.where(count > 1, _OPEN, 0) | np.where(count > most, 4, 0)
    out = np.where(least[pair] < ids, _SETTLED, state[pair]).astype(np.uint8)
    edges = np.cumsum([0] + [p.shape[1] for p in parts])
    return [out[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]


def _ask_named(n: int) -> Callable[[Block, dict], list[tuple[int, int, bytes]]]:
    def ask(block: Block, got: dict) -> list[tuple[int, int, bytes]]:
        pairs, least, _, _ = block.names(_met(block, got, n))
        return [(_NAMED, bucket, _pairs_blob(pairs[part], least[part])) for bucket, part in _parts(pairs[:, 0], n)]

    return ask


class _Named:
    """What the answers so far say of a block's runs."""

    def __init__(self, block: Block, got: dict, n: int):
        self.runs = _met(block, got, n)
        pairs, least, pair, head = block.names(self.runs)
        state = _read(pairs[:, 0], got.get(_NAMED, {}), n, np.uint8) if len(pairs) else np.zeros(0, np.uint8)
        ids = block.ids[block.doc[self.runs]]
        self.settled = self.runs[(ids > least[pair]) | (state[pair] == _SETTLED)]
        # one run stands for each open name of this block; its other runs of that name and id repeat it
        open_names = np.flatnonzero(state & _OPEN)
        hot = state[open_names] & 4 > 0
        self.sort_pairs, self.hot_pairs = open_names[~hot], open_names[hot]
        self.head, self.pair, self.key = self.runs[head], pair, pairs[:, 0]
        self.same = {True: np.isin(pair, self.hot_pairs), False: np.isin(pair, self.sort_pairs)}


def _ask_sorted(n: int) -> Callable[[Block, dict], list[tuple[int, int, bytes]]]:
    """Send the open runs' bytes to be sorted, and the strings of too frequent keys to be named."""

    def ask(block: Block, got: dict) -> list[tuple[int, int, bytes]]:
        named = _Named(block, got, n)
        out = []
        heads = named.head[named.sort_pairs]
        for bucket, part in _parts(named.key[named.sort_pairs], n):
            own = heads[part]
            first, end = block.first[own], block.last[own] + block.s.length
            strings = b"".join([block.text[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)])
            slot = (block.key[own] & np.uint64(0xFF)).astype(np.uint8)
            out.append((_SORTED, bucket, len(own).to_bytes(4, "little") + block.ids[block.doc[own]].astype("<i8").tobytes() + (end - first).astype("<u4").tobytes() + slot.tobytes() + strings))
        pairs, least, _, _ = _singles(block, named.head[named.hot_pairs])
        return out + [(_SINGLE, bucket, _pairs_blob(pairs[part], least[part])) for bucket, part in _parts(pairs[:, 0], n)]

    return ask


def _singles(block: Block, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 128-bit hashes of the runs' strings with their least ids, and each string's number."""
    counts = (block.last - block.first + 1)[runs]
    at = np.repeat(block.first[runs] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    if not len(at):
        none = np.zeros(0, np.int64)
        return np.zeros((0, 2), np.uint64), none, none, at
    digest, text, length = xxhash.xxh3_128_digest, block.text, block.s.length
    name = np.frombuffer(b"".join([digest(text[i : i + length]) for i in at.tolist()]), ">u8").astype(np.uint64).reshape(-1, 2)
    pairs, least, pair, _ = _least(name[:, 0], name[:, 1], np.repeat(block.ids[block.doc[runs]], counts))
    return pairs, least, pair, at


def _answer_sorted(blobs: list[bytes], s: Settings) -> list[bytes]:
    """A bit for each string of each run: whether a smaller id has it.

    Runs of one key have one slot, so a bucket is sorted slot by slot, in parts of about sort_bytes.
    """
    ids, lens, slots, strings, counts = [], [], [], [], []
    for b in blobs:
        n = int.from_bytes(b[:4], "little")
        ids.append(np.frombuffer(b, "<i8", n, 4))
        lens.append(np.frombuffer(b, "<u4", n, 4 + 8 * n).astype(np.int64))
        slots.append(np.frombuffer(b, np.uint8, n, 4 + 12 * n))
        strings.append(b[4 + 13 * n :])
        counts.append(n)
    owner, size, text = np.concatenate(ids), np.concatenate(lens), b"".join(strings)
    del strings
    order = np.argsort(np.concatenate(slots), kind="stable")
    ends = np.cumsum(size)
    starts = np.concatenate([[0], np.cumsum(size - s.length + 1)])
    again = np.zeros(int(starts[-1]), bool)
    total = np.cumsum(size[order])
    slot_ends = np.flatnonzero(np.diff(np.concatenate(slots)[order], append=256)) + 1
    at = 0
    while at < len(order):
        fits = slot_ends[(slot_ends > at) & (total[np.minimum(slot_ends, len(order)) - 1] - (total[at - 1] if at else 0) <= s.sort_bytes)]
        to = int(fits[-1]) if len(fits) else int(slot_ends[slot_ends > at][0])
        mine = order[at:to]
        part = b"".join([text[a:b] for a, b in zip((ends[mine] - size[mine]).tolist(), ends[mine].tolist(), strict=True)])
        found = repeated(part, size[mine], owner[mine], s.length)
        many = size[mine] - s.length + 1
        again[np.repeat(starts[mine] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))] = found
        at = to
    edges = np.cumsum([0] + counts)
    return [np.packbits(again[starts[a] : starts[b]]).tobytes() for a, b in zip(edges, edges[1:], strict=False)]


# ---------------------------------------------------------------- the suffix sort


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows, first column first."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _triple(names: np.ndarray, at: np.ndarray, step: int) -> list[np.ndarray]:
    a, b, c = names[at], names[at + step], names[at + 2 * step]
    if len(at) and max(a.max(), b.max(), c.max()) < 1 << 21:
        return [a << 42 | b << 21 | c]
    return [a, b, c]


def suffix_order(text: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """starts, ordered by the suffixes there so that those with equal first `length` bytes are side by side.

    Sampled suffixes (start modulo 3 is 1 or 2) are named by a triple of words, eight, eight and four
    bytes, and then by triples of names until a name spans the length. The others are ordered by
    their first byte and the rank of the sampled suffix behind it. To merge the two, a suffix is
    compared by a byte and the rank behind it, or by two bytes and the rank behind those, whichever
    makes both ranks sampled ones.
    """
    spans, steps = [20], []
    while spans[-1] < length:
        steps.append(spans[-1] // 3 * 3)
        spans.append(spans[-1] + 2 * steps[-1])
    buf = np.frombuffer(text + b"\0" * (sum(2 * x for x in steps) + 40), np.uint8)
    size = len(buf) - 24
    # where names are needed, from the last level down to the words
    kind = starts % 3
    behind = [starts[kind != 0], starts[kind == 0] + 1, starts[kind == 0] + 2, starts[kind == 1] + 1, starts[kind == 2] + 2]
    need = np.zeros(size, bool)
    need[np.concatenate(behind)] = True
    levels = [need]
    for step in reversed(steps):
        wider = levels[-1].copy()
        wider[step:] |= levels[-1][:-step]
        wider[2 * step :] |= levels[-1][: -2 * step]
        levels.append(wider)
    two = buf[:-1].astype(np.uint64) << np.uint64(8) | buf[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    at = np.flatnonzero(levels.pop())
    rank = np.zeros(size, np.int64)
    rank[at] = _ranks([eight[at], eight[at + 8], four[at + 16]])
    for step in steps:
        at = np.flatnonzero(levels.pop())
        names, rank = rank, np.zeros(size, np.int64)
        rank[at] = _ranks(_triple(names, at, step))
    sampled, rest = starts[kind != 0], starts[kind == 0]
    sampled = sampled[np.argsort(rank[sampled], kind="stable")]
    rest = rest[np.lexsort((rank[rest + 1], buf[rest]))]
    # binary search of every rest suffix among the sampled ones
    one, after_one = buf[rest].astype(np.int64), rank[rest + 1]
    both, after_two = two[rest].astype(np.int64), rank[rest + 2]
    low, high = np.zeros(len(rest), np.int64), np.full(len(rest), len(sampled))
    while len(sampled) and (low < high).any():
        mid = np.minimum((low + high) >> 1, len(sampled) - 1)
        j = sampled[mid]
        by_one = j % 3 == 1
        head = np.where(by_one, buf[j], two[j].astype(np.int64))
        tail = np.where(by_one, rank[j + 1], rank[j + 2])
        own, own_tail = np.where(by_one, one, both), np.where(by_one, after_one, after_two)
        less = (head < own) | ((head == own) & (tail < own_tail))
        open_ = low < high
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return np.insert(sampled, low, rest)


def repeated(text: bytes, lens: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For every string of `length` bytes within the texts that lie one after the other in text,
    whether a text with a smaller id has it too."""
    begins = np.cumsum(lens) - lens
    counts = np.maximum(lens - length + 1, 0)
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    if not len(starts):
        return np.zeros(0, bool)
    order = suffix_order(text, starts, length)
    buf = np.frombuffer(text + b"\0" * 8, np.uint8)
    two = buf[:-1].astype(np.uint64) << np.uint64(8) | buf[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    same = np.ones(len(order) - 1, bool)
    for k in [*range(0, length - 8, 8), length - 8] if length >= 8 else []:
        word = eight[order + k]
        same &= word[1:] == word[:-1]
    for k in range(length) if length < 8 else []:
        same &= buf[order[1:] + k] == buf[order[:-1] + k]
    own = np.repeat(ids, counts)
    nth = np.searchsorted(starts, order)
    mine = own[nth]
    heads = np.concatenate([[0], np.flatnonzero(~same) + 1])
    least = np.minimum.reduceat(mine, heads)
    again = np.empty(len(order), bool)
    again[nth] = mine > np.repeat(least, np.diff(np.concatenate([heads, [len(order)]])))
    return again


# ---------------------------------------------------------------- results


def _removed(block: Block, got: dict, n: int) -> np.ndarray:
    """Which bytes of a block go."""
    size, length = len(block.text), block.s.length
    marks = np.zeros(size + 1, np.int64)
    named = _Named(block, got, n)
    np.add.at(marks, block.first[named.settled], 1)
    np.add.at(marks, block.last[named.settled] + length, -1)
    gone = []
    # the answers are to one run of each name; others of that name and id have the same
    for hot, pairs in ((False, named.sort_pairs), (True, named.hot_pairs)):
        if not len(pairs):
            continue
        heads = named.head[pairs]
        counts = (block.last - block.first + 1)[heads]
        if hot:
            found, _, pair, _ = _singles(block, heads)
            # of equal strings here, those with a larger id are told by the least id
            state = _read(found[:, 0], got[_SINGLE], n, np.uint8)
            _, least, _, _ = _singles(block, heads)
            again = (state[pair] == _SETTLED) | (np.repeat(block.ids[block.doc[heads]], counts) > least[pair])
        else:
            again = np.zeros(int(counts.sum()), bool)
            offset = np.concatenate([[0], np.cumsum(counts)])
            for bucket, part in _parts(named.key[pairs], n):
                a, b = int(offset[part.start]), int(offset[part.stop])
                again[a:b] = np.unpackbits(np.frombuffer(got[_SORTED][bucket], np.uint8), count=b - a)
        offset = np.concatenate([[0], np.cumsum(counts)])
        place = np.full(int(named.pair.max()) + 1, -1)
        place[pairs] = np.arange(len(pairs))
        which = np.flatnonzero(named.same[hot])
        runs, slot = named.runs[which], place[named.pair[which]]
        some = block.ids[block.doc[runs]] == block.ids[block.doc[heads[slot]]]
        runs, slot = runs[some], slot[some]
        many = counts[slot]
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        hit = again[np.repeat(offset[slot], many) + at]
        gone.append((np.repeat(block.first[runs], many) + at)[hit])
    for at in gone:
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
    return np.cumsum(marks)[:size] > 0


def removals(docs: DataFrame, s: Settings = Settings(), keep_text: bool = False) -> DataFrame:
    """Remove repeated strings' bytes: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept
    bytes (binary, as they need not be whole characters) if asked for.

    A byte goes if a string of s.length bytes that covers it also starts in a document with a
    smaller id. Strings never cross documents. Null text counts as empty. Rows that repeat an id
    count as one document. A row without an id loses nothing and takes nothing. No rows: no rows.
    Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_make_blocks(s), "block long, ids array<long>, ends array<long>, text binary")
    # with as many buckets as shuffles have partitions, Spark deals answers out by bucket; blocks are
    # dealt out before, so that a bucket is a file
    n_files = min(100_000, max(2 * docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    table = f"linkweave_blocks_{uuid.uuid4().hex}"
    known: list[DataFrame] = []
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    try:
        with freeing_shuffles(spark):
            made.repartition(n_files, "block").write.bucketBy(n_files, "block").saveAsTable(table)
        blocks = spark.table(table)
        text_bytes = blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # a bucket's questions take about half of the text's bytes; as many buckets as tasks, at least
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // (2 * s.bucket_bytes)))

        known.append(_round(blocks, known, _ask_shared(n), lambda kind, b: _answer_shared(b), s, "shared"))
        known.append(_round(blocks, known, _ask_named(n), lambda kind, b: _answer_named(b, s.names), s, "named"))
        known.append(_round(blocks, known, _ask_sorted(n), lambda kind, b: _answer_sorted(b, s) if kind == _SORTED else _answer_named(b, s.names), s, "sorted"))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    ids = one.column(1)[0].values
                    for _, block, got in _blocks([one], s):
                        gone = _removed(block, got, n) if len(block.first) else np.zeros(len(block.text), bool)
                        yield _result(ids, block, gone, keep_text)

        return materialize(_with_answers(blocks, known).mapInArrow(run, schema), "removals")
    finally:
        for answers in known:
            forget(answers)
        spark.sql(f"drop table if exists {table}")


def _result(ids: pa.Array, block: Block, gone: np.ndarray, keep_text: bool) -> pa.RecordBatch:
    rows, at = [], 0
    for end in block.ends.tolist():
        cut = gone[at:end]
        text = block.text[at:end]
        kept = text
        spans = removed = 0
        if cut.any():
            kept = block.bytes[at:end][~cut].tobytes()
            removed = int(cut.sum())
            spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())
        rows.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        at = end
    columns = list(zip(*rows, strict=True))
    arrays = [ids, *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3]), pa.array(columns[4], pa.binary())]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    return pa.RecordBatch.from_arrays(arrays if keep_text else arrays[:5], names if keep_text else names[:5])
