"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its byte n-grams within words, with word edges marked, hashed to a fixed
number of buckets. The text's vector is the mean of its buckets' embeddings; a linear softmax
reads the language from it. Embeddings and weights are learned by stochastic gradient descent in
numpy on a bounded sample. A part of that sample is kept apart to fit the softmax temperature
and the confidence under which a text is rejected.

As the mean is linear, embeddings times weights give one small table of bucket logits, whose size
depends on buckets and languages only; prediction is a mean of its rows over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched

UNKNOWN = "und"
#: a letter, as str.isalpha has it: marks, digits and numbers of any kind are none
LETTER = regex.compile(r"\p{L}")
_EDGE = 32


@dataclass(frozen=True)
class Settings:
    """per_language bounds the expected number of rows sampled of each language for training."""

    buckets: int = 1 << 15
    grams: tuple[int, ...] = (3, 4)
    dims: int = 16
    epochs: int = 12
    rate: float = 2.0
    per_language: int = 800
    holdout: float = 0.2
    reject_quantile: float = 0.001
    reject_at_most: float = 0.5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """labels: sorted languages. table: float32 logits by bucket and language."""

    labels: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    settings: Settings


def _byte_classes() -> np.ndarray:
    """Letters and bytes of longer code points stay; any other byte is a word edge."""
    keep = [b if b >= 128 or chr(b).isalpha() else _EDGE for b in range(256)]
    return np.array(keep, np.uint8)


_CLASS = _byte_classes()


def buckets(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of every text, in text order, and each text's subword count."""
    coded = [t.lower().encode() for t in texts]
    joined = _CLASS[np.frombuffer(b" " + b" ".join(coded) + b" ", np.uint8)]
    ends = np.cumsum([len(c) + 1 for c in coded])  # text i owns positions from the edge before it
    found, of = [], []
    edge = joined == _EDGE
    for n in s.grams:
        m = len(joined) - n + 1
        if m <= 0:
            continue
        key = np.zeros(m, np.uint32)
        for k in range(n):
            key = key * np.uint32(257) + joined[k : k + m] if n > 4 else (key << np.uint32(8)) | joined[k : k + m]
        inner = np.zeros(m, bool)
        for k in range(1, n - 1):
            inner |= edge[k : k + m]
        at = np.flatnonzero(~(inner | (edge[:m] & edge[1 : m + 1])))
        key = key[at]
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
        key += np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        key ^= key >> np.uint32(12)
        key *= np.uint32(0x297A2D39)
        found.append((key >> np.uint32(32 - int(s.buckets).bit_length() + 1)).astype(np.int32))
        of.append(np.searchsorted(at, np.concatenate([[0], ends])))
    counts = np.sum([np.diff(o) for o in of], axis=0) if of else np.zeros(len(texts), np.int64)
    out = np.empty(int(counts.sum()), np.int32)
    at = 0
    starts = np.concatenate([[0], np.cumsum(counts)])
    for i in range(len(texts)) if len(found) > 1 else ():
        at = starts[i]
        for f, o in zip(found, of, strict=True):
            step = o[i + 1] - o[i]
            out[at : at + step] = f[o[i] : o[i + 1]]
            at += step
    if len(found) == 1:
        out = found[0][of[0][0] : of[0][-1]]
    return out, counts


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], s: Settings) -> Model:
    """rows: (bucket ids, their shares, language) of each sampled text, in any order."""
    labels = tuple(sorted({r[2] for r in rows}))
    rng = np.random.default_rng(s.seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    y = np.array([labels.index(r[2]) for r in rows])
    apart = int(len(rows) * s.holdout) if len(rows) >= 10 else 0
    embed = rng.normal(0, 1 / s.dims, (s.buckets, s.dims)).astype(np.float32)
    weight = np.zeros((s.dims, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    order, total, done = np.arange(apart, len(rows)), s.epochs * max(1, len(rows) - apart), 0
    for _ in range(s.epochs):
        rng.shuffle(order)
        for i in order:
            ids, share, _ = rows[i]
            rate = s.rate * (1 - done / total)
            done += 1
            x = share @ embed[ids]
            p = _softmax(x @ weight + bias)
            p[y[i]] -= 1
            back = weight @ p
            weight -= rate * np.outer(x, p)
            bias -= 0.1 * rate * p
            embed[ids] -= rate * np.outer(share, back)
    table = embed @ weight
    temperature, threshold = 1.0, 0.0
    if apart:
        z = np.stack([rows[i][1] @ table[rows[i][0]] for i in range(apart)]) + bias
        grid = np.geomspace(0.5, 20, 75)  # not below: a few hundred rows without an error would ask for 0
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(apart), y[:apart]], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        best = _softmax(z / temperature).max(axis=1)
        threshold = float(min(s.reject_at_most, np.quantile(best, s.reject_quantile)))
    return Model(labels, table.astype(np.float32), bias, temperature, threshold, s)


def _key(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Rows that training never sees: crc32 of the id as text is divisible by folds."""
    return _key(doc_id) % folds == 0


def train(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from docs' text and lang: about s.per_language rows of each language, by a hash of the
    id, so the sample is bounded by the number of languages and repeatable. Texts become bucket
    shares on the executors; only those reach the driver. No usable row: a model without labels."""
    usable = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return Model((), np.zeros((s.buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0, s)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, s.per_language / n))])
    unit = (F.xxhash64(F.lit(s.seed), "doc_id").bitwiseAND((1 << 52) - 1) / float(1 << 52)).cast("double")
    sample = usable.where(unit < share[F.col("lang")])

    def shares(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, parts, langs = [], [], []
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            got, n = np.unique(buckets([text], s)[0], return_counts=True)
            if len(got):
                ids.append(got)
                parts.append((n / n.sum()).astype(np.float32))
                langs.append(lang)
        kinds = (pa.list_(pa.int32()), pa.list_(pa.float32()), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, parts, langs), kinds, strict=True)], ["ids", "shares", "lang"])

    got = sample.select("lang", "text").mapInArrow(batched(shares), "ids array<int>, shares array<float>, lang string").toArrow()
    rows = [(np.asarray(i.values), np.asarray(p.values), lang) for i, p, lang in zip(got["ids"], got["shares"], got["lang"].to_pylist(), strict=True)]
    rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))  # whatever order tasks end in
    if not rows:
        return Model((), np.zeros((s.buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0, s)
    return fit(rows, s)


def classify(texts: list[str | None], m: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, calibrated confidence and whether it is accepted, for each text."""
    real = [i for i, t in enumerate(texts) if t and LETTER.search(t) and m.labels]
    pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if real:
        ids, counts = buckets([texts[i] for i in real], m.settings)
        sums = np.zeros((len(real), len(m.labels)))
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            for k in range(len(m.labels)):
                sums[some, k] = np.add.reduceat(np.ascontiguousarray(m.table[:, k])[ids], starts, dtype=np.float64)
        p = _softmax((sums / np.maximum(counts, 1)[:, None] + m.bias) / m.temperature)
        for i, k, q in zip(real, p.argmax(axis=1), p.max(axis=1), strict=True):
            pred[i], score[i] = m.labels[k], q
    accepted = np.array([q != UNKNOWN for q in pred], bool) & (score >= m.threshold)
    return pred, score, accepted


def predict(docs: DataFrame, m: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """The keep columns of docs, then lang_pred, score (0 to 1) and accepted, or under other names.

    Null text, or text without a letter: `und`, 0, not accepted. Letters but no subword (one
    letter between edges counts as one): the bias decides. Repeated rows each come back; no rows:
    no rows. Only text is read for the prediction.
    """
    columns = list(dict.fromkeys([*keep, "text"]))
    place, kept = columns.index("text"), len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(m)  # buckets x languages, whatever the corpus

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pred, score, accepted = classify(batch.column(place).to_pylist(), shared.value)
        return pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(pred, pa.string()), pa.array(score), pa.array(accepted)], [*columns[:kept], *names])

    out = docs.select(*keep).schema
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        out = out.add(name, kind)
    return docs.select(*columns).mapInArrow(batched(run, 1 << 20), out)


def accepted(docs: DataFrame, m: Model) -> DataFrame:
    """The rows of docs whose text the model accepts, with all their columns, whatever their names.

    A model without labels knows no language to reject by: then every row whose text has a letter.
    """
    place = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.column(place).to_pylist()
        good = classify(found, shared.value)[2] if shared.value.labels else [bool(t and LETTER.search(t)) for t in found]
        return batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(batched(run, 1 << 20), docs.schema)
