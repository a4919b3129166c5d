"""Quality classifier: a sparse ensemble of rules, compiled into Spark column expressions.

Small regression trees are grown on bootstrap samples of text statistics. Every path from a root
to a node is a conjunctive rule. An L1-penalised logistic regression (accelerated proximal
gradient) weighs the rules; those left with a weight become one Spark expression, so scoring is
JVM code over the whole table and only statistics of a bounded sample reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    """per_class bounds the expected number of labelled rows of each class in the training sample."""

    per_class: int = 3000
    trees: int = 40
    depth: int = 3
    cuts: int = 24
    min_leaf: int = 8
    penalty: float = 0.002
    steps: int = 800
    seed: int = 11


#: (statistic, cut, True for above): a rule holds where all its conditions do
Rule = tuple[tuple[str, float, bool], ...]


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[Rule, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, all doubles and all finite; null counts as empty, and empty gives zeros."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, _SPACE), lambda w: w != "")
    n, n_words = F.length(t).cast("double"), F.size(words).cast("double")

    def per(x: Column, total: Column) -> Column:
        return F.when(total > 0, x.cast("double") / total).otherwise(0.0)

    # characters are counted by what is left without them; a list of matches would hold one string each
    def count(kind: str) -> Column:
        return F.length(t) - F.length(F.regexp_replace(t, f"{kind}+", ""))

    def count_of(char: str) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit(char), F.lit("")))

    def matches(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, "$0|")) - F.length(t)

    return {
        "chars": n,
        "letters": per(count(r"\p{L}"), n),
        "capitals": per(count(r"\p{Lu}"), n),
        "digits": per(count(r"\p{Nd}"), n),
        "symbols": per(count(r"[#$%&*@^~<>{}=+\\_]"), n),
        "bars": per(count_of("|"), n),
        "shouts": per(count(r"[!?]"), n),
        "stops": per(count(r"[.,;:]"), n),
        "lines": per(count_of("\n"), n),
        "word_length": per(n, n_words),
        "distinct": per(F.size(F.array_distinct(words)), n_words),
        "repeats": per(matches(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?=[\x20\x09-\x0D]\1(?![^\x20\x09-\x0D]))"), n_words),
    }


STATISTICS = ("chars", "letters", "capitals", "digits", "symbols", "bars", "shouts", "stops", "lines", "word_length", "distinct", "repeats")


def _grow(x: np.ndarray, y: np.ndarray, path: Rule, depth: int, s: Settings, rng: np.random.Generator, out: set[Rule]) -> None:
    """Add the rules of every node below, splitting by least squares on a random half of the statistics."""
    if path:
        out.add(tuple(sorted(path)))
    if depth == 0 or len(y) < 2 * s.min_leaf or y.min() == y.max():
        return
    best = None
    for k in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
        for cut in np.unique(np.quantile(x[:, k], np.linspace(0, 1, s.cuts + 2)[1:-1])):
            up = x[:, k] > cut
            m = int(up.sum())
            if s.min_leaf <= m <= len(y) - s.min_leaf:
                a, b = y[up].mean(), y[~up].mean()
                gain = m * (len(y) - m) * (a - b) ** 2
                if best is None or gain > best[0]:
                    best = (gain, k, float(cut), up)
    if best is None or best[0] <= 0:
        return
    _, k, cut, up = best
    for side, rows in ((True, up), (False, ~up)):
        _grow(x[rows], y[rows], (*path, (STATISTICS[k], cut, side)), depth - 1, s, rng, out)


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    got = np.ones(len(x), bool)
    for name, cut, above in rule:
        v = x[:, STATISTICS.index(name)]
        got &= v > cut if above else v <= cut
    return got


def _lasso(r: np.ndarray, y: np.ndarray, s: Settings, u: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic weights under an L1 penalty; the bias is free. u: the rows' weights, one on average."""
    n, m = r.shape
    z = np.hstack([np.ones((n, 1)), r])
    step = 4 * n / max(np.linalg.norm(z * np.sqrt(u)[:, None], 2) ** 2, 1e-9)
    w = np.zeros(m + 1)
    w[0] = math.log(((u * y).sum() + 1) / ((u * (1 - y)).sum() + 1))
    v, t = w.copy(), 1.0
    for _ in range(s.steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        new = v - step * (z.T @ (u * (p - y)) / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * s.penalty, 0)
        grown = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / grown * (new - w)
        w, t = new, grown
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings(), stands: tuple[float, float] = (1.0, 1.0)) -> Model:
    """x: rows of STATISTICS; y: 0 or 1; stands: for how many rows one of class 0 or 1 stands. One class only, or no row: a constant score near its share."""
    if len(y) == 0 or y.min() == y.max():
        return Model(math.log((float(np.sum(y)) + 1) / (len(y) - float(np.sum(y)) + 1)), ())
    order = np.lexsort((*x.T, y))  # whatever order the sample came in
    x, y = x[order], y[order].astype(float)
    u = np.where(y == 1, stands[1], stands[0])
    u = u / u.mean()
    rng, rules = np.random.default_rng(s.seed), set()
    half = [np.flatnonzero(y == c) for c in (0.0, 1.0)]
    for _ in range(s.trees):
        # as many of either class, so that the rarer one is split on too
        size = min(len(h) for h in half)
        rows = np.concatenate([rng.choice(h, max(size, s.min_leaf)) for h in half])
        _grow(x[rows], y[rows], (), s.depth, s, rng, rules)
    kept, columns, seen = [], [], set()
    for rule in sorted(rules, key=lambda q: (len(q), q)):
        held = _holds(rule, x)
        mark = held.tobytes()
        if 0 < held.sum() < len(y) and mark not in seen and (~held).tobytes() not in seen:
            seen.add(mark)
            kept.append(rule)
            columns.append(held)
    if not kept:
        return Model(math.log(((u * y).sum() + 1) / ((u * (1 - y)).sum() + 1)), ())
    bias, weights = _lasso(np.stack(columns, axis=1).astype(float), y, s, u)
    return Model(bias, tuple((rule, float(w)) for rule, w in zip(kept, weights, strict=True) if abs(w) > 1e-6))


def score_column(m: Model, stat: dict[str, Column]) -> Column:
    """The model as a column expression over columns of the statistics."""
    total = F.lit(m.bias)
    for rule, w in m.rules:
        holds = F.lit(True)
        for name, cut, above in rule:
            holds = holds & ((stat[name] > cut) if above else (stat[name] <= cut))
        total = total + F.when(holds, F.lit(w)).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-total))


def fold(folds: int = 4) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learn labels.quality from docs.text. Rows come from labels with quality 0 or 1, about
    s.per_class of each by a hash of the id, so the sample is bounded and repeatable; they weigh as
    many rows as they stand for, so scores keep the labels' natural ratio at every table size."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    unit = (F.xxhash64(F.lit(s.seed), "doc_id").bitwiseAND((1 << 52) - 1) / float(1 << 52)).cast("double")
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col("quality") == k, min(1.0, s.per_class / n)).otherwise(share)
    # at most about 2 * per_class rows, so this side may be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(known.where(unit < share)), "doc_id")
    rows = sample.select("quality", *[c.alias(k) for k, c in statistics(F.col("text")).items()]).toArrow()
    x = np.column_stack([rows[k].to_numpy() for k in STATISTICS]) if len(rows) else np.zeros((0, len(STATISTICS)))
    stands = tuple(max(1.0, counts.get(k, 0) / s.per_class) for k in (0, 1))
    return fit(x, rows["quality"].to_numpy(), s, stands)


def score(docs: DataFrame, m: Model, keep: tuple[str, ...] = ("doc_id",), at: float = 0.7) -> DataFrame:
    """The keep columns of docs, then score (0 to 1) and predicted (1 if score >= at).

    Null text scores as empty text, empty text by its all-zero statistics. Repeated rows each come
    back; no rows: no rows. Only text is read for the score.
    """
    held = docs.select(*keep, F.struct(*[c.alias(k) for k, c in statistics(F.col("text")).items()]).alias("__stat"))
    stat = {k: F.col("__stat").getField(k) for k in STATISTICS}
    scored = held.select(*keep, score_column(m, stat).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= at).cast("int"))
