"""The whole linkage: block, featurize, score, post-process, assemble, validate.

Every stage is a table under one folder and is read back if it is there, so a run that broke off
goes on where it was, and scoring again reads the features instead of making them.

    python -m linkweave.plans.linkage train --s1 s1.tsv --pool s2.tsv s3.tsv --truth gt.tsv --out model
    python -m linkweave.plans.linkage link --s1 s1.tsv --pool s2.tsv s3.tsv --model model --out run
    python -m linkweave.plans.linkage rescore --run run --model other --threshold 0.9 --out run2
    python -m linkweave.plans.linkage validate --matches m.tsv --candidates c.tsv --s1 s1.tsv --pool s2.tsv s3.tsv
"""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sampling
from ..operators import blocking as B
from ..operators import features as FT
from ..operators import labels, metrics, model, postproc, validate
from ..sources import entities as E
from ..sources import results as R
from ..sources import stages


@dataclass(frozen=True)
class Config:
    """Settings of a run; each can come from the environment as LINK_<NAME>."""

    budget: int = 100
    max_pair: int = 200
    by_country: bool = True
    postprocess: str = "country"
    threshold: float | None = None
    rounds: int = 60
    seed: int = 0
    expected_s1: int | None = None

    @staticmethod
    def from_env(**given) -> Config:
        def read(name, default):
            raw = os.environ.get(f"LINK_{name.upper()}")
            if raw is None:
                return default
            if isinstance(default, bool):
                return raw.lower() in ("1", "true", "yes")
            kind = {"budget": int, "max_pair": int, "rounds": int, "seed": int, "expected_s1": int, "threshold": float}.get(name, str)
            return kind(raw)

        base = Config()
        values = {k: read(k, getattr(base, k)) for k in base.__dataclass_fields__}
        return Config(**(values | {k: v for k, v in given.items() if v is not None}))

    def blocking(self) -> B.Blocking:
        return B.Blocking(budget=self.budget, max_pair=self.max_pair, by_country=self.by_country)


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The union of several sources."""
    return reduce(DataFrame.unionByName, [E.entities(E.read_tsv(spark, p)) for p in paths])


def _candidates(spark: SparkSession, s1: DataFrame, pool: DataFrame, out: str, b: B.Blocking) -> DataFrame:
    """Candidates by way of prepared tables, so that texts are taken apart once."""
    query, rest = (stages.stage(spark, f"{out}/prepared_{k}", lambda e=e: B.prepare(e).select(*B.PREPARED)) for k, e in (("s1", s1), ("pool", pool)))
    return stages.stage(spark, f"{out}/candidates", lambda: B.candidates_of(query, rest, b))


def train(spark: SparkSession, s1: DataFrame, pool: DataFrame, truth: DataFrame, out: str, c: Config, arms: tuple[str, ...] = tuple(model.ARMS)) -> model.Spec:
    """Fit the arms, choose the one whose best threshold has the best macro F0.5 on the validation
    entities, and write it with its spec. Training candidates are not bound to a country."""
    pairs = _candidates(spark, s1, pool, out, B.Blocking(budget=c.budget, max_pair=c.max_pair))
    made = stages.stage(spark, f"{out}/features", lambda: FT.featurize(labels.label(pairs, truth), s1, pool))
    rows = labels.class_weight(sampling.split(made, "s1_id", 0.8, c.seed)).cache()
    spine = sampling.split(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", 0.8, c.seed).where("not is_train")
    held = truth.join(spine, "s1_id", "left_semi")
    best = None
    for arm in arms:
        kinds, feats = model.ARMS[arm]
        fitted = [(model.fit(rows, kind, feats, c.rounds, c.seed), w) for kind, w in kinds]
        scored = model.score(rows.where("not is_train"), fitted).select("s1_id", "cand_id", "score")
        per = metrics.per_entity(scored, held, spine, metrics.thresholds(160, 199, 1, 200))
        top = metrics.best(metrics.sweep(per)).first()
        if best is None or top.macro_all > best[0]:
            best = (top.macro_all, top.thr, arm, fitted, kinds, feats)
    macro, threshold, arm, fitted, kinds, feats = best
    parts = []
    for i, ((kind, w), (m, _)) in enumerate(zip(kinds, fitted, strict=True)):
        path = f"{out}/model{i}"
        m.write().overwrite().save(path)
        parts.append(model.Part(kind, path, w))
    spec = model.Spec(feats, tuple(parts), threshold, arm, macro)
    stages.write_json(spark, spec.as_dict(), f"{out}/spec.json")
    rows.unpersist()
    return spec


def _scored(spark: SparkSession, made: DataFrame, spec: model.Spec) -> DataFrame:
    fitted = [(PipelineModel.load(p.path), p.weight) for p in spec.models]
    return model.score(made, fitted).select("s1_id", "cand_id", "score")


def link(spark: SparkSession, s1: DataFrame, pool: DataFrame, spec: model.Spec, out: str, c: Config) -> DataFrame:
    """Candidates, features, scores and result lists under out; returns the lists."""
    E.check_rows(s1, c.expected_s1)
    pairs = _candidates(spark, s1, pool, out, c.blocking())
    made = stages.stage(spark, f"{out}/features", lambda: FT.featurize(pairs, s1, pool))
    return finish(spark, made, pairs, s1, pool, spec, out, c)


def finish(spark: SparkSession, made: DataFrame, pairs: DataFrame, s1: DataFrame, pool: DataFrame, spec: model.Spec, out: str, c: Config) -> DataFrame:
    threshold = spec.threshold if c.threshold is None else c.threshold
    emitted = stages.stage(spark, f"{out}/emitted", lambda: postproc.emit(_scored(spark, made, spec), threshold))
    kept = postproc.POSTPROCESS[c.postprocess](emitted, s1, pool)
    lists = R.assemble(s1, kept)
    R.write_lists(lists, f"{out}/{R.MATCHES[1]}")
    R.write_lists(R.assemble(s1, pairs, R.CANDIDATES), f"{out}/{R.CANDIDATES[1]}")
    return lists


def rescore(spark: SparkSession, run: str, s1: DataFrame, pool: DataFrame, spec: model.Spec, out: str, c: Config) -> DataFrame:
    """Score a run's features again, with another model or threshold, into another folder."""
    if os.path.normpath(run) == os.path.normpath(out):
        raise ValueError("a run is not rescored into its own folder")
    for part in ("candidates", "features"):
        if not stages.exists(spark, f"{run}/{part}"):
            raise ValueError(f"{run}/{part} is not whole")
    return finish(spark, spark.read.parquet(f"{run}/features"), spark.read.parquet(f"{run}/candidates"), s1, pool, spec, out, c)


def check_files(spark: SparkSession, matches: str, candidates: str | None, s1: DataFrame | None, pool: DataFrame | None) -> DataFrame:
    """Findings on result files: their headers, lines, ids, and that matches were candidates. Of a file
    that is missing, empty or has another header nothing else is looked at."""
    findings, pairs = [], []
    for path, names in ((matches, R.MATCHES), (candidates, R.CANDIDATES)):
        if path is None:
            continue
        try:
            lines = R.read_lines(spark, path, names)
            first = spark.read.text(path).limit(1).collect()
            wrong = validate.header(first[0].value if first else None, names)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            wrong = [("missing_file", "error")]
        if wrong:
            findings.append(spark.createDataFrame([(r, sev, 1, [path]) for r, sev in wrong], "rule string, severity string, n long, examples array<string>"))
            continue
        body = lines.where("not is_header").select("key", "ids")
        need = None if s1 is None else s1.select(F.col("entity_id").alias("id"))
        known = None if pool is None else pool.select(F.col("entity_id").alias("id"))
        findings.append(validate.lists(body, known, need))
        pairs.append(R.explode_lists(body.where("ids is not null")))
    if len(pairs) == 2:
        findings.append(validate.subset(*pairs))
    return reduce(DataFrame.unionByName, findings)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Link query entities to a pool.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("train", "link", "rescore", "validate"):
        q = sub.add_parser(name)
        q.add_argument("--s1", required=name != "validate")
        q.add_argument("--pool", nargs="+", required=name != "validate")
        if name == "validate":
            q.add_argument("--matches", required=True)
            q.add_argument("--candidates")
            continue
        q.add_argument("--out", required=True)
        q.add_argument("--budget", type=int)
        if name == "train":
            q.add_argument("--truth", required=True)
            q.add_argument("--rounds", type=int)
            q.add_argument("--arms", nargs="+", default=list(model.ARMS))
        else:
            q.add_argument("--model", required=True)
            q.add_argument("--threshold", type=float)
            q.add_argument("--postprocess", choices=list(postproc.POSTPROCESS))
        if name == "rescore":
            q.add_argument("--run", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("linkage").getOrCreate()
    c = Config.from_env(**{k: getattr(a, k, None) for k in ("budget", "rounds", "threshold", "postprocess")})
    s1 = load(spark, [a.s1]) if a.s1 else None
    pool = load(spark, a.pool) if a.pool else None
    if a.command == "validate":
        found = check_files(spark, a.matches, a.candidates, s1, pool)
        for r in found.collect():
            print(f"{r.severity}: {r.rule}: {r.n}, such as {', '.join(r.examples)}")
        return 0 if validate.passed(found) else 1
    if a.command == "train":
        spec = train(spark, s1, pool, R.explode_lists(E.read_tsv(spark, a.truth)), a.out, c, tuple(a.arms))
        print(f"arm {spec.arm}, macro {spec.val_macro:.4f} at {spec.threshold}")
        return 0
    spec = model.Spec.of(stages.read_json(spark, f"{a.model}/spec.json"))
    if a.command == "link":
        link(spark, s1, pool, spec, a.out, c)
    else:
        rescore(spark, a.run, s1, pool, spec, a.out, c)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
