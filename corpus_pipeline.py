"""A corpus pipeline of operators from linkweave.llm.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the
columns of documents, but for the last, which returns the pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import langid, mixing, packing, shingles, substring
from linkweave.llm.common import forget, give_back, materialize, settle, small_batches
from linkweave.llm.queries import vocabulary


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage with rows going to Python in batches of a few MB: all stages share the executors, whose
    memory has to hold what each of them leaves. The driver's Python, which learns the languages, gives
    back what it freed."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        out = stage(spark, docs, sf_dir)
        give_back()
        return out

    return run


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the documents' own labels outside the held-out fold; documents that
    the classifier rejects go: those without letters and those under its calibrated threshold. Where
    no row outside the fold has both a language and subwords there is nothing to learn from, and
    every document with a letter stays."""
    return langid.accepted(docs, langid.train(docs.where(~langid.held_out())))


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays; groups are joined by pairs whose five-word
    shingles have a Jaccard similarity of 0.8 or more. SimHash finds the nearest of them, each confirmed
    exactly; the rest, which its two bits leave, are found by shared shingles. Rows that
    repeat an id are rows like others: those of one group go with it, those of other groups stay.
    Rows with the least id count by their text's hash, the least one staying; of rows alike in both,
    the one that comes first as JSON. Rows without an id stay."""
    groups = shingles.groups(docs)
    first = groups.where("doc_id = head.doc_id and text_hash = head.text_hash")
    heads = settle(first.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.count("*").alias("n")), "heads", groups)
    rows = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    kept = rows.join(heads, ["id", "hash"])
    out = kept.where("n = 1").select("row.*").unionByName(docs.where("doc_id is null"))
    if not heads.where("n > 1").isEmpty():
        out = out.unionByName(kept.where("n > 1").groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
    return out


@in_small_batches
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that an earlier document has too go; every document stays."""
    return substring.dedup(docs)


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources go in tempered weights: each document is shown at least once, none of a source more
    than one and a half times on average."""
    return mixing.place(docs, mixing.Settings(repeats=1.5)).select("row.*")


@in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, vocabulary)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned weights, 64-bit hashes and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; a stage's table goes when
    the next one's is whole."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
            if before is not None:
                forget(before)
            before = docs
    return docs
