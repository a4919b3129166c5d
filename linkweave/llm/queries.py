"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, langid, mixing, packing, rules, simhash, sketch, substring, suffixes, webp
from .common import documents


def vocabulary() -> str:
    """Place of the tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(documents(spark, sf_dir, "doc_id", "text"), vocabulary, end_id=2, size=4096)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with their roles repaired at minimum cost, rendered."""
    return chat.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 50-word windows that an earlier document has too."""
    return substring.digests(documents(spark, sf_dir, "doc_id", "text"), substring.Settings(window=50, period=31))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in the mixture each document is shown: every source up to one and a half times, all
    documents at least once."""
    got = mixing.place(documents(spark, sf_dir, "doc_id", "text", "source"), mixing.Settings(repeats=1.5), ("doc_id", "source"))
    return got.select("row.*", "epoch", "block", "tokens", "weight")


def op5_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as lossless WebP images, read back and described."""
    return webp.digests(documents(spark, sf_dir, "doc_id", "text"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the other folds' documents."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs, model, ("doc_id", "held_out"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    return simhash.groups(documents(spark, sf_dir, "doc_id", "text"), distance=2, blocks=4, pair_limit=64, words=3)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invertible sketches of all documents, beside an edited text and the next document."""
    return sketch.compared(documents(spark, sf_dir, "doc_id", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels of the other folds."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(rules.fold() != 2)
    model = rules.train(docs, labels)
    return rules.score(docs.withColumn("held_out", rules.fold() == 2), model, ("doc_id", "held_out"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 50-byte strings that an earlier document has too."""
    return suffixes.removals(documents(spark, sf_dir, "doc_id", "text"), suffixes.Settings(length=50))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_chat": op2_chat,
    "op3_substring": op3_substring,
    "op4_mixing": op4_mixing,
    "op5_webp": op5_webp,
    "op6_language": op6_language,
    "op7_simhash": op7_simhash,
    "op8_fingerprints": op8_fingerprints,
    "op9_quality": op9_quality,
    "op10_suffixes": op10_suffixes,
}

ORACLES: dict[str, str] = {
    "op3_substring": r"""
with split as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), placed as (
    select doc_id, words, unnest(range(1, len(words) + 1)) as i from split
), windows as (
    select doc_id, i, words[i] as word,
        case when i + 49 <= len(words) then array_to_string(words[i:i + 49], ' ') end as win
    from placed
), judged as (
    select doc_id, i, word, coalesce(win is not null and min(doc_id) over (partition by win) < doc_id, false) as again
    from windows
), covered as (
    select doc_id, i, word,
        max(again::int) over (partition by doc_id order by i rows between 49 preceding and current row) as gone
    from judged
), kept as (
    select doc_id, count(*) as n_words, sum(gone)::bigint as n_removed,
        coalesce(string_agg(word, ' ' order by i) filter (where gone = 0), '') as text
    from covered group by doc_id
)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed,
    sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join kept k on d.doc_id = k.doc_id
""",
    "op10_suffixes": r"""
with raw as (
    select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents
), placed as (
    select doc_id, n, h, unnest(range(1, n + 1)) as i from raw
), windows as (
    select doc_id, i, substr(h, 2 * i - 1, 2) as byte,
        case when i + 49 <= n then substr(h, 2 * i - 1, 100) end as win
    from placed
), judged as (
    select doc_id, i, byte, coalesce(win is not null and min(doc_id) over (partition by win) < doc_id, false) as again
    from windows
), covered as (
    select doc_id, i, byte,
        max(again::int) over (partition by doc_id order by i rows between 49 preceding and current row) as gone
    from judged
), edges as (
    select *, gone = 1 and coalesce(lag(gone) over (partition by doc_id order by i), 0) = 0 as opens from covered
), kept as (
    select doc_id, sum(gone)::bigint as n_removed, sum(opens::int)::bigint as n_spans,
        coalesce(string_agg(byte, '' order by i) filter (where gone = 0), '') as h
    from edges group by doc_id
)
select r.doc_id, r.n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
    sha256(unhex(coalesce(k.h, ''))) as kept_sha256
from raw r left join kept k on r.doc_id = k.doc_id
""",
}
