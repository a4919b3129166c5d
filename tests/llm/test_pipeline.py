"""Every stage of the pipeline against brute force on its own input."""

import hashlib
import json
from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pytest
from linkweave.llm.langid import LETTER

from .test_packing import check
from .test_simhash import brute as simhash_groups
from .test_substring import brute as windows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(10**6, "12 34 --", "en", "src0", 8), (10**6 + 1, None, "en", "src0", 0), (10**6 + 2, docs.first().text, "fr", "src1", 5)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).cache()
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "mixing", "packing"]
    one, two, three, four, five = (s[1] for s in corpus_pipeline.STAGES)

    kept = one(spark, docs, sf).cache()
    assert kept.columns == COLUMNS
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if r.text and LETTER.search(r.text)}

    heads = two(spark, kept, sf).cache()
    assert heads.columns == COLUMNS
    want = {d for d, _, c in simhash_groups([(r.doc_id, r.text) for r in kept.collect()]) if d == c}
    assert {r.doc_id for r in heads.collect()} == want and len(want) < kept.count() and heads.count() == len(want)

    cut = three(spark, heads, sf).cache()
    assert cut.columns == COLUMNS
    got = {r.doc_id: hashlib.sha256(" ".join(r.text.encode().decode().split()).encode()).hexdigest() for r in cut.collect()}
    assert got == {d: sha for d, _, _, sha in windows([(r.doc_id, r.text) for r in heads.collect()])}

    mixed = four(spark, cut, sf).cache()
    assert mixed.columns == COLUMNS
    shown = Counter(r.doc_id for r in mixed.collect())
    assert set(shown) == set(got) and set(shown.values()) <= {1, 2}

    packed = five(spark, mixed, sf).collect()
    check([(r.doc_id, r.text) for r in mixed.collect()], packed)


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset"} <= set(got.columns) and got.count() > 100


def test_repeated_and_null_ids(spark):
    text = "some words that repeat in full here"
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (None, text, "en", "s", 5), (2, text, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "None"]


def test_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    names = ["total", "rows", "weight", "epochs", "blocks", "spans", "score", "accepted", "n", "key", "tokens", "fp", "least", "label", "component_id", "length", "ids", "owner"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)]).cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, ""), stage(spark, odd, "")
        assert got.columns == odd.columns
        assert sorted(map(tuple, got.select(*COLUMNS).collect())) == sorted(map(tuple, plain.collect()))
    assert corpus_pipeline.STAGES[-1][1](spark, odd, "").count() >= 60


def test_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []


def test_nulls_everywhere(spark):
    rows = [(None, None, None, None, None), (1, None, "en", None, None), (2, "some words here", None, "s", 15), (None, "other words there", "en", "s", None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == COLUMNS and got.collect() is not None
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 5


def test_languages_unknown(spark):
    """Without a label outside the held-out fold, documents with letters stay."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["some words here", "été", "12 34 --", None, "", "x"]
    unlabelled = [(i, t, None, "s", 5) for i, t in enumerate(texts)]
    fold = [r.id for r in spark.range(200).where(corpus_pipeline.langid.held_out("id")).collect()]
    in_fold = [(i, t, "en", "s", 5) for i, t in zip(fold, texts)]
    for rows in (unlabelled, in_fold):
        got = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, schema), "")
        assert got.columns == COLUMNS and sorted(r.text for r in got.collect()) == ["some words here", "x", "été"]


def test_unrelated_texts_under_one_id(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(20)) for c in "abc")
    rows = [(5, one, "en", "s", 1), (5, two, "en", "s", 1), (5, one, "de", "r", 1), (6, two, "en", "s", 1), (5, three, "en", "s", 1), (4, three, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for found in (docs, docs.orderBy("lang", "text"), docs.orderBy(docs.lang.desc(), docs.text.desc())):
        got = corpus_pipeline.drop_near_copies(spark, found, "")
        assert sorted(map(tuple, got.collect())) == [(4, three, "en", "s", 1), (5, one, "de", "r", 1), (5, two, "en", "s", 1)]


def test_near_copies_and_what_follows(spark):
    """The near-copy stage against all pairs by five-word Jaccard, the later stages on what it keeps."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    _, two, three, four, five = (s[1] for s in corpus_pipeline.STAGES)
    sets = {}
    for r in docs.collect():
        words = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    label = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    heads = two(spark, docs, sf).cache()
    assert sorted(r.doc_id for r in heads.collect()) == sorted(set(label.values())) and len(set(label.values())) < len(sets)

    cut = three(spark, heads, sf).cache()
    assert cut.columns == COLUMNS
    got = {r.doc_id: hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest() for r in cut.collect()}
    assert got == {d: sha for d, _, _, sha in windows([(r.doc_id, r.text) for r in heads.collect()])}
    mixed = four(spark, cut, sf).cache()
    shown = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == COLUMNS and set(shown) == set(got) and set(shown.values()) <= {1, 2}
    check([(r.doc_id, r.text) for r in mixed.collect()], five(spark, mixed, sf).collect())


def test_columns_named_like_helpers(spark):
    from pyspark.sql import functions as F

    names = ["__tokens", "__u", "__range", "__epoch", "__total", "__spans", "__doc_id", "__lang", "__score", "__accepted", "__hash", "__n", "__row", "row", "id", "hash", "rest", "name", "none", "__group", "__text"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    odd = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)]).cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, ""), stage(spark, odd, "")
        assert got.columns == odd.columns
        assert sorted(map(tuple, got.select(*COLUMNS).collect())) == sorted(map(tuple, plain.collect()))
        assert all(tuple(r)[5:] == tuple(range(len(names))) for r in got.collect())
    packed = corpus_pipeline.STAGES[-1][1]
    digest = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, packed(spark, odd, "").select(*digest).collect())) == sorted(map(tuple, packed(spark, docs, "").select(*digest).collect()))


def test_batches_to_python_are_small(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(i, "some words " * 2000, "en", "src0", 22000) for i in range(800)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs.limit(20), sf)
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 5_000_000


def test_tokenizer_rules_are_read_without_the_vocabulary(monkeypatch):
    from linkweave.llm import packing
    from linkweave.llm.queries import vocabulary

    read = json.loads
    monkeypatch.setattr(packing.json, "loads", lambda s: read(s) if len(s) < 10_000 else pytest.fail("the whole tokenizer as JSON"))
    assert packing._Words(vocabulary()).by_words
