"""Packing: ids against the tokenizer, exact cover, bins, padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from linkweave.llm import packing


def path():
    return public_tokenizers.path("word_bpe_49k.json")


def plain_first_fit(lengths, capacity):
    room, out = [], []
    for n in lengths:
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(capacity)
        out.append((at, capacity - room[at]))
        room[at] -= n
    return out


def test_first_fit_matches_a_plain_scan():
    rnd = random.Random(3)
    for n in (0, 1, 2, 3, 50, 333):
        lengths = sorted((rnd.randrange(0, 101) for _ in range(n)), reverse=True)
        assert list(zip(*packing.first_fit_decreasing(lengths, 100))) == plain_first_fit(lengths, 100)


def check(rows, got, size=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path())
    want = defaultdict(int)
    for doc_id, text in rows:
        want[doc_id, tuple(t.encode(text or "", add_special_tokens=False).ids + [2])] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for (doc_id, ids), n in want.items():
        own = [r for r in by_doc[doc_id] if r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())]
        assert sum(r.length for r in own) == n * len(ids)
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return 1 - sum(r.length for r in got) / (size * len(by_seq))


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack_documents(docs, path, group_size=400).collect()
    assert check([(r.doc_id, r.text) for r in docs.collect()], got) < 0.02


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "It's <|endoftext|> <|startoftext|>x don't"), (5, "ΑΣ ΑΣ. ΣΑΣ’ étude café, naïve..."), (6, "a b c\x1cd\x85e 3½ 12,5"), (7, "word " * 9000), (8, "x" * 20000), (9, "İstanbul ßẞ ﬁ K 한국어 हिन्दी"), (4, "same"), (4, "same"), (None, "null id"), (10, "l'été qu'il they'll I'm 'S A'S.")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, length int, sequence_id int")
    got = packing.pack_documents(docs.repartition(3), path).collect()
    check(rows, got)
    assert packing.pack_documents(docs.limit(0), path).collect() == []


def test_composing_before_lower_case(spark):
    """Capitals that don't compose with the next mark, beside small letters that do."""
    rows = [(i, t) for i, t in enumerate(["J\u030c", "T\u0308", "H\u0331", "W\u030a", "Y\u030a", "xJ\u030cy a T\u0308. É", "ALL ascii, but Y\u030a!", "e\u0301 E\u0301... CAFE\u0301", "A <|endoftext|> J\u030c B.", "<|ENDOFTEXT|> <|x Y. z"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, packing.pack_documents(docs, path).collect())


def test_text_without_spaces_and_the_cache(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(1, "".join(rnd.choice("的一是不了人我在有他这中大来上国") for _ in range(1_700_000))), (2, "".join(rnd.choice("abcdefgh0123+/") for _ in range(300_000)))]
    rows += [(3 + i, " ".join("w%dx." % rnd.randrange(10**6) for _ in range(400))) for i in range(5)]
    monkeypatch.setattr(packing, "CACHE_BYTES", 50_000)
    words = packing._Words(path())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path())
    for _, text in rows:
        (got,) = words.of([text.encode()])
        assert got == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        held = sum(len(k) + len(v) + packing.ENTRY_BYTES for d in (words, words.older) for k, v in d.items())
        assert held <= 2 * (50_000 + 3000) and max(map(len, words), default=0) <= packing.LONG_WORD


def test_another_tokenizer_gets_whole_texts():
    words = packing._Words(public_tokenizers.path("byte_bpe_50k.json"))
    assert not words.by_words and packing._Words(path()).by_words
    text = "Two  words, É J\u030c\n"
    assert words.of([text.encode(), None]) == [np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), b""]
