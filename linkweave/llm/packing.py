"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups.

Documents are tokenized once, where they are read; what goes on is a small row per piece. Pieces
are dealt at random to groups of a bounded expected size and each group is packed by itself, so
the work is linear in the corpus. Within a group a tournament tree over the bins' free room
finds the first bin that has space for a piece in logarithmic time.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterable
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, give_back, materialize, texts

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: size of each of the two generations of words that a worker keeps, what an entry takes besides its
#: bytes, and the length of a word beyond which it is not kept
CACHE_BYTES, ENTRY_BYTES, LONG_WORD = 48 << 20, 200, 256


def first_fit_decreasing(lengths: Iterable[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item. lengths: descending, each from 0 to capacity.

    The tree's leaves are the bins' free room and each inner node holds the greater of its two
    children, so the first bin with room is found by going left wherever the left child fits.
    """
    lengths = list(lengths)
    width = 1 << max(0, len(lengths) - 1).bit_length()
    tree = [capacity] * (2 * width)
    bins, offsets = [], []
    for need in lengths:
        node = 1
        while node < width:
            node *= 2
            if tree[node] < need:
                node += 1
        bins.append(node - width)
        offsets.append(capacity - tree[node])
        tree[node] -= need
        while node > 1:
            node //= 2
            a, b = tree[2 * node], tree[2 * node + 1]
            most = a if a > b else b
            if tree[node] == most:
                break
            tree[node] = most
    return bins, offsets


#: a run of ASCII marks but the apostrophe between an ASCII letter and white space
_TRAILING = re.compile(rb"([a-z])([!-&(-/:-@\[-`{-~]+)(?=[\x20\x09-\x0D]|$)")


def _by_words(tokenizer: Tokenizer) -> bool:
    """Whether the tokenizer composes, drops white space, lower-cases and takes letters and marks for
    different pieces, which is what the short ways of _Words rest on."""
    # by its parts: all of it as JSON has the vocabulary and its merges, tens of MB as Python's objects
    normalizer, splitter = (json.loads(part.__getstate__()) if part else {} for part in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    normal = [r["type"] for r in normalizer.get("normalizers", [])]
    pieces = splitter.get("pretokenizers", [])
    pattern = pieces[0].get("pattern", {}).get("Regex", "") if pieces else ""
    letters = pattern.split("|")[-3:] == [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]
    plain = all(t.content.startswith("<|") and not t.normalized for t in tokenizer.get_added_tokens_decoder().values())
    return normal == ["NFC", "Replace", "Lowercase"] and [r["type"] for r in pieces] == ["Split", "ByteLevel"] and letters and plain


class _Words(dict):
    """Token ids of white-space separated words, as little-endian unsigned 32-bit bytes; a word is
    tokenized when it is first asked for. A worker keeps one per tokenizer. When it is full it becomes
    the older generation, from which words that are asked for again come back; a long word is not kept.

    The tokenizer drops white space and lets no token cross it, so a text's ids are its words' ids in
    order. Words of ASCII alone, without what may be a special token, are lower-cased, and their
    trailing marks become words of their own. Any other word goes to the tokenizer as it stands: it
    composes before it lower-cases, which is not the same in the other order. A tokenizer with other
    rules gets whole texts.
    """

    kept: dict[str, _Words] = {}

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = _by_words(self.tokenizer)
        give_back()  # what reading the file took
        self.older: dict[bytes, bytes] = {}
        self.size = 0

    @classmethod
    def at(cls, path: str) -> _Words:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def _encoded(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            if word.isalpha() and word.islower():  # ASCII letters: one piece, as it is
                found = np.array([t.id for t in self.model.tokenize(word.decode())], "<u4").tobytes()
            elif word.isascii() and b"<|" not in word and (parts := _TRAILING.sub(rb"\1 \2", word.lower()).split()) != [word]:
                found = b"".join([self[p] for p in parts])
            else:
                found = self._encoded(word)
        if len(word) <= LONG_WORD:
            self.size += len(word) + len(found) + ENTRY_BYTES
            if self.size > CACHE_BYTES:
                self.older, self.size = dict(self), 0
                self.clear()
            self[word] = found
        return found

    def of(self, docs: list[bytes | None]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_words:
            return [self._encoded(t or b"") for t in docs]
        look, out = self.__getitem__, []
        for text in docs:
            text = text or b""
            if text.isascii() and b"<|" not in text:
                text = _TRAILING.sub(rb"\1 \2", text.lower())
            out.append(b"".join(map(look, text.split())))
        return out


def pieces(docs: DataFrame, tokenizer: Callable[[], str], end_id: int = 2, size: int = 4096) -> DataFrame:
    """Documents' ids, cut every `size` ids: doc_id, start, length, ids_crc32, doc_tokens.

    tokenizer: called on the executors, gives the vocabulary file's place there. Null text counts
    as empty: one piece that holds end_id alone.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        last, rows = np.array([end_id], "<u4").tobytes(), []
        found = _Words.at(tokenizer()).of(texts(batch.column(1)))
        for doc_id, ids in zip(batch.column(0).to_pylist(), found, strict=True):
            ids += last
            n = len(ids) // 4
            rows += [(doc_id, at, min(size, n - at), zlib.crc32(ids[4 * at : 4 * (at + size)]), n) for at in range(0, n, size)]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batched(run, 2 << 20), schema)


def pack(found: DataFrame, size: int = 4096, group_size: int = 8192, seed: int = 0) -> DataFrame:
    """Add sequence_id and offset to pieces: no sequence holds more than `size` ids, offsets are
    gapless from 0. found: a table read from storage, as it is read twice."""
    n_groups = max(1, -(-found.count() // group_size))
    # the position spreads repeated rows and ids over all groups
    dealt = found.withColumn("__group", F.pmod(F.xxhash64(F.lit(seed), "__row"), F.lit(n_groups)))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("__row", "ascending")])
        bins, offsets = first_fit_decreasing(group["length"].to_pylist(), size)
        first = group["__group"][0].as_py() << 32
        out = group.drop_columns(["__group", "__row"])
        return out.append_column("sequence_id", pa.array(np.array(bins, np.int64) + first)).append_column("offset", pa.array(offsets, pa.int64()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "__row")
    return dealt.groupBy("__group").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: Callable[[], str], end_id: int = 2, size: int = 4096, group_size: int = 8192, seed: int = 0) -> DataFrame:
    """Pack every document of docs: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts give the end id alone. Longer documents are cut every `size` ids. Repeated
    rows and null ids are packed row by row. No rows: no rows. Columns besides doc_id and text are
    not read.
    """
    found = pieces(docs, tokenizer, end_id, size).withColumn("__row", F.monotonically_increasing_id())
    return pack(materialize(found, "pieces"), size, group_size, seed)
