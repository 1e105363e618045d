"""Packing documents into sequences of a fixed length: first-fit decreasing with
a tournament tree of free capacities, in randomised groups of documents.

A document longer than a sequence fills whole sequences by itself; what is left
of each document is an item. Items of one random group are packed together, so a
group is bounded and groups are alike whatever the order of the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import cut, quoted, read
from cairn.llm.registry import query

__all__ = ["WordEncoder", "first_fit_decreasing", "pack", "tokenize"]

#: Documents of one group, on average.
GROUP_DOCS = 4000
#: Words of one generation of those whose ids a Python worker keeps; it keeps two.
CACHE_WORDS = 300_000
END_ID = 1


def byte_letters() -> dict[int, str]:
    """The visible characters that a byte-level vocabulary writes for the UTF-8
    bytes of each character up to U+024F."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of, n = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in of:
            of[b] = chr(256 + n)
            n += 1
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(0x250)}


LETTERS = byte_letters()


class WordEncoder:
    """Ids of texts by a tokenizer whose pre-tokens never hold white space: each
    word between blanks is encoded once and kept, as little-endian 32-bit ids.

    A new word of Latin letters, with a stop or comma behind it or not, is its
    own pre-token; its lower case is written in the vocabulary's byte letters and
    given to the tokenizer's model. All other words take the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        sample = "AÀz,"  # whether letters are lowered, kept together and parted from a comma, in byte letters
        pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(sample))]
        self.plain = pieces == ["aàz".translate(LETTERS), ","]

    def part(self, piece: str) -> bytes:
        x = self.parts.get(piece)
        if x is None:
            x = self.old_parts.get(piece) or np.array([k.id for k in self.tokenizer.model.tokenize(piece)], "<u4").tobytes()
            if len(piece) < 64:
                self.parts[piece] = x
        return x

    def word(self, w: str) -> bytes:
        t, known = self.tokenizer, self.old_words.get(w)
        if known is not None:
            self.words[w] = known
            return known
        body = w[:-1] if w[-1] in ",." else w
        if self.plain and body.isalpha() and max(body) < "\u0250" and "İ" not in body:
            ids = self.part(body.lower().translate(LETTERS))
            if len(body) < len(w):
                ids += self.part(w[-1])
            if len(w) < 64:
                self.words[w] = ids
            return ids
        if "<|" in w:
            ids = np.array(t.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            found = [self.part(piece) for piece, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(w))]
            ids = b"".join(found)
        if len(w) < 64:
            self.words[w] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if len(self.words) > CACHE_WORDS:
            self.words, self.old_words = {"": b""}, self.words
        if len(self.parts) > CACHE_WORDS:
            self.parts, self.old_parts = {}, self.parts
        get, word = self.words.get, self.word
        for c in "\t\n\r\x0b\x0c":
            if c in text:
                text = text.replace(c, " ")
        out = []
        for w in text.split(" "):
            x = get(w)
            out.append(word(w) if x is None else x)
        return b"".join(out)


ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


def tokenize(docs: DataFrame, tokenizer: str, length: int, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id, tokens (with the end id) and the CRC-32 of each run of ``length``
    ids, the last one shorter."""
    schema = T.StructType([docs.schema[doc_id], T.StructField("tokens", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType()))])
    end, size = np.array([end_id], "<u4").tobytes(), 4 * length

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            n, crcs = [], []
            for x in b.column(1).to_pylist():
                ids = enc.ids(x or "") + end
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i:i + size]) for i in range(0, len(ids), size)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(quoted(doc_id), quoted(text).cast("string")).mapInArrow(run, schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Inner nodes of the tournament tree hold the
    larger capacity below them, so the first bin with room is found in log n steps."""
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[i]), 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - tree[at]
        tree[at] -= size
        while at > 1:
            at //= 2
            top = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == top:
                break
            tree[at] = top
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, doc_id: str = "doc_id", text: str = "text", group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset.

    ``tokenizer`` is the path of a tokenizer file that splits at white space, on
    every machine. Null and empty texts are one end id. Rows that share a doc_id
    are packed each on its own; rows without one as well. Sequence ids are unique,
    not dense. An empty table gives no pieces.
    """
    tokens = cut(tokenize(docs, tokenizer, length, doc_id, text))
    groups = max(1, -(-tokens.count() // group_docs))
    schema = T.StructType([docs.schema[doc_id], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    names = schema.names

    def group(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row", kind="stable")
        tokens, ids, crcs = rows["tokens"].to_numpy(), rows[doc_id].to_numpy(), rows["crcs"].to_list()
        whole = tokens // length
        left = tokens - whole * length
        items = np.flatnonzero(left)
        bins, offsets = first_fit_decreasing(left[items], length)
        first = int(bins.max()) + 1 if len(items) else 0
        doc = np.concatenate([items, np.repeat(np.arange(len(rows)), whole)])
        part = np.concatenate([whole[items], np.concatenate([np.arange(w) for w in whole]) if whole.any() else np.zeros(0, np.int64)]).astype(np.int64)
        n = len(doc) - len(items)
        seq = np.concatenate([bins, first + np.arange(n)])
        return pd.DataFrame(dict(zip(names, (ids[doc], part * length, np.concatenate([left[items], np.full(n, length)]), [crcs[d][p] for d, p in zip(doc, part)],
                                             tokens[doc], (int(key[0]) << 32) + seq, np.concatenate([offsets, np.zeros(n, np.int64)])))), columns=names)

    dealt = tokens.withColumn("_row", F.monotonically_increasing_id()).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(group, schema)


@query("op5_packing_first_fit")
def op5(spark, sf_dir):
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
