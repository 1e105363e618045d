"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The
probability of a word is the sum over all ways to cut it into pieces, found by a
forward pass; that of a text is the product over its words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import append_columns, quoted, read
from cairn.llm.registry import query

__all__ = ["PieceModel", "fit", "predict"]

#: Training documents of a language, at most about: the model is fitted on a sample by a hash of the id.
SAMPLE_DOCS = 5000
#: Pieces added to each language's counts in all, shared out as in the languages together.
PRIOR_PIECES = 2000.0
#: Words whose probabilities a Python worker keeps, and the length from which words are done one by one.
CACHE_WORDS, LONG = 200_000, 48
MARK = "▁"
#: Where rescaling puts the newest partial sum, and the largest one kept before it.
NEWEST, LARGEST = 1e-150, 1e300
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
FILTER_BITS = 20
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


class PieceModel:
    """Languages, log priors and piece probabilities, with a memory of words."""

    def __init__(self, langs: list[str], prior: np.ndarray, p: np.ndarray, path: str):
        self.langs, self.prior, self.p, self.path = langs, np.log(prior), p, path
        self.ready = False

    def __getstate__(self):
        return {"langs": self.langs, "prior": self.prior, "p": self.p, "path": self.path, "ready": False}

    def prepare(self) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=self.path)
        pieces = [(sp.id_to_piece(i), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(len(s) for s, _ in pieces)
        self.power = np.array([pow(int(BASE), k, 1 << 64) for k in range(self.longest)], np.uint64)
        keys = np.array([self.key(s) for s, _ in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for _, i in pieces])[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.slot(self.keys)] = True
        self.forget()
        self.ready = True

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.logs = np.zeros((1024, len(self.langs)))
        self.chars: dict[int, np.ndarray] = {}

    def key(self, s: str) -> int:
        h = 0
        for k, c in enumerate(reversed(s)):
            h = (h + (ord(c) + 1) * int(self.power[k])) & (1 << 64) - 1
        return h

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return ((h * SPREAD) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def by_bytes(self, code: int) -> np.ndarray:
        """A character outside the vocabulary is the product of its bytes' pieces."""
        if code not in self.chars:
            self.chars[code] = np.prod([self.p[self.bytes[b]] for b in chr(code).encode("utf-8", "replace")], axis=0)
        return self.chars[code]

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each word under each language, over all segmentations.
        ``words`` go from long to short; the last alphas stand in a ring."""
        n, width, reach = len(words), len(self.langs), self.longest
        marked = [MARK + w for w in words]
        lengths = np.array([len(w) for w in marked])
        codes = np.zeros((lengths[0], n), np.uint64)
        flat = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes[at, np.repeat(np.arange(n), lengths)] = flat
        ring = np.zeros((reach + 1, n, width))
        ring[0] = 1.0
        scale, out = np.zeros((n, width)), np.zeros((n, width))
        for j in range(1, int(lengths[0]) + 1):
            live = int(np.searchsorted(-lengths, -j, "right"))
            a = np.zeros((live, width))
            h, other = np.zeros(live, np.uint64), np.zeros(0, np.int64)
            for d in range(1, min(reach, j) + 1):
                h = h + codes[j - d, :live] * self.power[d - 1]
                hit = np.flatnonzero(self.filter[self.slot(h)])
                place = np.searchsorted(self.keys, h[hit])
                place[place == len(self.keys)] = 0
                good = self.keys[place] == h[hit]
                rows, ids = hit[good], self.ids[place[good]]
                a[rows] += ring[(j - d) % (reach + 1), rows] * self.p[ids]
                if d == 1 and len(rows) < live:
                    other = np.setdiff1d(np.arange(live), rows, assume_unique=True)
            if len(other):
                # no piece spans a character outside the vocabulary, so what comes before it is settled
                settled = ring[(j - 1) % (reach + 1), other] * np.array([self.by_bytes(int(c) - 1) for c in codes[j - 1, other]])
                scale[other] += np.log(settled)
                ring[:, other], a[other] = 0.0, 1.0
            ring[j % (reach + 1), :live] = a
            done = np.flatnonzero(lengths[:live] == j)
            out[done] = np.log(a[done]) + scale[done]
            if j % 4 == 0:
                # the newest is far below one, so that those a few dozen rare pieces before it are in range, too
                with np.errstate(over="ignore"):
                    ring[:, :live] = np.minimum(ring[:, :live] / (a / NEWEST), LARGEST)
                scale[:live] += np.log(a) - np.log(NEWEST)
        return out

    def learn(self, words: set[str]) -> None:
        new = sorted(words, key=len, reverse=True)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.forget()
        long = sum(len(w) >= LONG for w in new)
        for part in [*([w] for w in new[:long]), *(new[i:i + 50_000] for i in range(long, len(new), 50_000))]:
            if part:
                logs, n = self.forward(part), len(self.known)
                while n + len(part) > len(self.logs):
                    self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
                self.logs[n:n + len(part)] = logs
                self.known.update(zip(part, range(n, n + len(part))))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0) for _ in texts]
        if not self.ready:
            self.prepare()
        out = []
        split = [t.split() if t and LETTER.search(t) else None for t in texts]
        for i in range(0, len(split), 100):
            part = split[i:i + 100]
            words = set().union(*(w for w in part if w))
            if not words <= self.known.keys():
                missing = words - self.known.keys()
                if len(self.known) + len(missing) > CACHE_WORDS:
                    self.forget()
                    missing = words
                self.learn(missing)
            for w in part:
                if w is None:
                    out.append((UNKNOWN, 0.0))
                    continue
                s = self.prior + self.logs[np.fromiter(map(self.known.__getitem__, w), np.int64, len(w))].sum(0)
                best = int(s.argmax())
                out.append((self.langs[best], float(1 / np.exp(s - s[best]).sum())))
        return out


def fit(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> PieceModel:
    """Piece probabilities from the training documents: those with text, a
    language and an id whose crc32 modulo 3 is not 1.

    Of each language about ``sample_docs`` documents are taken, by a hash of the
    id; all where there are fewer. What reaches the driver is bounded by the
    vocabulary times the languages.
    """
    rows = docs.filter(quoted(doc_id).isNotNull() & quoted(text).isNotNull() & quoted(lang).isNotNull() & ~held_out(doc_id))
    rows = rows.select(quoted(doc_id).cast("string").alias("id"), quoted(text).cast("string").alias("text"), quoted(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return PieceModel([], np.zeros(0), np.zeros((0, 0)), vocabulary)
    limit = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1 << 20, sample_docs * (1 << 20) // n))])
    rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < limit[F.col("lang")])
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("piece", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=vocabulary)
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for x, known in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                c = total.setdefault(known, np.zeros(sp.get_piece_size(), np.int64))
                np.add.at(c, sp.encode(x, num_threads=1), 1)
        for known, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([known] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=schema.names)

    from sentencepiece import SentencePieceProcessor

    found = rows.mapInArrow(count, schema).groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    counts = np.zeros((SentencePieceProcessor(model_file=vocabulary).get_piece_size(), len(langs)))
    counts[found["piece"].to_numpy(), [langs.index(x) for x in found["lang"]]] = found["n"].to_numpy()
    both = counts.sum(1, keepdims=True) + 0.1
    counts += PRIOR_PIECES * both / both.sum()
    share = np.array([sizes[x] for x in langs], float)
    return PieceModel(langs, share / share.sum(), counts / counts.sum(0), vocabulary)


def held_out(doc_id: str = "doc_id"):
    """The test fold: ids whose crc32, as text, leaves 1 modulo 3; null ids do not."""
    return F.coalesce(F.crc32(quoted(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability of that
    language. Texts that are null or hold no letter are ``und`` with score 0, as is
    every text if nothing was learned. Columns of these names are replaced."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    made = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return append_columns(docs, [text], made, lambda b: [list(v) for v in zip(*known.value.predict(b.column(0).to_pylist()))])


@query("op4_language_unigrams")
def op4(spark, sf_dir):
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    model = fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
