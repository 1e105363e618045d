"""Substring dedup by content-defined chunks.

A gear rolling hash of 16 bits runs over the bytes of each text; a chunk ends
where it falls below a limit, so boundaries depend on the sixteen bytes before
them and survive insertions elsewhere. A boundary that follows another one too
closely is passed over, by a rule that looks only at the bytes just before it as
well. Chunks are compared by a 128-bit digest across all documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import append_columns, cut, quoted, read
from cairn.llm.registry import query

__all__ = ["boundaries", "remove_repeats", "repeat_spans"]

#: Bytes of a chunk on average, and least bytes between boundaries.
MEAN_BYTES, LEAST_BYTES = 32, 8
#: Least bytes of a run of repeated chunks that is removed: a passage of fifty words has about three hundred.
RUN_BYTES = 100
#: Bytes that the gear hash sees: one for each bit.
WINDOW = 16


def gear_table() -> np.ndarray:
    """A random 16-bit number for each byte, by a multiplicative generator; zero for byte zero, which pads."""
    x, out = 1, []
    for _ in range(256):
        x = x * 6364136223846793005 % (1 << 64) + 1442695040888963407
        out.append(x >> 40 & 0xFFFF)
    return np.array([0, *out[1:]], np.uint16)


GEAR = gear_table()


def boundaries(texts: list[bytes]) -> list[np.ndarray]:
    """Ends of the chunks of each text, its own end included; nothing for an empty one."""
    pad = bytes(WINDOW)
    whole = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    g = GEAR[whole]
    h = g.copy()
    for j in range(1, WINDOW):
        h[j:] += g[:-j] << np.uint16(j)
    raw = np.flatnonzero(h < (1 << 16) // MEAN_BYTES) + 1
    out, at = [], WINDOW
    for t in texts:
        n = len(t)
        p = raw[np.searchsorted(raw, at, "right"):np.searchsorted(raw, at + n)] - at
        if len(p):
            p = p[np.diff(p, prepend=-LEAST_BYTES) >= LEAST_BYTES]
        out.append(np.append(p, n) if n else p[:0])
        at += n + WINDOW
    return out


def digests(text: bytes, ends: np.ndarray) -> list[bytes]:
    d = xxhash.xxh3_128_digest
    out, a = [], 0
    for b in ends.tolist():
        out.append(d(text[a:b]))
        a = b
    return out


def runs(text: bytes, ends: np.ndarray, marked: set[bytes]) -> list[tuple[int, int, bytes, bytes, int | None, int | None]]:
    """Runs of chunks that are marked or stand earlier in the text: start, end,
    digests of the first and the last chunk, and where the earlier ones of these
    in the text start and end."""
    seen: dict[bytes, tuple[int, int]] = {}
    out, run, a = [], None, 0
    for d, b in zip(digests(text, ends), ends.tolist()):
        if d[:8] in marked or d in seen:
            p, q = seen.get(d, (None, None))
            run = (a, b, d, d, p, q) if run is None else (*run[:1], b, run[2], d, run[4], q)
        elif run is not None:
            out.append(run)
            run = None
        seen.setdefault(d, (a, b))
        a = b
    return out if run is None else [*out, run]


def same_before(x: bytes, i: int, y: bytes, j: int) -> int:
    """How many bytes before ``x[i]`` are those before ``y[j]``."""
    n = most = min(i, j)
    if x[i - n:i] != y[j - n:j]:
        differ = np.flatnonzero(np.frombuffer(x, np.uint8, n, i - n) != np.frombuffer(y, np.uint8, n, j - n))
        n = most - 1 - int(differ[-1])
    return n


def same_after(x: bytes, i: int, y: bytes, j: int) -> int:
    """How many bytes from ``x[i]`` on are those from ``y[j]`` on."""
    n = min(len(x) - i, len(y) - j)
    if x[i:i + n] != y[j:j + n]:
        n = int(np.flatnonzero(np.frombuffer(x, np.uint8, n, i) != np.frombuffer(y, np.uint8, n, j))[0])
    return n


def repeat_spans(text: bytes, ends: np.ndarray, marked: set[bytes], around: dict[tuple[bytes, bool], bytes], run_bytes: int) -> list[tuple[int, int]]:
    """Runs of chunks that are marked or stand earlier in the text, extended on
    both sides as far as the bytes are those beside the holder's chunk (``around``:
    by first half of the digest and side, after it or not) or the earlier one;
    those of at least ``run_bytes`` bytes, drawn in to whole characters."""
    spans: list[list[int]] = []
    for start, end, first, last, p, q in runs(text, ends, marked):
        before, after = around.get((first[:8], False), b""), around.get((last[:8], True), b"")
        s = start - max(same_before(text, start, before, len(before)), 0 if p is None else same_before(text, start, text, p))
        e = end + max(same_after(text, end, after, 0), 0 if q is None else same_after(text, end, text, q))
        if spans and s <= spans[-1][1]:
            spans[-1] = [min(s, spans[-1][0]), max(e, spans[-1][1])]
        else:
            spans.append([s, e])
    out = []
    for s, e in spans:
        if e - s < run_bytes:
            continue
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e < len(text) and e > s and text[e] & 0xC0 == 0x80:
            e -= 1
        if e > s:
            out.append((s, e))
    return out


def edge_rows(docs: DataFrame) -> DataFrame:
    """Of (doc, text, marks, own): a row (d1, after, doc, bytes) for each side of a
    run of chunks that another document holds, without bytes; and for both sides of
    each ``own`` chunk at its first place, with the bytes there. They reach over the
    chunk beside it, and before that as far as a boundary depends on: if all of them
    were the same elsewhere, so would be the chunk."""
    schema = T.StructType([T.StructField("d1", T.LongType()), T.StructField("after", T.BooleanType()), T.StructField("doc", T.LongType()), T.StructField("bytes", T.BinaryType())])

    def run(batches):
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            d1, after, doc, near = [], [], [], []
            for i, x, ends, marks, own in zip(b.column(0).to_pylist(), texts, boundaries(texts), *(map(halves, b.column(k)) for k in (2, 3))):
                wanted = {(r[2 + side][:8], bool(side)) for r in runs(x, ends, marks) for side in (0, 1) if r[2 + side][:8] in marks}
                found = [(*w, None) for w in wanted]
                at = [0, *ends.tolist()]
                for k, d in enumerate(digests(x, ends) if own else []):
                    if d[:8] in own:
                        own.remove(d[:8])
                        found += [(d[:8], False, x[max(0, at[max(k - 1, 0)] - WINDOW - LEAST_BYTES):at[k]]), (d[:8], True, x[at[k + 1]:at[min(k + 2, len(at) - 1)]])]
                for half, side, beside in found:
                    d1.append(int.from_bytes(half, "little", signed=True))
                    after.append(side)
                    doc.append(i)
                    near.append(beside)
            yield pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), pa.array(after, pa.bool_()), pa.array(doc, pa.int64()), pa.array(near, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def halves(marks: pa.Scalar) -> set[bytes]:
    """First halves of digests, of a list of longs or null."""
    return {v.to_bytes(8, "little", signed=True) for v in marks.values.to_pylist()} if marks.values is not None else set()


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(d1, d2, doc) for the distinct chunks of each row of (doc, text)."""
    schema = T.StructType([T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("doc", T.LongType())])

    def run(batches):
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            ids, sets = b.column(0).to_numpy(), [list(set(digests(x, e))) for x, e in zip(texts, boundaries(texts))]
            both = np.frombuffer(b"".join(d for s in sets for d in s), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.repeat(ids, [len(s) for s in sets]))],
                                             names=schema.names)

    return docs.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and ``spans`` (array
    of start and end bytes of what went).

    Of each chunk that several documents hold, the document with the smallest id
    keeps it; of those that one document holds more than once, its first stays.
    A run of such chunks is extended on both sides as far as its bytes are those
    beside the chunk that stays, so to the ends of the repeated passage. What goes
    are extended runs of at least ``run_bytes`` bytes, drawn in to whole
    characters; each byte of them stands earlier, in this or another document.
    Shorter passages stay, and those without a whole chunk.

    Null and empty texts stay as they are. Rows that share a doc_id are one
    document, of which each row keeps its chunks. Rows without doc_id are left
    as they are and count for no other. A column ``spans`` of ``docs`` is
    replaced. An empty table gives an empty one.
    """
    marks, doc, around = "_cairn_marks", "_cairn_doc", "_cairn_around"
    docs = docs.drop("spans")
    rows = docs.filter(quoted(doc_id).isNotNull() & quoted(text).isNotNull()).select(quoted(doc_id).cast("long").alias("doc"), quoted(text).alias("text"))
    repeated = cut(chunk_rows(rows).groupBy("d1", "d2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"), F.max("doc").alias("last"))
                   .filter("first < last").select("d1", "d2", "first"))
    both = F.collect_set(F.when(F.col("doc") != F.col("first"), F.col("d1"))), F.collect_set(F.when(F.col("doc") == F.col("first"), F.col("d1")))
    later = cut(chunk_rows(rows).join(repeated, ["d1", "d2"]).groupBy("doc").agg(both[0].alias(marks), both[1].alias("own")))
    edges = cut(edge_rows(rows.join(later, "doc").select("doc", "text", marks, "own")))
    beside = edges.filter("bytes IS NOT NULL").groupBy("d1", "after").agg(F.min("bytes").alias("bytes"))
    wanted = edges.filter("bytes IS NULL").select("d1", "after", "doc").distinct()
    found = wanted.join(beside, ["d1", "after"]).groupBy("doc").agg(F.collect_list(F.struct("d1", "after", "bytes")).alias(around))
    later = later.filter(F.size(marks) > 0).select("doc", marks).join(found, "doc", "left").withColumnRenamed("doc", doc)
    full = docs.join(cut(later), quoted(doc_id).cast("long") == F.col(doc), "left").drop(doc)
    made = T.StructType([T.StructField("_cairn_text", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def fn(b: pa.RecordBatch) -> list:
        texts = [x for x in b.column(0).cast(pa.binary()).to_pylist()]
        kept, spans = [], []
        for x, ends, m, near, known in zip(texts, boundaries([x or b"" for x in texts]), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
            sides = {(r["d1"].to_bytes(8, "little", signed=True), r["after"]): r["bytes"] for r in near or []}
            found = repeat_spans(x, ends, halves(m), sides, run_bytes) if x and known else []
            spans.append(found)
            kept.append(x if not found else without(x, found))
        return [pa.array(kept, pa.binary()).cast(pa.string()), spans]

    full = full.withColumn("_cairn_known", quoted(doc_id).isNotNull())
    full = append_columns(full, [text, marks, around, "_cairn_known"], made, fn)
    return full.select(*[F.col("_cairn_text").alias(c) if c == text else quoted(c) for c in docs.columns], "spans")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in spans:
        parts.append(text[at:s])
        at = e
    return b"".join([*parts, text[at:]])


@query("op7_substring_chunks")
def op7(spark, sf_dir):
    rows = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    kept = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", (F.octet_length(kept) + gone).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2(kept.cast("binary"), 256).alias("kept_sha256"), "text")


def brute(docs: list[tuple], run_bytes: int = RUN_BYTES) -> dict:
    """doc_id to (kept bytes, spans) for rows with distinct ids, chunk by chunk, and
    byte by byte at the ends of runs; for tests."""
    first: dict[bytes, tuple] = {}
    chunks = {}
    for doc_id, text in sorted(docs):
        x = (text or "").encode()
        a, mine = 0, []
        for b in boundaries([x])[0].tolist():
            mine.append((a, b, hashlib.sha256(x[a:b]).digest()))
            a = b
        chunks[doc_id] = x, mine
        for a, b, d in mine:
            first.setdefault(d, (doc_id, a, b))
    out = {}
    for doc_id, (x, mine) in chunks.items():
        seen, sources = {}, []  # where else each chunk stands
        for a, b, d in mine:
            at = [(x, *seen[d])] if d in seen else []
            if first[d][0] != doc_id:
                at.append((chunks[first[d][0]][0], *first[d][1:]))
            sources.append(at)
            seen.setdefault(d, (a, b))
        gone = bytearray(len(x))
        for i, (a, b, _) in enumerate(mine):
            if sources[i]:
                gone[a:b] = b"\1" * (b - a)
            if sources[i] and (i == 0 or not sources[i - 1]):
                for y, p, _ in sources[i]:
                    n = 0
                    while n < min(a, p) and x[a - 1 - n] == y[p - 1 - n]:
                        n += 1
                        gone[a - n] = 1
            if sources[i] and (i + 1 == len(mine) or not sources[i + 1]):
                for y, _, q in sources[i]:
                    n = 0
                    while b + n < len(x) and q + n < len(y) and x[b + n] == y[q + n]:
                        gone[b + n] = 1
                        n += 1
        spans, i = [], 0
        while i < len(x):
            j = i
            while j < len(x) and gone[j]:
                j += 1
            if j - i >= run_bytes:
                s, e = i, j
                while s < e and x[s] & 0xC0 == 0x80:
                    s += 1
                while e < len(x) and e > s and x[e] & 0xC0 == 0x80:
                    e -= 1
                spans.append((s, e))
            i = max(j, i + 1)
        out[doc_id] = without(x, spans), spans
    return out
