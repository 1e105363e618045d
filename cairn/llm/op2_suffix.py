"""Exact substring dedup with a run-length index.

Every window of ``length`` bytes is sent by its minimizer: the smallest hash of a
k-gram in it. Equal windows have equal minimizers, so windows that can be equal
meet, wherever they stand. Of the texts around minimizers that occur once nothing
more is done; the others are gathered, equal ones once, into shards of bounded
size. For each shard a run-compressed Burrows-Wheeler transform is built, with the
suffixes sampled at the ends of runs. Streaming over the shard in text order gives
each position's matching statistic, the longest match with another place: at a
sampled position it is known, and from there it falls by one with each byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import append_columns, cut, quoted, read
from cairn.llm.op7_chunks import without
from cairn.llm.registry import query

__all__ = ["RunIndex", "repeated_windows", "remove_matches", "segments"]

#: Bytes of a k-gram, and windows of a segment at most.
GRAM, SEGMENT_WINDOWS = 64, 1024
#: Bytes handled at once while texts are cut into segments, and bytes of a shard.
SLICE_BYTES, SHARD_BYTES = 4 << 20, 1 << 20
#: Bytes of different segments around one k-gram from which its windows are compared one by one.
WIDE_BYTES = 1 << 20
BASE, MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    up, down = POWERS.get(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[:len(x) - k + 1]
    h ^= h >> np.uint64(31)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h * MIX


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, by prefix and suffix minima of blocks."""
    n = len(h) - w + 1
    blocks = np.full(-(-len(h) // w) * w, np.iinfo(h.dtype).max, h.dtype)
    blocks[:len(h)] = h
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def segments(texts: list[bytes], length: int):
    """Yields (numbers of texts, first windows, numbers of windows, keys, flags):
    runs of windows of one text with the same least hash, for a few megabytes at a
    time. The flag tells that a run holds it at several places, as in periodic text."""
    k = min(GRAM, length)
    part: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        x = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
        h = gram_hashes(x, k)
        least = sliding_least(h, length - k + 1)
        sizes = np.array([len(p[2]) for p in part])
        first = np.cumsum(sizes) - sizes
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        new[first] = True
        last = first + sizes - length + 1  # the windows after it reach into the next text
        starts = np.flatnonzero(new)
        which = np.searchsorted(first, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(least)), last[which])
        ok = starts < ends
        starts, ends, which = starts[ok], ends[ok], which[ok]
        left = np.concatenate([[0], np.cumsum(h[:len(least)] == least)])  # windows whose minimizer the next one leaves behind
        many = left[ends - 1] > left[starts]
        pieces = -(-(ends - starts) // SEGMENT_WINDOWS)
        if (pieces > 1).any():
            step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, ends, which, many = np.repeat(starts, pieces) + step * SEGMENT_WINDOWS, np.repeat(ends, pieces), np.repeat(which, pieces), np.repeat(many, pieces)
            ends = np.minimum(ends, starts + SEGMENT_WINDOWS)
        keys = least[starts].view(np.int64)
        return np.array([p[0] for p in part])[which], starts - first[which] + np.array([p[1] for p in part])[which], ends - starts, keys, many

    for i, t in enumerate(texts):
        for a in range(0, len(t) - length + 1, SLICE_BYTES):
            part.append((i, a, t[a:a + SLICE_BYTES + length - 1]))
            size += len(part[-1][2])
            if size >= SLICE_BYTES:
                yield flush()
                part, size = [], 0
    if part:
        yield flush()


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of some texts, each ended by a
    symbol of its own, with the suffix array sampled at both ends of each run.
    ``weights`` tells how often each text occurs in all; it is held once.

    ``symbols`` and ``lengths`` are the runs; ``heads`` and ``tails`` the text
    positions of the suffixes at their ends; ``common`` the length of the common
    prefix of each run's head and the tail before it.
    """

    def __init__(self, texts: list[bytes], weights: list[int] | None = None):
        sizes = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(sizes) - 1
        x = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int16) + 1
        x[ends] = 0
        self.size, self.starts, self.ends = len(x), ends - sizes + 1, ends
        self.weights = np.ones(len(texts), np.int64) if weights is None else np.array(weights)
        order, ranks = self._sort(x, ends)
        # a text's own end symbol differs from every other one
        names = x.astype(np.int64) + len(texts)
        names[ends] = np.arange(len(texts))
        before = names[order - 1]
        head = np.ones(len(x), bool)
        head[1:] = before[1:] != before[:-1]
        at = np.flatnonzero(head)
        self.symbols, self.lengths = before[at], np.diff(np.append(at, len(x)))
        self.heads, self.tails = order[at], order[np.append(at[1:], len(x)) - 1]
        self.common = np.zeros(len(at), np.int64)
        self.common[1:] = self._common(names, ranks, self.heads[1:], self.tails[:-1])

    @staticmethod
    def _sort(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix array by prefix doubling, and the ranks of prefixes of each length on
        the way. A key holds the first seven symbols, blank from the end symbol on;
        suffixes that reach an end so soon differ, and stand in the order of their
        texts. After that, only suffixes that share their rank are sorted again."""
        bits, h, n = 9, 7, len(x)
        near = np.full(n, h, np.int8)  # symbols before the end symbol, if fewer than seven
        for j in range(h):
            at = ends[ends >= j] - j
            near[at] = np.minimum(near[at], j)
        key = np.zeros(n, np.int64)
        for j in range(min(h, n)):
            key <<= bits
            key[:n - j] |= np.where(near[:n - j] > j, x[j:], 0)
        order = np.argsort(key)
        short = near[order] < h
        slots = np.flatnonzero(short)
        late = order[slots]
        order[slots] = late[np.lexsort((late, key[late]))]
        s = key[order]
        new = np.ones(n, bool)
        new[1:] = (s[1:] != s[:-1]) | short[1:]
        places = np.arange(n)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, places, 0))
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        ranks: list[tuple[int, np.ndarray]] = []
        while len(tied):
            ranks.append((h, rank.astype(np.int32)))
            at = order[tied]
            group = rank[at]
            pair = group * n + rank[at + h]  # a shared rank means h symbols without an end, so at + h is within
            by = np.argsort(pair)
            order[tied], pair, group = at[by], pair[by], group[by]
            fresh = np.ones(len(tied), bool)
            fresh[1:] = pair[1:] != pair[:-1]
            rank[order[tied]] = np.maximum.accumulate(np.where(fresh, tied, 0))
            tied = tied[~(fresh & np.append(fresh[1:], True))]
            h *= 2
        return order, ranks

    @staticmethod
    def _common(x: np.ndarray, ranks, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        p, q, total = p.copy(), q.copy(), np.zeros(len(p), np.int64)
        for h, rank in reversed(ranks):
            same = h * (rank[p] == rank[q])
            p, q, total = p + same, q + same, total + same
        first = ranks[0][0] if ranks else len(x)
        live = np.arange(len(p))
        for _ in range(first):
            live = live[(x[p[live]] == x[q[live]])]
            if not len(live):
                break
            p[live] += 1
            q[live] += 1
            total[live] += 1
        return total

    def matching_statistics(self) -> np.ndarray:
        """The longest match of each text position with another one, in text order."""
        out = np.zeros(self.size, np.int64)
        after = np.append(self.common[1:], 0)
        for samples, known in ((self.heads, self.common), (self.tails, after)):
            order = np.argsort(samples)
            at, value = samples[order], known[order]
            gaps = np.diff(np.append(at, self.size))
            here = np.repeat(value + at, gaps)
            out[at[0]:] = np.maximum(out[at[0]:], here - np.arange(at[0], self.size))
        for t in np.flatnonzero(self.weights > 1):  # each of its suffixes stands that often, up to the end of the text
            out[self.starts[t]:self.ends[t] + 1] = np.arange(self.ends[t] - self.starts[t], -1, -1)
        return out


def repeated_windows(rows: list[tuple[bytes, bool]], length: int) -> list[list[tuple[int, int]]]:
    """For each (text, whether it occurs more than once), the runs of windows of
    ``length`` bytes that occur more than once in all, as (first, end). A text
    that occurs more than once is indexed once, with that weight: its suffixes match
    those of its copies to the end."""
    index = RunIndex([t for t, _ in rows], [1 + more for _, more in rows])
    long = index.matching_statistics() >= length
    out = []
    for (t, _), a in zip(rows, index.starts):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], long[a:a + len(t)].astype(np.int8), [0]])))
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist())))
    return out


LONG, INT, BIN = T.LongType(), T.IntegerType(), T.BinaryType()


def schema_of(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def segment_keys(texts: DataFrame, length: int) -> DataFrame:
    """The key of every segment, twice where it holds its minimizer at several places."""
    def run(batches):
        for b in batches:
            for *_, keys, many in segments([x or b"" for x in b.column(0).cast(pa.binary()).to_pylist()], length):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, 1 + many))], names=["key"])

    return texts.select("text").mapInArrow(run, schema_of(key=LONG))


def segment_rows(texts: DataFrame, length: int) -> DataFrame:
    """(key, digest, r1, r2, start, windows) of every segment."""
    made = schema_of(key=LONG, digest=LONG, r1=LONG, r2=LONG, start=LONG, windows=INT)

    def run(batches):
        h = xxhash.xxh64_intdigest
        for b in batches:
            data = [x or b"" for x in b.column(0).cast(pa.binary()).to_pylist()]
            r1, r2 = b.column(1).to_numpy(), b.column(2).to_numpy()
            for doc, start, n, keys, _ in segments(data, length):
                digest = np.array([h(data[d][s:e]) for d, s, e in zip(doc.tolist(), start.tolist(), (start + n + length - 1).tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(digest.view(np.int64)), pa.array(r1[doc]), pa.array(r2[doc]), pa.array(start.astype(np.int64)),
                                                  pa.array(n.astype(np.int32))], names=made.names)

    return texts.select("text", "r1", "r2").mapInArrow(run, made)


def match_marks(texts: DataFrame, length: int, shard_bytes: int, wide_bytes: int) -> DataFrame:
    """(r1, r2, spans): the byte spans covered by repeated windows, for each different text that has some."""
    often = cut(segment_keys(texts, length).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    same = ["key", "digest", "r1", "r2", "start", "windows"]
    found = cut(segment_rows(texts, length).join(often, "key").groupBy(same).agg(F.count(F.lit(1)).alias("n")))
    different = cut(found.groupBy("key", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("r1", "r2", "start", "windows")).alias("at")))
    wide = cut(different.groupBy("key").agg(F.sum(F.col("at.windows") + (length - 1)).alias("b")).filter(F.col("b") > wide_bytes).select("key", F.lit(True).alias("wide")))
    wanted = (different.join(wide, "key", "left").select("at.*", "key", "digest", (F.col("n") > 1).alias("more"), F.coalesce("wide", F.lit(False)).alias("wide"))
              .groupBy("r1", "r2").agg(F.collect_list(F.struct("key", "digest", "start", "windows", "more", "wide")).alias("parts")))
    held = texts.filter(F.octet_length("text") >= length).join(cut(wanted), ["r1", "r2"]).select("r1", "r2", "text", "parts")
    made = schema_of(key=LONG, digest=LONG, more=T.BooleanType(), wide=T.BooleanType(), text=BIN)

    def bodies(batches):
        done: set[tuple[int, int]] = set()
        for b in batches:
            rows = []
            for r1, r2, x, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3)):
                if (r1, r2) not in done:  # equal texts: one of them is enough
                    done.add((r1, r2))
                    rows += [(p["key"], p["digest"], p["more"], p["wide"], x[p["start"]:p["start"] + p["windows"] + length - 1]) for p in parts.as_py()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()))],
                                             names=made.names)

    body = cut(held.mapInArrow(bodies, made))
    marks = schema_of(key=LONG, digest=LONG, first=INT, end=INT)

    def shard(batches):
        rows: dict[tuple[int, int], tuple[bytes, bool]] = {}
        size, before = 0, None

        def flush():
            out = [(*k, a, e) for k, runs in zip(rows, repeated_windows(list(rows.values()), length)) for a, e in runs]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=marks.names)

        for b in batches:
            for key, digest, more, x in zip(*[c.to_pylist() for c in b.columns]):
                if key != before and size >= shard_bytes:
                    yield flush()
                    rows, size = {}, 0
                before = key
                if (key, digest) not in rows:
                    rows[key, digest] = x, more
                    size += len(x)
        if rows:
            yield flush()

    dealt = body.filter("NOT wide").select("key", "digest", "more", "text").repartition("key").sortWithinPartitions("key")
    by_index = dealt.mapInArrow(shard, marks)
    single = schema_of(w1=LONG, w2=LONG, more=INT, key=LONG, digest=LONG, first=INT)

    def windows(batches):
        h = xxhash.xxh3_128_digest
        for b in batches:
            for key, digest, more, x in zip(*[c.to_pylist() for c in b.columns]):
                n = len(x) - length + 1
                d = np.frombuffer(b"".join(h(x[i:i + length]) for i in range(n)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(np.full(n, 1 + more, np.int32)), pa.array(np.full(n, key)),
                                                  pa.array(np.full(n, digest)), pa.array(np.arange(n, dtype=np.int32))], names=single.names)

    each = cut(body.filter("wide").select("key", "digest", "more", "text").mapInArrow(windows, single).distinct())
    twice = cut(each.groupBy("w1", "w2").agg(F.sum("more").alias("n")).filter("n > 1").select("w1", "w2"))
    by_window = each.join(twice, ["w1", "w2"]).select("key", "digest", "first", (F.col("first") + 1).alias("end"))
    all_marks = cut(by_index.unionByName(by_window))
    span = F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("end") + (length - 1)).alias("b"))
    return found.join(all_marks, ["key", "digest"]).groupBy("r1", "r2").agg(F.collect_set(span).alias("spans"))


def remove_matches(docs: DataFrame, length: int = 200, text: str = "text", shard_bytes: int = SHARD_BYTES, wide_bytes: int = WIDE_BYTES) -> DataFrame:
    """``docs`` with ``n_bytes``, ``spans`` (start and end bytes of the maximal runs
    covered by strings of ``length`` bytes that start anywhere else too, in the
    same or another text) and ``kept`` (the bytes outside them).

    Strings are judged on the input and may overlap; matches never cross texts.
    A k-gram with very many different surroundings is not gathered: its windows
    are counted one by one across the cluster, which is exact as well. Equal
    texts are indexed once and counted as often as they occur.

    Null texts are empty; texts below ``length`` bytes lose nothing. Every row
    counts, also those that repeat others. Columns of ``docs`` named like a result
    are replaced.
    """
    key1, key2, marks = "_cairn_r1", "_cairn_r2", "_cairn_spans"
    body = quoted(text).cast("string")
    r1, r2 = F.xxhash64(body), F.xxhash64(F.lit(1), body)
    texts = docs.filter(F.octet_length(body) >= length).select(body.alias("text"), r1.alias("r1"), r2.alias("r2"))
    found = cut(match_marks(texts, length, shard_bytes, wide_bytes).select(F.col("r1").alias(key1), F.col("r2").alias(key2), F.col("spans").alias(marks)))
    full = docs.drop("n_bytes", "spans", "kept").withColumn(key1, r1).withColumn(key2, r2).join(found, [key1, key2], "left")
    made = schema_of(n_bytes=LONG, spans=T.ArrayType(T.ArrayType(LONG)), kept=BIN)

    def fn(b: pa.RecordBatch) -> list:
        sizes, spans, kept = [], [], []
        for x, s in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1)):
            x, runs = x or b"", []
            for p in sorted((p["a"], p["b"]) for p in s.as_py() or []):
                if runs and p[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], p[1])
                else:
                    runs.append(list(p))
            sizes.append(len(x))
            spans.append(runs)
            kept.append(without(x, runs))
        return [sizes, spans, kept]

    return append_columns(full.withColumn(text, body), [text, marks], made, fn).drop(key1, key2, marks)


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY doc_id, k),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k, sum(b - a) AS n_removed, count(*) AS n_spans
         FROM g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op2_suffix_run_index", SQL)
def op2(spark, sf_dir):
    rows = remove_matches(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[bytes], length: int) -> list[tuple[int, int]]:
    """Number of bytes removed and of runs of each text, window by window; for tests."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i:i + length]] = count.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                hit[i:i + length] = 1
        out.append((int(hit.sum()), int((np.diff(np.concatenate([[0], hit])) == 1).sum())))
    return out
