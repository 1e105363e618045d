"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A test string is cut into windows of consecutive words. For patterns of m words
a shift table maps each block of two words to the distance from its last place
in any pattern to the pattern's end; a block in no pattern lets the search skip
m - 1 words at once. A block at a pattern's end has shift zero and leads to a
bucket keyed by that suffix; its patterns are compared word by word.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import append_columns, cut, free_name, quoted, read
from cairn.llm.registry import query

__all__ = ["Tables", "decontaminate", "words"]

#: Windows that one pass searches for; a larger benchmark takes several passes.
PASS_WINDOWS = 200_000

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TO = bytes(c if c >= 0x80 or c in _KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return text.translate(_TO).split() if text else []


class Tables:
    """Shift tables, suffix buckets and single words for (window, items) pairs."""

    def __init__(self, windows: dict[tuple, list[str]]):
        self.single = {w[0]: ids for w, ids in windows.items() if len(w) == 1}
        self.by_length: dict[int, tuple[dict, dict]] = {}
        for m in sorted({len(w) for w in windows} - {1}):
            shift: dict = {}
            bucket = defaultdict(list)
            for w, ids in windows.items():
                if len(w) == m:
                    for j in range(1, m):
                        pair = w[j - 1], w[j]
                        shift[pair] = min(shift.get(pair, m - 1), m - 1 - j)
                    bucket[w[-2], w[-1]].append((list(w), ids))
            self.by_length[m] = shift, dict(bucket)

    def search(self, text: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """Every occurrence as (first word, end, item ids)."""
        found = []
        n = len(text)
        for m, (shift, bucket) in self.by_length.items():
            i, far, get = m - 1, m - 1, shift.get
            while i < n:
                pair = text[i - 1], text[i]
                step = get(pair, far)
                if step:
                    i += step
                    continue
                at = i - m + 1
                for w, ids in bucket[pair]:
                    if w[0] == text[at] and w == text[at:i + 1]:
                        found.append((at, i + 1, ids))
                i += 1
        if self.single:
            found += [(i, i + 1, self.single[w]) for i, w in enumerate(text) if w in self.single]
        return found


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def windows_of(bench: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """Distinct windows with the sorted list of the items that hold them."""
    made = T.StructType([T.StructField("w", T.ArrayType(T.BinaryType()))])

    def cut_up(batches):
        for b in batches:
            ids, ws = [], []
            for item, body in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                x = words(body)
                for i in range(max(1, len(x) - window + 1) if x else 0):
                    ids.append(item)
                    ws.append(x[i:i + window])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ws, pa.list_(pa.binary()))], names=["item", "w"])

    rows = bench.select(quoted(item_id).cast("string").alias("item"), quoted(text).cast("string").alias("text")).filter("item IS NOT NULL")
    return (rows.mapInArrow(cut_up, T.StructType([T.StructField("item", T.StringType()), *made.fields]))
            .groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items")))


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """``docs`` with ``n_words`` (long), ``hits`` (array of start and end word
    numbers, merged) and ``items`` (sorted ids, as strings, of the test strings
    that have a window in the text).

    A window is ``window`` consecutive words of a test string; a shorter, but
    not empty, test string is one window. The benchmark is taken in passes of
    at most ``pass_windows`` windows, so what is broadcast is bounded; each pass
    reads all documents.

    Null and empty texts have no words and no hits. Test strings without id or
    without words take no part; of test strings that share an id, windows of
    each count for that id. A benchmark without rows leaves all hits empty.
    Columns of ``docs`` named like a result are replaced.
    """
    spark = docs.sparkSession
    made = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.ArrayType(T.IntegerType()))),
                         T.StructField("items", T.ArrayType(T.StringType()))])
    grams = cut(windows_of(bench, window, item_id, item_text))
    passes = max(1, -(-grams.count() // pass_windows))
    out, before = docs, (free_name(docs, "_hits"), free_name(docs, "_items"))
    for k in range(passes):
        part = grams if passes == 1 else grams.filter(F.pmod(F.xxhash64("w"), F.lit(passes)) == k)
        tables = spark.sparkContext.broadcast(Tables({tuple(bytes(x) for x in r.w): list(r["items"]) for r in part.toLocalIterator()}))
        out = one_pass(out, tables, text, made, before if k else None)
        if passes > 1:
            out = cut(out)
    return out


def one_pass(docs: DataFrame, tables, text: str, made: T.StructType, again: tuple[str, str] | None) -> DataFrame:
    """One pass; ``again`` names the columns that hold the hits and items of those before it."""
    if again:
        docs = docs.withColumnsRenamed(dict(zip(("hits", "items"), again)))
    needs = [text, *(again or ())]

    def fn(b: pa.RecordBatch) -> list:
        t = tables.value
        ns, hits, items = [], [], []
        before = zip(b.column(1).to_pylist(), b.column(2).to_pylist()) if again else ((None, None) for _ in range(b.num_rows))
        for body, (h, it) in zip(b.column(0).cast(pa.binary()).to_pylist(), before):
            x = words(body)
            found = t.search(x)
            ns.append(len(x))
            hits.append(merged([(a, e) for a, e, _ in found] + [tuple(s) for s in h or []]))
            items.append(sorted({i for _, _, ids in found for i in ids} | set(it or [])))
        return [ns, hits, items]

    return append_columns(docs, needs, made, fn).drop(*(again or ()))


SQL = """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM p),
g AS (SELECT doc_id, i, ks.k, array_to_string(w[i:i + ks.k - 1], ' ') AS g FROM ks, (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) t WHERE i + ks.k - 1 <= len(w)),
m AS (SELECT g.doc_id, g.i, g.k, p.item FROM g JOIN p USING (g, k)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@query("op10_benchmark_decontamination", SQL)
def op10(spark, sf_dir):
    rows = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def brute(docs: list, bench: list, window: int = 10) -> list:
    """The query's rows, by comparing every window with every place; for tests."""
    out = []
    for doc_id, body in docs:
        x = words(body.encode() if body is not None else None)
        hit, ids = set(), set()
        for item, b in bench:
            y = words(b.encode() if b is not None else None)
            k = min(window, len(y))
            grams = {tuple(y[i:i + k]) for i in range(len(y) - k + 1)} if k and item is not None else set()
            for i in range(len(x) - k + 1):
                if tuple(x[i:i + k]) in grams:
                    hit.update(range(i, i + k))
                    ids.add(str(item))
        out.append((doc_id, len(x), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
