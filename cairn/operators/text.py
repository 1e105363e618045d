"""Text: cleaning, n-grams, TF-IDF, document similarity, quality."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cairn.functions.expr import band_ge, band_le, flag, pct, rnd, tally
from cairn.operators.vectors import top_k
from cairn.plans.lineage import written
from cairn.plans.ordered import sequence, share, with_stats
from cairn.plans.skew import parts_for, split_join, spread

BLANKS = r"[ \t\n\r\f]+"


def word_count(column):
    """Words as blanks plus one."""
    c = F.col(column)
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1


def text_clean(df: DataFrame, text="text") -> DataFrame:
    """Lower case, trimmed, empty texts dropped."""
    return df.withColumn(text, F.lower(F.trim(text))).filter(F.length(text) > 0)


def tokens(text, delimiter=BLANKS):
    return F.array_remove(F.split(text, delimiter), "")


def ngram_rows(df: DataFrame, id_col="doc_id", text="text", grams=(1, 2, 3), delimiter=BLANKS, to_lower=True, keep=()) -> DataFrame:
    """(id, n, ngram) for every place of every n-gram."""
    return _places(spread(df.select(id_col, *keep, F.col(text).alias("__t")), "__t"), [id_col, *keep], grams, delimiter, to_lower)


def _places(df, ids, grams, delimiter, to_lower):
    rows = df.withColumn("__g1", tokens(F.lower("__t") if to_lower else F.col("__t"), delimiter)).drop("__t")
    # the n-grams of size n are those of size n - 1, each with one more word
    for n in range(2, max(grams) + 1):
        more = F.greatest(F.size("__g1") - (n - 1), F.lit(0))
        rows = rows.withColumn(f"__g{n}", F.zip_with(F.slice(f"__g{n - 1}", F.lit(1), more), F.slice("__g1", F.lit(n), more),
                                                     lambda a, b: F.concat(a, F.lit(" "), b)))
    of = lambda n: F.struct(F.lit(n).alias("n"), F.col(f"__g{n}").alias("g"))
    return rows.select(*ids, F.explode(F.array(*[of(n) for n in grams])).alias("s")) \
               .select(*ids, F.col("s.n").alias("n"), F.explode("s.g").alias("ngram"))


def ngrams(df: DataFrame, id_col="doc_id", text="text", grams=(1, 2, 3), delimiter=BLANKS, to_lower=True, keep=()) -> DataFrame:
    """(id, n, ngram, frequency) for every n in ``grams``. The texts are dealt by id,
    so that the n-grams of a document are counted where they are made."""
    rows = df.select(id_col, *keep, F.col(text).alias("__t"))
    long = _places(rows.repartition(parts_for(rows, "__t"), id_col), [id_col, *keep], grams, delimiter, to_lower)
    return long.groupBy(id_col, *keep, "n", "ngram").agg(F.count(F.lit(1)).alias("frequency"))


def ngram_stats(grams: DataFrame) -> DataFrame:
    """Per size: distinct n-grams and occurrences, of ``ngrams`` or, without
    counting per document first, of ``ngram_rows``."""
    g = grams.groupBy("n", "ngram").agg((F.sum("frequency") if "frequency" in grams.columns else F.count(F.lit(1))).alias("f"))
    return g.groupBy("n").agg(F.count(F.lit(1)).alias("unique_ngrams"), F.sum("f").alias("total_occurrences"))


def top_ngrams(grams: DataFrame, k=20) -> DataFrame:
    """The k most frequent n-grams of each size with document frequency."""
    g = grams.groupBy("n", "ngram").agg(F.sum("frequency").alias("frequency"), F.count(F.lit(1)).alias("doc_frequency"))
    return top_k(g, ["n"], k, [-F.col("frequency"), F.col("ngram")])


def term_counts(df: DataFrame, id_col="doc_id", text="text", stop_words=()) -> DataFrame:
    """(id, term, count, length): length is the number of counted tokens. The texts
    are dealt by id, so that the terms of a document are counted where they are made."""
    w = tokens(F.lower(text))
    if stop_words:
        w = F.filter(w, lambda x: ~x.isin(*stop_words))
    rows = df.select(id_col, text)
    rows = rows.repartition(parts_for(rows, text), id_col).select(id_col, w.alias("__w"))
    return rows.select(id_col, F.size("__w").alias("length"), F.explode("__w").alias("term")) \
               .groupBy(id_col, "length", "term").agg(F.count(F.lit(1)).alias("n"))


def tfidf_fit(df: DataFrame, id_col="doc_id", text="text", min_df=1, max_df=1.0, top=None, stop_words=()) -> DataFrame:
    """(term, doc_freq, idf_weight) with idf = ln(N / doc_freq); ``max_df`` is
    a share of the documents, ``top`` keeps the most frequent terms."""
    c = term_counts(df, id_col, text, stop_words).groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    m = c.crossJoin(F.broadcast(n)).filter((F.col("doc_freq") >= min_df) & (F.col("doc_freq") <= max_df * F.col("__n")))
    m = m.select("term", "doc_freq", F.ln(F.col("__n") / F.col("doc_freq")).alias("idf_weight"))
    return m if top is None else m.orderBy(F.desc("doc_freq"), "term").limit(top)


def tfidf_transform(df: DataFrame, model: DataFrame, id_col="doc_id", text="text", stop_words=()) -> DataFrame:
    """(id, term, tf, tfidf_value); tf = count / document length. Most terms are
    rare, so the model is not repeated: a term has a row for each document at
    most, and parts that are far larger than others are split by Spark."""
    rows = term_counts(df, id_col, text, stop_words).join(model, "term")
    tf = F.col("n") / F.col("length")
    return rows.select(id_col, "term", tf.alias("tf"), (tf * F.col("idf_weight")).alias("tfidf_value"))


def out_of_vocabulary(df: DataFrame, model: DataFrame, id_col="doc_id", text="text") -> DataFrame:
    """Documents none of whose terms are in the model."""
    known = split_join(term_counts(df, id_col, text), model, "term").select(id_col).distinct()
    return df.join(known, id_col, "left_anti")


COMMON = 0.01  # share of the documents from which on a term counts as common
TILE_ENTRIES = 1 << 22  # terms of documents in one tile
CHUNK_SCORES = 1 << 20  # scores that are held at once
DENSE = 256  # most frequent terms that are multiplied as matrices


def doc_similarity(features: DataFrame, id_col="doc_id", threshold=0.5, top=5) -> DataFrame:
    """For every document its ``top`` most similar ones with cosine at or
    above the threshold (weights of ``tfidf_transform``), exact; pairs share a term.

    Documents are compared by pairs of tiles, the two sides of a pair at once, and no
    pair is ever a row of its own but the best few of each document in a tile. A tile is
    one row of a table, written once; tasks read the tiles of a pair where they are, so the
    disk needed grows with the documents, not with the pairs of tiles. Terms are numbered from rare to frequent. The products of rare terms are
    summed for all pairs of two tiles, from lists of the documents of each term; what
    common terms add is at most the product of the norms of the common parts, and only
    pairs that can reach the threshold with it have the common terms summed as well."""
    f = written(features.filter((F.col("tfidf_value") > 0) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "term", F.col("tfidf_value").alias("w")), tidy=True)
    terms = sequence(f.groupBy("term").agg(F.count(F.lit(1)).alias("df")), [], ["df", "term"], "t")
    rows = f.join(terms.select("term", F.col("t").cast("int").alias("t"), (F.col("df") > 1).alias("shared")), "term")
    docs = rows.groupBy("id").agg(F.sqrt(F.sum(F.pow("w", 2))).alias("n"), F.collect_list(F.when(F.col("shared"), F.struct("t", "w"))).alias("v"))
    docs = written(docs.select("id", F.col("v.t").alias("t"), F.transform("v.w", lambda x: x / F.col("n")).alias("w")), tidy=True)
    n, entries = docs.agg(F.count(F.lit(1)), F.sum(F.size("t"))).first()
    rare = terms.filter(F.col("df") <= COMMON * n).agg(F.max("t")).first()[0] or 0
    cores = features.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, ceil((entries or 0) / TILE_ENTRIES), min(ceil((2 * cores) ** 0.5), n // 256))
    kind = dict(docs.dtypes)["id"]
    dealt = docs.repartitionById(tiles, F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))
    packed = written(dealt.mapInArrow(_packed, f"id array<{kind}>, sizes binary, t binary, w binary").withColumn("tile", F.shiftright(F.monotonically_increasing_id(), 33)), tidy=True)

    def side(k):
        return packed.select(*[F.col(c).alias(f"{k}_{c}") for c in packed.columns])

    # one order of each two tiles, and for half of them the other way round, so that all tasks get some
    own, order = F.col("l_tile") == F.col("r_tile"), F.col("l_tile") < F.col("r_tile")
    pairs = side("l").hint("shuffle_replicate_nl").crossJoin(side("r")).filter(own | (order == ((F.col("l_tile") + F.col("r_tile")) % 2 == 0)))

    def best(batches):
        for b in batches:
            for row in range(b.num_rows):
                of = {c: b.column(c)[row] for c in b.schema.names}
                same = of["l_tile"] == of["r_tile"]
                ids = [of[f"{k}_id"].values for k in "lr"]
                i, j, s = similar(*(_sparse(*(of[f"{k}_{c}"].as_buffer() for c in ("sizes", "t", "w"))) for k in "lr"), rare, threshold, same)
                for own, other, x, y in ((0, 1, i, j), *(() if same else ((1, 0, j, i),))):
                    place = np.empty(len(ids[other]), np.int64)
                    place[pc.sort_indices(ids[other]).to_numpy()] = np.arange(len(place))
                    order = np.lexsort((place[y], -np.round(s, 9), x))
                    x, y, c = x[order], y[order], s[order]
                    first = np.arange(len(x)) - np.searchsorted(x, x) < top
                    yield pa.RecordBatch.from_arrays([ids[own].take(pa.array(x[first])), ids[other].take(pa.array(y[first])), pa.array(c[first])], names=["a", "b", "cosine"])

    found = pairs.mapInArrow(best, f"a {kind}, b {kind}, cosine double")
    out = top_k(found, ["a"], top, [-F.round("cosine", 9), F.col("b")])
    return out.select(F.col("a").alias("doc1"), F.col("b").alias("doc2"), "cosine")


def _packed(batches):
    """The documents (id, t, w) of a part as one tile: a row of their ids, numbers of terms, terms
    and weights, with a term once in a document, since the bounds of ``similar`` hold for such."""
    held = [b for b in batches if b.num_rows]
    if held:
        docs = pa.Table.from_batches(held)
        ids, t, w = (docs[c].combine_chunks() for c in ("id", "t", "w"))
        key = np.repeat(np.arange(len(ids)) << 32, t.value_lengths().to_numpy(zero_copy_only=False)) + t.flatten().to_numpy(zero_copy_only=False)
        key, at = np.unique(key, return_inverse=True)
        w = np.bincount(at, w.flatten().to_numpy(zero_copy_only=False), len(key))
        made = [v.tobytes() for v in (np.bincount(key >> 32, minlength=len(ids)).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), w)]
        names = ["id", "sizes", "t", "w"]
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([v], pa.binary()) for v in made]], names=names)


def _sparse(sizes, t, w):
    """(starts, terms, weights) of the documents of a tile, one after the other."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int32))]), np.frombuffer(t, np.int32), np.frombuffer(w, np.float64)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)


def similar(l, r, rare: int, threshold: float, same: bool):
    """(i, j, cosine) of the pairs of two tiles of sparse unit vectors with a cosine at
    or above the threshold; terms up to ``rare`` are summed for all pairs. With ``same``
    the tiles are one, and no vector meets itself. The last terms, ``DENSE`` at most, are
    summed for all pairs too, as matrices; common ones are those between."""
    (ls, lt, lw), (rs, rt, rw) = l, r
    nl, nr = len(ls) - 1, len(rs) - 1
    owner = [np.repeat(np.arange(n), np.diff(s)) for s, n in ((ls, nl), (rs, nr))]
    last = max(int(lt.max(initial=rare)), int(rt.max(initial=rare)))
    line = max(rare, last - min(DENSE, TILE_ENTRIES // max(nl, nr, 1)))

    def dense(o, t, w, n):
        k = np.flatnonzero(t > line)
        return np.bincount(o[k] * (last - line) + t[k] - line - 1, w[k], n * (last - line)).reshape(n, last - line).astype(float, copy=False)

    matrix = dense(owner[1], rt, rw, nr).T
    # norms of the common parts, and the most that two of them give
    lc, rc = (np.sqrt(np.bincount(o, np.where((t > rare) & (t <= line), w * w, 0.0), n)) for o, t, w, n in ((owner[0], lt, lw, nl), (owner[1], rt, rw, nr)))
    order = np.argsort(rt, kind="stable")
    order = order[:np.searchsorted(rt[order], rare, "right")]
    names, first = np.unique(rt[order], return_index=True)
    ends, held, weight = np.append(first[1:], len(order)), owner[1][order], rw[order]
    # common terms of the right side by document, for the pairs that need them
    common = np.flatnonzero((rt > rare) & (rt <= line))
    cs = np.concatenate([[0], np.cumsum(np.bincount(owner[1][common], minlength=nr))])
    ct, cw = rt[common] - rare, rw[common]
    wide = line - rare + 1
    out, step = [], max(1, CHUNK_SCORES // max(1, nr))
    for lo in range(0, nl, step):
        hi = min(lo + step, nl)
        t, w, o = lt[ls[lo]:ls[hi]], lw[ls[lo]:ls[hi]], owner[0][ls[lo]:ls[hi]] - lo
        at = np.searchsorted(names, t)
        hit = np.flatnonzero((t <= rare) & (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == t)) if len(names) else at[:0]
        sizes = ends[at[hit]] - first[at[hit]]
        score, parts = (dense(o, t, w, hi - lo) @ matrix).reshape(-1), np.cumsum(sizes)
        for a, b in _slices(parts):
            spot = _spans(first[at[hit[a:b]]], sizes[a:b])
            score += np.bincount(np.repeat(o[hit[a:b]] * nr, sizes[a:b]) + held[spot], np.repeat(w[hit[a:b]], sizes[a:b]) * weight[spot], len(score))
        score = score.reshape(hi - lo, nr)
        if same:
            score[np.arange(hi - lo), np.arange(lo, hi)] = -2.0
        near = score + lc[lo:hi, None] * rc >= threshold - 1e-9
        for i in np.flatnonzero(near.any(1)):
            j = np.flatnonzero(near[i])
            mine = slice(ls[lo + i], ls[lo + i + 1])
            keep = (lt[mine] > rare) & (lt[mine] <= line)
            s = score[i, j]
            if keep.any():
                full = np.bincount(lt[mine][keep] - rare, lw[mine][keep], wide)
                sizes = cs[j + 1] - cs[j]
                spot = _spans(cs[j], sizes)
                s = s + np.bincount(np.repeat(np.arange(len(j)), sizes), full[ct[spot]] * cw[spot], len(j))
            good = (s >= threshold) & (s > 0)
            out.append((np.full(good.sum(), lo + i), j[good], s[good]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _slices(ends: np.ndarray):
    """Slices of spans with about ``CHUNK_SCORES`` places each, by the ends of the spans."""
    cuts = np.searchsorted(ends, np.arange(CHUNK_SCORES, ends[-1], CHUNK_SCORES)).tolist() if len(ends) else []
    edges = sorted({0, *cuts, len(ends)})
    return zip(edges, edges[1:])


DF_BINS = [(1, "1 document"), (5, "2-5 documents"), (10, "6-10 documents"), (50, "11-50 documents")]  # fixed values


def vocabulary_bins(model: DataFrame) -> DataFrame:
    return share(model.groupBy(band_le("doc_freq", DF_BINS, ">50 documents").alias("frequency_bin")).agg(F.count(F.lit(1)).alias("n_terms")), "n_terms", "percentage")


def vocabulary_report(model: DataFrame) -> DataFrame:
    v = F.col("vocabulary_size")
    out = model.agg(F.count(F.lit(1)).alias("vocabulary_size"), F.min("doc_freq").alias("min_doc_freq"), F.max("doc_freq").alias("max_doc_freq"),
                    F.avg("doc_freq").alias("avg_doc_freq"), F.min("idf_weight").alias("min_idf"), F.max("idf_weight").alias("max_idf"), F.avg("idf_weight").alias("avg_idf"))
    return out.withColumn("status", band_ge(v, [(100, "PASS - Good vocabulary"), (50, "WARNING - Small vocabulary")], "FAIL - Very small vocabulary"))


def sparsity(features: DataFrame, model: DataFrame, id_col="doc_id") -> DataFrame:
    per = features.groupBy(id_col).agg(F.count(F.lit(1)).alias("k"))
    a = per.agg(F.count(F.lit(1)).alias("n_documents"), F.sum("k").alias("non_zero_features"), F.avg("k").alias("avg_features_per_doc"), F.min("k").alias("min_features"), F.max("k").alias("max_features"))
    out = a.crossJoin(model.agg(F.count(F.lit(1)).alias("vocabulary_size")))
    d = F.col("non_zero_features") * 100.0 / (F.col("n_documents") * F.col("vocabulary_size"))
    return out.withColumns({"density_pct": d, "sparsity_pct": 100.0 - d})


def top_terms(features: DataFrame, k=20) -> DataFrame:
    t = features.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("tfidf_value").alias("avg_tfidf"), F.max("tfidf_value").alias("max_tfidf"))
    return t.orderBy(F.desc(F.round("avg_tfidf", 9)), "term").limit(k)


def text_quality(df: DataFrame, text="text", short=20) -> DataFrame:
    t = F.col(text)
    return df.agg(F.count(F.lit(1)).alias("total_docs"), F.count(t).alias("non_null"), tally(F.length(F.trim(t)) == 0).alias("empty_texts"),
                  tally(F.length(t) < short).alias("short_texts"), tally(t.rlike("[^a-zA-Z0-9 ]")).alias("non_alphanumeric"), F.avg(F.length(t)).alias("avg_length"))


def ngram_config_compare(df: DataFrame, configs=((1,), (1, 2), (1, 2, 3)), **cols) -> DataFrame:
    """Vocabulary size and occurrences per n-gram setting; the sizes are
    counted once and added up per setting."""
    s = ngram_stats(ngram_rows(df, grams=sorted({n for c in configs for n in c}), **cols))
    cells = F.array(*[F.struct(F.lit("+".join(map(str, c))).alias("config"), F.array(*[F.lit(n) for n in c]).alias("ns")) for c in configs])
    rows = s.select("n", "unique_ngrams", "total_occurrences", F.explode(cells).alias("c")).filter(F.array_contains("c.ns", F.col("n")))
    return rows.groupBy(F.col("c.config").alias("config")).agg(F.sum("unique_ngrams").alias("vocabulary_size"), F.sum("total_occurrences").alias("total_occurrences"))


def min_df_compare(df: DataFrame, min_dfs=(1, 2, 5, 10), **cols) -> DataFrame:
    m = tfidf_fit(df, **cols)
    cells = F.array(*[F.lit(k) for k in min_dfs])
    rows = m.select("doc_freq", "idf_weight", F.explode(cells).alias("min_df")).filter(F.col("doc_freq") >= F.col("min_df"))
    return rows.groupBy("min_df").agg(F.count(F.lit(1)).alias("vocabulary_size"), F.avg("idf_weight").alias("avg_idf"))
