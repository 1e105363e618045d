"""Queries of the text and vector operators."""

from pyspark.sql import functions as F

from cairn.catalog.registry import query
from cairn.functions.expr import rnd
from cairn.operators import neighbours as nb, text as tx, vectors as vx


def r(df, places, *cols):
    return df.select(*[rnd(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


W = r"WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM documents)"
G = W + """, g0 AS (SELECT doc_id, 1 AS n, unnest(w) AS ngram FROM d UNION ALL SELECT doc_id, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) FROM d WHERE len(w)>=2
 UNION ALL SELECT doc_id, 3, unnest(list_transform(range(1, len(w)-1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) FROM d WHERE len(w)>=3), g AS (SELECT doc_id, n, ngram, count(*) AS frequency FROM g0 GROUP BY 1,2,3)"""
C = W + """, c AS (SELECT doc_id, term, len(w) AS length, count(*) AS n FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY 1,2,3),
 m AS (SELECT term, count(*) AS doc_freq, ln((SELECT count(*) FROM documents)/count(*)) AS idf FROM c GROUP BY 1)"""


@query("tx01_text_clean", "SELECT doc_id, length(t) AS n FROM (SELECT doc_id, lower(trim(text)) AS t FROM documents) WHERE length(t)>0")
def _(t):
    return tx.text_clean(t.documents).select("doc_id", F.length("text").alias("n"))


@query("tx02_ngrams", G + " SELECT doc_id, n, count(*) AS ngrams, sum(frequency)::BIGINT AS total, max(frequency) AS most, min(ngram) AS first_ngram FROM g GROUP BY 1,2")
def _(t):
    return tx.ngrams(t.documents).groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("ngrams"), F.sum("frequency").alias("total"), F.max("frequency").alias("most"), F.min("ngram").alias("first_ngram"))


@query("tx03_ngram_stats", G + " SELECT n, count(DISTINCT ngram) AS unique_ngrams, sum(frequency)::BIGINT AS total_occurrences FROM g GROUP BY 1")
def _(t):
    return tx.ngram_stats(tx.ngram_rows(t.documents))


@query("tx03_top_ngrams", G + ", s AS (SELECT n, ngram, sum(frequency)::BIGINT AS frequency, count(*) AS doc_frequency FROM g GROUP BY 1,2) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY n ORDER BY frequency DESC, ngram) <= 20")
def _(t):
    return tx.top_ngrams(tx.ngrams(t.documents))


@query("tx04_tfidf_fit", C + " SELECT term, doc_freq, round(idf,9) AS idf_weight FROM m WHERE doc_freq>=3 AND doc_freq<=0.8*(SELECT count(*) FROM documents)")
def _(t):
    return r(tx.tfidf_fit(t.documents, min_df=3, max_df=0.8), 9, "idf_weight")


@query("tx04_tfidf_fit_options", C + " SELECT term, doc_freq, round(idf,9) AS idf_weight FROM m WHERE term NOT IN ('the','of','and') ORDER BY doc_freq DESC, term LIMIT 100")
def _(t):
    return r(tx.tfidf_fit(t.documents, top=100, stop_words=("the", "of", "and")), 9, "idf_weight")


@query("tx05_tfidf_transform", C + " SELECT doc_id, count(*) AS terms, round(sum(n/length),7) AS tf, round(sum(n/length*idf),7) AS tfidf, round(max(n/length*idf),8) AS most FROM c JOIN m USING (term) GROUP BY 1")
def _(t):
    f = tx.tfidf_transform(t.documents, tx.tfidf_fit(t.documents))
    return f.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), rnd(F.sum("tf"), 7).alias("tf"), rnd(F.sum("tfidf_value"), 7).alias("tfidf"), rnd(F.max("tfidf_value"), 8).alias("most"))


@query("tx05_tfidf_new_documents", C + r""", b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM benchmark), bc AS (SELECT item_id, term, len(w) AS length, count(*) AS n FROM (SELECT item_id, w, unnest(w) AS term FROM b) GROUP BY 1,2,3)
 SELECT item_id, term, round(n/length,9) AS tf, round(n/length*idf,9) AS tfidf_value FROM bc JOIN m USING (term)""")
def _(t):
    return r(tx.tfidf_transform(t.benchmark, tx.tfidf_fit(t.documents), "item_id"), 9, "tf", "tfidf_value")


@query("tx05_out_of_vocabulary", C + r""", b AS (SELECT item_id, unnest(string_split_regex(lower(text), '[ \t\n\r\f]+')) AS term FROM benchmark) SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM b JOIN m USING (term) WHERE doc_freq >= 40)""")
def _(t):
    return tx.out_of_vocabulary(t.benchmark, tx.tfidf_fit(t.documents, min_df=40), "item_id").select("item_id")


_DIST = {"euclidean": "list_distance(a.v,b.v)", "cosine": "1-list_cosine_similarity(a.v,b.v)", "manhattan": "list_sum(list_transform(list_zip(a.v,b.v), lambda p: abs(p[1]-p[2])))"}
_V = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
for _m, _e in _DIST.items():
    @query(f"tx06_vector_distance_{_m}", f"{_V}, p AS (SELECT a.vec_id AS target_id, b.vec_id AS reference_id, {_e} AS distance FROM v a JOIN v b ON a.vec_id<>b.vec_id) SELECT target_id, reference_id, round(distance,7) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY round(distance,9), reference_id) <= 3")
    def _(t, m=_m):
        return r(vx.vector_distance(t.embeddings, t.embeddings, "vec_id", "embedding", m), 7, "distance")

    @query(f"tx06_nearest_indexed_{_m}", f"{_V}, p AS (SELECT a.vec_id AS target_id, b.vec_id AS reference_id, {_e} AS distance FROM v a JOIN v b ON a.vec_id<>b.vec_id) SELECT target_id, reference_id, round(distance,7) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY round(distance,9), reference_id) <= 3")
    def _(t, m=_m):
        return r(nb.nearest_vectors(t.embeddings, t.embeddings, "vec_id", "embedding", m, cells=16), 7, "distance")


@query("tx06_nearest_approximate")
def _(t):
    return nb.nearest_vectors(t.embeddings, t.embeddings, "vec_id", "embedding", cells=32, approximate=True, probes=24)


@query("tx07_vector_normalize", _V + ", n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x*x))) AS n FROM v) SELECT vec_id, round(v[1]/n,8) AS first_value, round(list_sum(list_transform(v, lambda x: abs(x/n))),7) AS total FROM n")
def _(t):
    n = vx.vector_normalize(t.embeddings, "embedding")
    return n.select("vec_id", rnd(F.col("normalized")[0], 8).alias("first_value"), rnd(F.aggregate("normalized", F.lit(0.0), lambda s, x: s + F.abs(x)), 7).alias("total"))


_P = _V + ", p AS (SELECT a.vec_id AS id, 1-list_cosine_similarity(a.v,b.v) AS d FROM v a JOIN v b ON a.vec_id<>b.vec_id)"


@query("tx08_distance_stats", _P + " SELECT id AS vec_id, count(*) AS n, round(avg(d),8) AS avg_distance, round(min(d),8) AS min_distance, count(*) FILTER (d<0.5) AS neighbours FROM p GROUP BY 1")
def _(t):
    s = vx.distance_stats(t.embeddings, "vec_id", "embedding")
    return r(s.select("vec_id", "n", "avg_distance", "min_distance", "neighbours"), 8, "avg_distance", "min_distance")


@query("tx08_distance_bins", _P + " SELECT CASE WHEN d<.1 THEN 'Very close (<0.1)' WHEN d<.5 THEN 'Close (0.1-0.5)' WHEN d<1 THEN 'Moderate (0.5-1.0)' WHEN d<2 THEN 'Far (1.0-2.0)' ELSE 'Very far (>2.0)' END AS distance_bin, count(*) AS pairs FROM p GROUP BY 1")
def _(t):
    return vx.distance_bins(vx.distance_stats(t.embeddings, "vec_id", "embedding"))


@query("tx08_distance_summary", _P + " SELECT count(*) AS n_pairs, round(min(d),8) AS min_distance, round(max(d),8) AS max_distance, round(avg(d),8) AS avg_distance, round(stddev(d),8) AS std_distance, (SELECT round(avg(m),8) FROM (SELECT min(d) AS m FROM p GROUP BY id)) AS mean_nn_distance FROM p")
def _(t):
    s = vx.distance_summary(vx.distance_stats(t.embeddings, "vec_id", "embedding"))
    return r(s, 8, *s.columns[1:])


_SIM = C + """, f AS (SELECT doc_id, term, n/length*idf AS w FROM c JOIN m USING (term) WHERE idf>0 AND doc_freq>=2), nn AS (SELECT doc_id, sqrt(sum(w*w)) AS n FROM f GROUP BY 1), u AS (SELECT doc_id, term, w/n AS w FROM f JOIN nn USING (doc_id)),
 s AS (SELECT a.doc_id AS doc1, b.doc_id AS doc2, sum(a.w*b.w) AS cosine FROM u a JOIN u b ON a.term=b.term AND a.doc_id<>b.doc_id GROUP BY 1,2 HAVING sum(a.w*b.w)>=0.5)"""


@query("tx09_doc_similarity", _SIM + " SELECT doc1, doc2, round(cosine,7) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY doc1 ORDER BY round(cosine,9) DESC, doc2) <= 5")
def _(t):
    m = tx.tfidf_fit(t.documents, min_df=2)
    return r(tx.doc_similarity(tx.tfidf_transform(t.documents, m)), 7, "cosine")


@query("tx10_vocabulary_report", C + " SELECT count(*) AS vocabulary_size, min(doc_freq) AS min_doc_freq, max(doc_freq) AS max_doc_freq, round(avg(doc_freq),7) AS avg_doc_freq, round(min(idf),8) AS min_idf, round(max(idf),8) AS max_idf, round(avg(idf),8) AS avg_idf, CASE WHEN count(*)>=100 THEN 'PASS - Good vocabulary' WHEN count(*)>=50 THEN 'WARNING - Small vocabulary' ELSE 'FAIL - Very small vocabulary' END AS status FROM m")
def _(t):
    return r(r(tx.vocabulary_report(tx.tfidf_fit(t.documents)), 7, "avg_doc_freq"), 8, "min_idf", "max_idf", "avg_idf")


@query("tx10_vocabulary_bins", C + " SELECT CASE WHEN doc_freq<=1 THEN '1 document' WHEN doc_freq<=5 THEN '2-5 documents' WHEN doc_freq<=10 THEN '6-10 documents' WHEN doc_freq<=50 THEN '11-50 documents' ELSE '>50 documents' END AS frequency_bin, count(*) AS n_terms, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percentage FROM m GROUP BY 1")
def _(t):
    return tx.vocabulary_bins(tx.tfidf_fit(t.documents))


@query("tx10_sparsity", C + ", k AS (SELECT doc_id, count(*) AS k FROM c GROUP BY 1), a AS (SELECT count(*) AS n_documents, sum(k)::BIGINT AS non_zero_features, avg(k) AS av, min(k) AS min_features, max(k) AS max_features, (SELECT count(*) FROM m) AS vocabulary_size FROM k) SELECT n_documents, non_zero_features, round(av,7) AS avg_features_per_doc, min_features, max_features, vocabulary_size, round(100.0*non_zero_features/(n_documents*vocabulary_size),7) AS density_pct, round(100-100.0*non_zero_features/(n_documents*vocabulary_size),7) AS sparsity_pct FROM a")
def _(t):
    m = tx.tfidf_fit(t.documents)
    return r(tx.sparsity(tx.tfidf_transform(t.documents, m), m), 7, "avg_features_per_doc", "density_pct", "sparsity_pct")


@query("tx10_top_terms", C + ", f AS (SELECT term, n/length*idf AS v FROM c JOIN m USING (term)), a AS (SELECT term, count(*) AS n_docs, avg(v) AS av, max(v) AS mx FROM f GROUP BY 1) SELECT term, n_docs, round(av,8) AS avg_tfidf, round(mx,8) AS max_tfidf FROM a ORDER BY round(av,9) DESC, term LIMIT 20")
def _(t):
    return r(tx.top_terms(tx.tfidf_transform(t.documents, tx.tfidf_fit(t.documents))), 8, "avg_tfidf", "max_tfidf")


@query("tx11_text_quality", "SELECT count(*) AS total_docs, count(text) AS non_null, count(*) FILTER (length(trim(text))=0) AS empty_texts, count(*) FILTER (length(text)<20) AS short_texts, count(*) FILTER (regexp_matches(text,'[^a-zA-Z0-9 ]')) AS non_alphanumeric, round(avg(length(text)),7) AS avg_length FROM documents")
def _(t):
    return r(tx.text_quality(t.documents), 7, "avg_length")


@query("tx12_vector_quality", "SELECT count(*) AS total_vectors, count(*) FILTER (embedding IS NULL) AS null_vectors, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL))>0) AS vectors_with_null, count(*) FILTER (len(list_filter(embedding, lambda x: x<>0))=0) AS zero_vectors, min(len(embedding))::INT AS min_dimensions, max(len(embedding))::INT AS max_dimensions FROM embeddings")
def _(t):
    return vx.vector_quality(t.embeddings, "embedding")


@query("tx12_dimension_stats", "WITH l AS (SELECT generate_subscripts(embedding,1)::INT-1 AS dimension, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT dimension, round(avg(v),8) AS mean, round(stddev(v),8) AS std_dev, round(min(v),8) AS min, round(max(v),8) AS max FROM l GROUP BY 1")
def _(t):
    return r(vx.dimension_stats(t.embeddings, "embedding"), 8, "mean", "std_dev", "min", "max")


@query("tx13_ngram_configs", G + ", s AS (SELECT n, count(DISTINCT ngram) AS u, sum(frequency) AS f FROM g GROUP BY 1) SELECT '1' AS config, sum(u) FILTER (n<=1)::BIGINT AS vocabulary_size, sum(f) FILTER (n<=1)::BIGINT AS total_occurrences FROM s UNION ALL SELECT '1+2', sum(u) FILTER (n<=2)::BIGINT, sum(f) FILTER (n<=2)::BIGINT FROM s UNION ALL SELECT '1+2+3', sum(u)::BIGINT, sum(f)::BIGINT FROM s")
def _(t):
    return tx.ngram_config_compare(t.documents)


@query("tx13_min_df_configs", C + " SELECT k AS min_df, count(*) AS vocabulary_size, round(avg(idf),8) AS avg_idf FROM m, (SELECT unnest([1,2,5,10]) AS k) WHERE doc_freq>=k GROUP BY 1")
def _(t):
    return r(tx.min_df_compare(t.documents), 8, "avg_idf")


@query("tx13_distance_measures", " UNION ALL ".join(f"SELECT '{m}' AS measure, round(avg(distance),7) AS mean_nn_distance FROM (SELECT a.vec_id, min({e}) AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b ON a.vec_id<>b.vec_id GROUP BY 1)" for m, e in _DIST.items()))
def _(t):
    out = None
    for m in vx.MEASURES:
        d = vx.vector_distance(t.embeddings, t.embeddings, "vec_id", "embedding", m, 1).agg(F.lit(m).alias("measure"), rnd(F.avg("distance"), 7).alias("mean_nn_distance"))
        out = d if out is None else out.unionByName(d)
    return out
