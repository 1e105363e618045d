"""What crosses the network for counts per document: texts, not their n-grams or terms."""

from pyspark.sql import functions as F

from cairn.operators.text import ngrams, term_counts
from cairn.plans.skew import parts_for


def docs(spark):
    return spark.createDataFrame([(1, "a b a b"), (1, "a b"), (2, None), (None, "c c"), (None, "c"), (3, "")], "doc_id long, text string")


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_one_exchange_for_counts_per_document(spark):
    per = ngrams(docs(spark)).groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("ngrams"), F.sum("frequency").alias("total"))
    assert {tuple(r) for r in per.collect()} == {(1, 1, 2, 6), (1, 2, 2, 4), (1, 3, 2, 2), (None, 1, 1, 3), (None, 2, 1, 1)}
    assert exchanges(per) == 1
    terms = term_counts(docs(spark))
    assert {tuple(r) for r in terms.collect()} == {(1, 4, "a", 2), (1, 4, "b", 2), (1, 2, "a", 1), (1, 2, "b", 1), (None, 2, "c", 2), (None, 1, "c", 1)}
    assert exchanges(terms) == 1


def test_parts_grow_with_the_text(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(64).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    assert parts_for(df, "t") == max(cores, 16) and parts_for(df.limit(0), "t") == cores
