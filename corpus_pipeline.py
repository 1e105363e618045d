"""From raw documents to packed sequences: toxicity, SimHash near-dedup,
substring dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
it kept, and returns the columns of ``documents``; the last one returns pieces
of sequences. Null texts count as empty ones: they are clean, alike, and packed
as one end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import cut, read
from cairn.llm.op1_simhash import drop_near_copies
from cairn.llm.op5_packing import pack
from cairn.llm.op10_benchmark import decontaminate

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, fitted on the labelled training rows, doesn't reject."""
    from cairn.llm.op9_toxicity import fit, score

    model = fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return score(docs, model).filter("predicted = 0").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of chunks that an earlier document holds."""
    from cairn.llm.op7_chunks import remove_repeats

    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of the benchmark."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark")).filter(F.size("hits") == 0).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination),
          ("packing", packing)]

#: SQL has neither the fingerprints nor the tokenizer; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
