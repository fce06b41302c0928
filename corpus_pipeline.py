"""Documents to packed training sequences: quality rules, near-dedup, substring dedup, decontamination, packing.

Every stage keeps the columns of documents (the last returns pieces) and works on all rows
of its predecessor: null and empty texts fail the base rules of the first stage; repeated
rows are judged alike, and of one doc_id all rows stay or go together in the stages that
drop by doc_id; rows without a doc_id are never dropped as copies or leaks; of equal texts
the smallest doc_id stays; texts of any length are taken whole; extra columns are passed on
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clipweave.llm import decontam, minhash, packing, quality, substring_dedup
from clipweave.llm.common import materialize, small_batches, without
from clipweave.llm.queries import table, word_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the perplexity bands of their language."""
    small_batches(spark)
    return quality.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked at 80 % of five-word shingles."""
    small_batches(spark)
    judged = minhash.near_duplicates(docs, percent=80, k=5)
    return without(docs, judged.filter("NOT kept").select("doc_id"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that start earlier; documents left without words go."""
    small_batches(spark)
    return substring_dedup.dedup_texts(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leak of a test item."""
    found = decontam.leaks(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    small_batches(spark)
    return packing.pack_documents(docs, word_bpe())


STAGES = [("quality_rules", quality_rules), ("minhash_near_dedup", near_dedup), ("substring_dedup", substrings), ("benchmark_decontamination", decontaminate), ("best_fit_packing", pack)]
#: Perplexity, alignment and packing are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
