"""Documents made ready for training, stage by stage; each stage calls one operator of keyweave.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.llm import bpe, decontaminate, line_dedup, quality_rules, simhash_dedup
from keyweave.llm.common import Stash, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of whole lines that came before; one that consisted of nothing else goes. n_chars follows the text."""
    left = line_dedup.remove_repeats(docs)
    gone = F.size(left.columns[-1])
    left = left.where((gone == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    changed = F.when(gone > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.select(*(changed.alias(c) if c == "n_chars" else c for c in docs.columns))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id."""
    return simhash_dedup.keep_first(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the documents as token ids."""
    codes = bpe.encode(docs).withColumnRenamed("id", "doc_id")
    return codes.select("doc_id", "n_tokens", "ids", F.decode("decoded", "UTF-8").alias("decoded"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_quality),
    ("line_dedup", first_lines),
    ("simhash_near_dedup", first_copies),
    ("decontamination", no_benchmark),
    ("bpe_encoding", encoded),
]

#: SQL can express neither the fingerprints nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the documents, each written as Parquet and read again by the next."""
    stash = Stash(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash.keep(stage(spark, docs, sf_dir), name)
    return docs
