"""Corpus pipeline: quality rules, near-dedup, substring dedup, secret scan, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import table
from cairn.llm.credentials import redact
from cairn.llm.packing import pack, word_lengths
from cairn.llm.quality import keep
from cairn.llm.simhash import drop_near_duplicates
from cairn.llm.substring import drop_repeats
from cairn.sources.scratch import discard, passing


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return keep(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages that a document with a smaller id has."""
    return recount(drop_repeats(docs))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the values of secrets replaced."""
    return recount(redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document."""
    return pack(word_lengths(docs))


def recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("secret scan", secret_stage),
    ("packing", packing_stage),
]

#: The learned, iterative and byte-level stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *first, last = (stage for _, stage in STAGES)
    for stage in first:
        with passing() as kept:
            later = kept(stage(spark, docs, sf_dir))
        discard(docs)
        docs = later
    return last(spark, docs, sf_dir)
