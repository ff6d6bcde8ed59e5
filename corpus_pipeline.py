"""From raw documents to packed training windows: five stages, each one operator of firnlake.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firnlake.llm import dart_minhash, mixing, packing, suffix_dedup, toxicity
from firnlake.llm.common import in_small_batches, stored, table

# Target mixture: languages by weight, domains and sources alike; no document twice.
WEIGHTS = {"domain": {"*": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "*": 1}, "source": {"*": 1}}
SHARE = 0.8  # tokens to keep, so that oversized sources give way
SEED = 20
PASSAGE = 51  # words: repeated passages of over 50 words go, besides op6's repeated strings


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are not judged toxic."""
    in_small_batches(spark)
    return toxicity.without_toxic(docs, table(spark, folder, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each near-duplicate class."""
    in_small_batches(spark)
    return dart_minhash.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the byte strings and the passages of over 50 words that occur at several places."""
    in_small_batches(spark)
    return suffix_dedup.remove_repeats(docs, words=PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents mixed to the target weights of domains, languages and sources."""
    return mixing.mix(docs, WEIGHTS, SHARE, mixing.source_domain(), max_epochs=1, seed=SEED).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents, placed in training windows."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

ORACLE_SQL = None  # learned scores, hashing and tokenising have no SQL form


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
