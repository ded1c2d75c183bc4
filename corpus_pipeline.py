"""The corpus pipeline: toxic and poor documents go, near copies and repeated strings go, the rest is packed.

Each stage takes ``(spark, docs, sf_dir)`` and returns what the next one gets, written as Parquet and read again. All
but the last keep the columns of ``documents``. A null ``doc_id`` is kept, but never compared with other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsdesk.llm import quality, toxicity
from newsdesk.llm.ngram_jaccard import one_of_each
from newsdesk.llm.packing import packed
from newsdesk.llm.storage import documents, ship_package, table, written
from newsdesk.llm.suffix_dedup import cleaned


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not flag."""
    return toxicity.kept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of their 5-word shingles."""
    ship_package(spark)
    return one_of_each(docs, n=5, num=80, den=100)


def no_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less every string of 250 bytes, and every passage of over 50 words, that starts elsewhere too."""
    ship_package(spark)
    return cleaned(docs, length=250, words=51)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents in sequences of 2048 tokens."""
    ship_package(spark)
    return packed(docs, "word_bpe_49k.json")


STAGES = [
    ("toxicity", clean_language),
    ("quality", good_text),
    ("near_copies", one_of_near_copies),
    ("repeated_strings", no_repeated_strings),
    ("packing", sequences),
]

ORACLE_SQL = None
"""SQL cannot express the trained classifiers; ``tests/llm`` holds the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
