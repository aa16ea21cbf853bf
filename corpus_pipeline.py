"""The corpus pipeline: from ``documents`` to token digests, each stage on all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns they got. Defined cases are those of the operators: documents with a null text end at the
first stage (they have no language), empty tables stay empty, and extra columns travel along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import bpe, decontaminate, language_id, ngram_join, suffix_dedup
from strandline.llm.catalog import vocabulary
from strandline.llm.common import Shared, table


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language is in doubt, go."""
    return language_id.accepted(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere are cut out."""
    return suffix_dedup.without_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of what is left."""
    return bpe.report(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", with_language),
    ("n-gram Jaccard join", without_near_copies),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding", tokenised),
]

# Language scores and token ids are beyond SQL; a test compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    shared = Shared(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = shared.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            shared.drop(f"stage-{k - 1}")
        docs = made
    return docs
