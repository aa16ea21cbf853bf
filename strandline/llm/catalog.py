"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, kd_search, language_id, merkle, ngram_join, oracle, simhash, suffix_dedup, token_cache, url_rules, warc_zip, whitening
from .common import Shared, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_chat_formatting", oracle.CHAT)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one of control strings only, formatted and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.report(turns.unionByName(more))


@query("op2_suffix_array_dedup", oracle.REPEATS)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes covered by 200-byte strings that also start elsewhere, cut out of every document."""
    return suffix_dedup.report(table(spark, folder, "documents"))


@query("op3_exact_topk_search", oracle.TOP_K)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best partners of every twentieth vector by integer inner product."""
    return kd_search.top_k(table(spark, folder, "embeddings"))


@query("op4_ngram_jaccard_join", oracle.JACCARD)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return ngram_join.linked(table(spark, folder, "documents"))


@query("op5_bpe_encoding")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's tokens and of their decoding."""
    return bpe.report(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Languages by a model of three quarters of the documents."""
    return language_id.report(table(spark, folder, "documents"))


@query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document through a new cache table."""
    path = Shared(spark).path("token-cache")
    return token_cache.report(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), path)


@query("op8_warc_packages", oracle.WARC)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as WARC records in ZIP packages and read back by ranges."""
    return warc_zip.report(table(spark, folder, "pages"))


@query("op9_benchmark_decontamination", oracle.CONTAMINATION)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside occurrences of 13-word benchmark windows."""
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_url_filters", oracle.URLS)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on every page's URL."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic"))
    return url_rules.judged(table(spark, folder, "pages"), labels)


@query("op11_document_fingerprints", oracle.FINGERPRINTS)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edits, and classes of documents with fingerprints within 5 of 120 bits."""
    return simhash.report(table(spark, folder, "documents"))


@query("op12_merkle_manifest", oracle.MERKLE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of all documents, and the check of a copy that was tampered with."""
    return merkle.report(table(spark, folder, "documents"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector in the whitened first four components."""
    return whitening.report(table(spark, folder, "embeddings"))
