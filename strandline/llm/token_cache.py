"""Token counts through a table of counts keyed by content digest and tokenizer digest.

Counting joins the digests of the documents with the stored ones; of the contents that are missing one copy is encoded, and
the new counts are appended to the table. Contents with several copies are found by their digests alone; only those few
are joined with the texts, so texts are not shuffled unless most contents have copies.

Defined cases: a null text is empty and has no tokens; a text of any length, also one long run of white space, is counted whole; repeated rows get the same count; an empty table leaves the cache as
it is; other columns are ignored. A cache that holds a key twice (two jobs at once) gives it once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, small

STORED = "content string, tokenizer string, n_tokens bigint"
SMALL_COPIES = 200_000


def version(path: str) -> str:
    """Digest of a vocabulary file."""
    with open(path, "rb") as file:
        return hashlib.sha256(path.rsplit(".", 1)[-1].encode() + b"\n" + file.read()).hexdigest()


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Counter:
    """Counts the tokens of texts as the library of the vocabulary file does.

    For a byte-level ``.json`` the merges run in tiktoken on ranks made from that file, with its added tokens as special
    strings, which is several times faster; texts with characters outside long-settled Unicode blocks, whose
    classes could differ between the libraries, go to the library itself, as do texts with a run of white space of ``LONG_RUN``
    characters, on which the other's splitting pattern runs out of stack.
    """

    LONG_RUN = 10_000
    LONG_SPACE = re.compile(r"\s{%d}" % LONG_RUN)

    SETTLED = re.compile("[^\x00-ʯͰ-ͳ΄-ϿЀ-ҁҊ-ӿ‐-‧‰-⁞₠-₵]")
    SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str) -> None:
        self.pieces = self.ranks = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        splitter, model = made.get("pre_tokenizer") or {}, made["model"]
        plain = made.get("normalizer") is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
        plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "end_of_word_suffix", "continuing_subword_prefix", "ignore_merges"))
        plain = plain and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in made["added_tokens"])
        if plain:
            # Ranks are read off the ids, so each merge must make a later id than the one before.
            merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
            plain = None not in merged and all(a < b for a, b in zip(merged, merged[1:]))
        if plain:
            import tiktoken

            letters = byte_letters()
            added = {t["content"]: t["id"] for t in made["added_tokens"]}
            ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
            self.ranks = tiktoken.Encoding("file", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens=added)

    def count(self, texts: list[str]) -> list[int]:
        if self.pieces is not None:
            return [len(ids) for ids in self.pieces.encode(texts, num_threads=1)]
        if self.ranks is None:
            return [len(self.library.encode(t, add_special_tokens=False).ids) for t in texts]
        encode = self.ranks.encode
        return [len(self.library.encode(t, add_special_tokens=False).ids if self._odd(t) else encode(t, allowed_special="all")) for t in texts]

    def _odd(self, text: str) -> bool:
        return self.SETTLED.search(text) is not None or len(text) >= self.LONG_RUN and self.LONG_SPACE.search(text) is not None


def _count_task(path: str, digest: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = None
    for batch in batches:
        counter = counter or Counter(path)
        if version(path) != digest:
            raise ValueError(f"{path} differs between machines")
        counts = counter.count(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("content"), pa.array([digest] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["content", "tokenizer", "n_tokens"]
        )


class Cache:
    """A table of counts at ``path``, a folder that all executors reach."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path

    def stored(self) -> DataFrame:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(self.path)

    def counts(self, docs: DataFrame, vocabulary: str) -> DataFrame:
        """``doc_id``, ``content``, ``n_bytes`` and ``n_tokens`` of every document; missing counts are made and stored first."""
        digest = version(vocabulary)
        text = F.coalesce(F.col("text"), F.lit(""))
        docs = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("content"), F.octet_length(text).cast("bigint").alias("n_bytes"))
        known = self.stored().where(F.col("tokenizer") == digest).select("content").distinct()
        number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        copies = docs.groupBy("content").agg(F.count("*").alias("copies"), F.min(number).alias("chosen")).where("copies > 1").select("content", "chosen")
        missing = docs if known.isEmpty() else docs.join(known, "content", "left_anti")
        one = missing.join(small(copies, SMALL_COPIES), "content", "left").where(F.col("chosen").isNull() | (F.col("chosen") == number))
        made = one.select("content", "text").mapInArrow(lambda b: _count_task(vocabulary, digest, b), STORED)
        # Rows that are equal in id and content are both encoded; the table gets one of them.
        made = made.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))
        made.write.mode("append").parquet(self.path)
        counted = self.stored().where(F.col("tokenizer") == digest).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
        # Written, so that the join reads tables on both sides and Spark can split the copies of one content.
        counted = Shared(self.spark).write(counted, "counts")
        return docs.select("doc_id", "content", "n_bytes").join(counted, "content")


def report(docs: DataFrame, vocabulary: str, path: str, limit: int = 512) -> DataFrame:
    """The columns of the registered query."""
    counted = Cache(docs.sparkSession, path).counts(docs, vocabulary)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
