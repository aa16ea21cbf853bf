"""Key dictionaries: build, encode, decode, extend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.plans.lookup import lookup_join
from strandline.plans.running import numbered, ranged, value_blocks

# Reserved entries of the dictionary and their indexes.
SPECIALS = {"<pad>": 0, "<unk>": 1, "<eos>": 2, "<sos>": 3, "<mask>": 4}
PAD, UNK, EOS, SOS, MASK = 0, 1, 2, 3, 4
# Labels of the next-event encoder.
LABEL_SPECIALS = {"#OOV": 0, "#Pad": 1}


def key_counts(elements: DataFrame, key: str = "key") -> DataFrame:
    return elements.groupBy(key).agg(F.count(F.lit(1)).alias("freq"))


def build_vocabulary(elements: DataFrame, min_freq: int = 1, max_size: int | None = None) -> DataFrame:
    """``key, idx, freq`` of all keys: most frequent first, ties in key order, after the reserved entries."""
    return build_from_counts(key_counts(elements), min_freq, max_size)


def build_from_counts(counts: DataFrame, min_freq: int = 1, max_size: int | None = None) -> DataFrame:
    """:func:`build_vocabulary` from ``key, freq``."""
    usable = counts.filter(
        (F.col("key") != "") & ~F.col("key").isin(*SPECIALS) & (F.col("freq") >= max(min_freq, 1))
    )
    ranked = by_frequency(usable, "_rank")
    if max_size is not None:
        ranked = ranked.filter(F.col("_rank") <= max_size)
    words = ranked.select("key", (F.col("_rank") + len(SPECIALS) - 1).alias("idx"), "freq")
    return special_rows(counts).unionByName(words)


def by_frequency(counted: DataFrame, out: str) -> DataFrame:
    """Number keys by frequency descending, then key.

    The blocks are even ranges of that order: a large dictionary has very many keys of the same low frequency, and they may
    begin alike.
    """
    falling = ranged(counted.withColumn("_less", -F.col("freq")), ["_less", "key"])
    return numbered(falling, ["_less", "key"], F.col("_range"), out).drop("_less", "_range")


def special_rows(like: DataFrame) -> DataFrame:
    spark = like.sparkSession
    return spark.createDataFrame([(k, i, 0) for k, i in SPECIALS.items()], "key string, idx bigint, freq bigint")


def encode(elements: DataFrame, vocab: DataFrame, default: int = UNK) -> DataFrame:
    """Add ``idx``; keys outside the dictionary get ``default``."""
    spread = F.col("pos") if "pos" in elements.columns else None
    found = lookup_join(elements, vocab.select("key", "idx"), ["key"], "left", spread)
    return found.withColumn("idx", F.coalesce("idx", F.lit(default).cast("long")))


def frame_sequences(
    encoded: DataFrame, seq_len: int, with_sos: bool = False, with_eos: bool = False
) -> DataFrame:
    """``seq_id, ids, n``: ids with optional start/end entries, padded or cut to ``seq_len``; ``n`` before that."""
    lengths = encoded.groupBy("seq_id").agg(
        (F.count(F.lit(1)) + int(with_sos) + int(with_eos)).alias("n"),
        F.array_sort(
            F.collect_list(F.when(F.col("pos") < seq_len, F.struct("pos", "idx")))
        ).alias("_e"),
    )
    ids = F.col("_e.idx")
    if with_sos:
        ids = F.concat(F.array(F.lit(SOS).cast("long")), ids)
    if with_eos:
        ids = F.when(F.col("n") - int(with_sos) - 1 <= seq_len, F.concat(ids, F.array(F.lit(EOS).cast("long")))).otherwise(ids)
    padded = F.slice(F.concat(ids, F.array_repeat(F.lit(PAD).cast("long"), seq_len)), 1, seq_len)
    return lengths.select("seq_id", padded.alias("ids"), "n")


def decode(ids: DataFrame, vocab: DataFrame, skip_pad: bool = False) -> DataFrame:
    """Add ``key`` to rows holding ``idx``; an index outside the dictionary reads ``<idx>``."""
    kept = ids.filter(F.col("idx") != PAD) if skip_pad else ids
    found = lookup_join(kept, vocab.select("idx", "key"), ["idx"], "left", F.col("pos") if "pos" in ids.columns else None)
    return found.withColumn("key", F.coalesce("key", F.concat(F.lit("<"), F.col("idx").cast("string"), F.lit(">"))))


def extend_vocabulary(vocab: DataFrame, elements: DataFrame) -> DataFrame:
    """Append unseen keys, most frequent first, after the largest index."""
    fresh = key_counts(elements).filter(F.col("key") != "").join(vocab.select("key"), "key", "left_anti")
    top = vocab.agg(F.max("idx")).first()[0]
    added = by_frequency(fresh, "_rank").select("key", (F.col("_rank") + top).alias("idx"), "freq")
    return vocab.unionByName(added)


def first_seen_vocabulary(elements: DataFrame, order_col: str, offset: int) -> DataFrame:
    """``key, idx`` numbered by first appearance, starting at ``offset``."""
    seen = elements.groupBy("key").agg(F.min(order_col).alias("_first"))
    ranked = numbered(seen, ["_first", "key"], value_blocks("_first"), "_rank")
    return ranked.select("key", (F.col("_rank") + offset - 1).alias("idx"))


def unknown_count(elements: DataFrame, vocab: DataFrame) -> DataFrame:
    """How many elements have no dictionary entry. Counted per key first, so hot keys cost one row."""
    counted = key_counts(elements)
    found = counted.join(vocab.select("key", "idx"), "key", "left")
    return found.agg(
        F.sum("freq").alias("elements"),
        F.coalesce(F.sum(F.when(F.col("idx").isNull(), F.col("freq"))), F.lit(0)).cast("long").alias("unknown"),
    )
