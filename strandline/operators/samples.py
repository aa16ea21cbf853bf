"""Training samples from sequences: masked elements, segment pairs, padded batches.

Random choices come from md5 of a seed, the sequence and the position, so they need no state, survive a recomputed task
and are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.count_detectors import with_context
from strandline.operators.sequences import truncate_or_pad
from strandline.operators.splits import by_length
from strandline.operators.vocabulary import EOS, MASK, PAD, SOS
from strandline.plans.lookup import lookup_join
from strandline.plans.running import shuffled
from strandline.session import written

# Shares of the chosen elements that become the mask or a random entry; the rest stay unchanged.
MASK_SHARE, RANDOM_SHARE = 0.8, 0.1


def uniform(seed: int | str, *parts: Column, word: int = 0) -> Column:
    """Number in [0, 1) from md5 of the seed and the parts; ``word`` picks one of its four 32-bit words."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mask_elements(
    encoded: DataFrame, ratio: float, vocab_size: int, seed: int, predict: bool = False, duration: str | None = None
) -> DataFrame:
    """Masked copy of every sequence: ``seq_id, pos, input_id, label_id`` with a start entry at position 0.

    An element is chosen with probability ``ratio``; its label is its true id, other labels are 0. Chosen elements are
    masked, replaced at random or left, and always masked when predicting. A chosen duration becomes 0.
    """
    draw = uniform(seed, F.col("seq_id"), F.col("pos"))
    chosen = draw < ratio
    kind = draw / ratio
    random_id = F.floor(uniform(seed, F.col("seq_id"), F.col("pos"), word=1) * vocab_size).cast("long")
    true_id = F.col("idx").cast("long")
    masked = F.lit(MASK).cast("long")
    replaced = masked if predict else (
        F.when(kind < MASK_SHARE, masked).when(kind < MASK_SHARE + RANDOM_SHARE, random_id).otherwise(true_id)
    )
    columns = [
        "seq_id", (F.col("pos") + 1).alias("pos"), F.when(chosen, replaced).otherwise(true_id).alias("input_id"),
        F.when(chosen, true_id).otherwise(F.lit(PAD).cast("long")).alias("label_id"),
    ]
    start = [
        "seq_id", F.lit(0).cast("long").alias("pos"), F.lit(SOS).cast("long").alias("input_id"), F.lit(PAD).cast("long").alias("label_id"),
    ]
    if duration:
        value = F.col(duration).cast("double")
        columns += [
            F.when(chosen, 0.0).otherwise(value).alias("input_time"), F.when(chosen, value).otherwise(0.0).alias("label_time"),
        ]
        start += [F.lit(0.0).alias("input_time"), F.lit(0.0).alias("label_time")]
    opened = encoded.filter(F.col("pos") == 0).select(*start)
    return encoded.select(*columns).unionByName(opened)


def mask_keys(elements: DataFrame, vocab: DataFrame, ratio: float, vocab_size: int, seed: int) -> DataFrame:
    """:func:`mask_elements` on key texts, for models that read the text of a key."""
    draw = uniform(seed, F.col("seq_id"), F.col("pos"))
    chosen, kind = draw < ratio, draw / ratio
    random_id = F.floor(uniform(seed, F.col("seq_id"), F.col("pos"), word=1) * vocab_size).cast("long")
    swaps = elements.withColumn(
        "_idx", F.when(chosen & (kind >= MASK_SHARE) & (kind < MASK_SHARE + RANDOM_SHARE), random_id)
    )
    named = lookup_join(swaps, vocab.select(F.col("idx").alias("_idx"), F.col("key").alias("_swap")), ["_idx"], "left", F.col("pos"))
    masked = F.when(chosen & (kind < MASK_SHARE), F.lit("<mask>")).otherwise(F.coalesce("_swap", "key"))
    return named.select(
        "seq_id", (F.col("pos") + 1).alias("pos"), masked.alias("input_key"), F.when(chosen, F.col("key")).otherwise("<pad>").alias("label_key")
    )


def mask_each_position(elements: DataFrame) -> DataFrame:
    """One sample per element with that element masked: its neighbours stand for the copy of the sequence."""
    return with_context(elements).select("seq_id", "pos", "left_key", "right_key", F.col("key").alias("label_key"))


def segment_pairs(encoded: DataFrame, seq_len: int, vocab_size: int, seed: int, ratio: float = 0.15) -> DataFrame:
    """Pairs of sequence halves: the own second half or, for half of the sequences, another sequence's.

    ``seq_id, is_next, place, segment, input_id, label_id``: start, first half, end, second half, end; cut to ``seq_len``.
    """
    lengths = encoded.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = written(shuffled(lengths, "seq_id", seed, "rank", total="total"))
    partner = F.floor(uniform(seed, F.col("seq_id"), word=1) * F.col("total")).cast("long") + 1
    chosen = ranked.withColumn("is_next", (uniform(seed, F.col("seq_id")) > 0.5).cast("long")).withColumn(
        "second", F.when(F.col("is_next") == 1, F.col("rank")).otherwise(partner)
    )
    half = F.floor(F.col("n") / 2)
    seconds = ranked.select(F.col("rank").alias("second"), F.col("seq_id").alias("second_id"), (F.col("n") - half).alias("n2"), half.alias("from2"))
    pairs = chosen.select("seq_id", "is_next", half.alias("n1"), "second").join(seconds, "second")
    first = encoded.filter(F.col("pos") < seq_len).join(pairs.select("seq_id", "is_next", "n1"), "seq_id").filter(F.col("pos") < F.col("n1")).select(
        "seq_id", "is_next", (F.col("pos") + 1).alias("place"), F.lit(1).cast("long").alias("segment"), "idx"
    )
    tail = pairs.select("seq_id", "is_next", "n1", "second_id", "from2")
    second = encoded.withColumnRenamed("seq_id", "second_id").join(tail, "second_id").filter(F.col("pos") >= F.col("from2")).select(
        "seq_id", "is_next", (F.col("n1") + 2 + F.col("pos") - F.col("from2")).alias("place"), F.lit(2).cast("long").alias("segment"), "idx"
    )
    words = first.unionByName(second).filter(F.col("place") < seq_len)
    draw = uniform(seed, F.col("seq_id"), F.col("place"), word=2)
    kind, hit = draw / ratio, draw < ratio
    random_id = F.floor(uniform(seed, F.col("seq_id"), F.col("place"), word=3) * vocab_size).cast("long")
    true_id = F.col("idx").cast("long")
    masked = words.select(
        "seq_id", "is_next", "place", "segment",
        F.when(hit & (kind < MASK_SHARE), F.lit(MASK).cast("long")).when(hit & (kind < MASK_SHARE + RANDOM_SHARE), random_id).otherwise(true_id).alias("input_id"),
        F.when(hit, true_id).otherwise(F.lit(PAD).cast("long")).alias("label_id"),
    )
    marks = pairs.select(
        "seq_id", "is_next",
        F.explode(F.array(
            _mark(F.lit(0), 1, SOS), _mark(F.col("n1") + 1, 1, EOS), _mark(F.col("n1") + 2 + F.col("n2"), 2, EOS)
        )).alias("m"),
    ).select("seq_id", "is_next", "m.*", F.lit(PAD).cast("long").alias("label_id")).filter(F.col("place") < seq_len)
    return masked.unionByName(marks)


def _mark(at: Column, segment: int, idx: int) -> Column:
    return F.struct(at.cast("long").alias("place"), F.lit(segment).cast("long").alias("segment"), F.lit(idx).cast("long").alias("input_id"))


def padded_batches(framed: DataFrame, batch_size: int, seq_len: int) -> DataFrame:
    """``seq_id, batch, width, ids``: sequences sorted by length, cut in batches and padded to the longest of theirs.

    ``framed`` is ``seq_id, ids, n`` with ``ids`` already at most ``seq_len`` long.
    """
    placed = by_length(framed.select("seq_id", "n")).withColumn("batch", F.floor((F.col("place") - 1) / batch_size).cast("long"))
    widths = placed.groupBy("batch").agg(F.least(F.max("n"), F.lit(seq_len)).alias("width"))
    joined = framed.join(placed.select("seq_id", "batch"), "seq_id").join(widths, "batch")
    fitted = truncate_or_pad(F.col("ids"), F.col("width").cast("int"), F.lit(PAD).cast("long"))
    return joined.select("seq_id", "batch", "width", fitted.alias("ids"))
