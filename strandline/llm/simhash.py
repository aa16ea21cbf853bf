"""SimHash fingerprints of documents, and classes of documents whose fingerprints lie within a Hamming radius; DataFrame operations only.

Fingerprint: the terms of a text are its runs of five words (all its words, if fewer). A term's hash has ``PARTS`` parts of 30 bits,
made from its words' checksums; each occurrence of a term votes for or against every bit, so a term weighs as much as it is frequent,
and a bit is set where the votes for it outnumber those against. The votes of two bits are counted in one long: a text has fewer than
2^30 terms.

Radius search by permuted block tables: the bits are cut in ``blocks`` blocks, and a table stands for each choice of ``blocks - radius`` of
them. Fingerprints within the radius differ in at most ``radius`` blocks, so they agree in some table's blocks and meet there. Only
different fingerprints are searched; copies share one. The tables' keys hold ``BITS * (blocks - radius) / blocks`` bits, so unrelated
fingerprints rarely meet (34 bits for the parameters here).

Defined cases: null, empty and wordless texts have no terms and the fingerprint of zeros; a text of any length is read whole; documents
follow each other by id, those without id first, equal ids by the digest of their text; rows equal in id and text are one document to
the order and come back as often as they were given; the only document is its own next; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, placed, small
from .components import components

WORDS, PARTS, PART_BITS = 5, 4, 30
BITS = PARTS * PART_BITS
HALF = 2 * PART_BITS
PRIME = (1 << 31) - 1
LANES = 1 | 1 << PART_BITS
PART = (1 << PART_BITS) - 1
RADIUS, BLOCKS = 5, 7
SMALL_BUCKETS = 200_000
WHITE = " \t\n\x0b\f\r"


def factor(part: int, word: int) -> int:
    """Odd multiplier under 2^28 of a word of a term, or the added number of a part (``word`` = -1): leading digits of an md5."""
    return int(hashlib.md5(f"{part}/{word}".encode()).hexdigest()[:7], 16) | 1


def word_sums(text: Column) -> Column:
    """Checksums of the words of a text."""
    bare = F.btrim(text, F.lit(WHITE))
    words = F.when(bare != "", F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    return F.transform(words, lambda w: F.crc32(w))


def voted(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` (unique) and the halves ``f0``, ``f1`` of the fingerprint of each text."""
    summed = texts.select(*keys, word_sums(F.col(text)).alias("_c"))
    # A text without words has one empty term, whose hash is 0 and sets no bit.
    terms = summed.select(*keys, "_c", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_c") - WORDS, F.lit(0)))).alias("_at"))
    word = [F.coalesce(F.get("_c", F.col("_at") + j), F.lit(0).cast("long")) for j in range(WORDS)]
    linear = [sum((w * F.lit(factor(p, j)) for j, w in enumerate(word[1:], 1)), word[0] * F.lit(factor(p, 0))) % F.lit(PRIME) for p in range(PARTS)]
    hashed = terms.select(*keys, *[h.alias(f"_h{p}") for p, h in enumerate(linear)])
    part = [((F.col(f"_h{p}") + F.lit(factor(p, -1))) * F.col(f"_h{p}") % F.lit(PRIME)).bitwiseAND(F.lit(PART)) for p in range(PARTS)]
    halves = [part[2 * k] + F.shiftleft(part[2 * k + 1], PART_BITS) for k in range(PARTS // 2)]
    votes = hashed.select(*keys, *[h.alias(f"_x{k}") for k, h in enumerate(halves)])
    lane = [F.sum(F.shiftright(f"_x{k}", i).bitwiseAND(F.lit(LANES))).alias(f"_v{k}_{i}") for k in range(PARTS // 2) for i in range(PART_BITS)]
    counted = votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *lane)

    def half(k: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(PART_BITS):
            sums = F.col(f"_v{k}_{i}")
            out = out + F.when(sums.bitwiseAND(F.lit(PART)) * 2 > F.col("_n"), F.lit(1 << i)).otherwise(F.lit(0))
            out = out + F.when(F.shiftright(sums, PART_BITS) * 2 > F.col("_n"), F.lit(1 << (i + PART_BITS))).otherwise(F.lit(0))
        return out

    return counted.select(*keys, half(0).alias("f0"), half(1).alias("f1"))


def shown(f0: Column, f1: Column) -> Column:
    """A fingerprint as hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(f), HALF // 4, "0") for f in (f0, f1)]))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.lit(1.0) - distance(a0, a1, b0, b1) / F.lit(float(BITS))


def in_order(docs: DataFrame, shared: Shared) -> DataFrame:
    """A row for each document: ``key``, ``doc_id``, ``n_chars``, ``copies``, ``pos`` and, of the document before, ``before`` (its key)
    and ``asked`` (the characters that its edit takes from this one); ``n`` is the number of documents."""
    ids = docs.select("doc_id", F.col("_key").alias("key"), F.length("text").cast("long").alias("n_chars"))
    ids = shared.write(ids, "ids").groupBy("doc_id", "key", "n_chars").agg(F.count("*").alias("copies"))
    numbered = placed(ids.withColumn("g", F.lit("")), [F.col("doc_id").asc_nulls_first(), F.col("key").asc()], shared, "order").drop("g")
    numbered = shared.write(numbered, "numbered")
    earlier = numbered.select(F.expr("(pos + 1) % n").alias("pos"), F.col("key").alias("before"), F.expr("n_chars div 4").alias("asked"))
    return shared.write(numbered.join(earlier, "pos"), "follows")


def edited_texts(docs: DataFrame, order: DataFrame, shared: Shared) -> DataFrame:
    """``key``, ``text`` and ``edited``: the last quarter of each text replaced by as much of the next document's beginning."""
    texts = docs.select(F.col("_key").alias("key"), "text")
    if order.where("copies > 1").limit(1).count():
        texts = texts.dropDuplicates(["key"])
    follows = texts.join(order.select("key", "pos", "n_chars", "before", "asked"), "key")
    heads = follows.select(F.col("before").alias("key"), F.left("text", F.col("asked").cast("int")).alias("head"))
    whole = follows.join(heads, "key")
    kept = F.left("text", F.expr("cast(n_chars - n_chars div 4 as int)"))
    return whole.select("pos", "text", F.concat(kept, "head").alias("edited"))


def prints(docs: DataFrame, order: DataFrame, shared: Shared) -> DataFrame:
    """``pos``, ``edited_sha256`` and both fingerprints' halves: ``f0``, ``f1``, ``e0``, ``e1``."""
    both = edited_texts(docs, order, shared)
    # One pass over the texts: the text itself (0) and the edited one (1), whose digest travels with its key.
    each = both.select("pos", F.posexplode(F.array("text", "edited")).alias("kind", "body"))
    each = each.select("pos", "kind", F.when(F.col("kind") == 1, F.sha2("body", 256)).alias("edited_sha256"), "body")
    made = shared.write(voted(each, ["pos", "kind", "edited_sha256"], "body"), "votes")
    own = made.where("kind = 0").select("pos", "f0", "f1")
    return own.join(made.where("kind = 1").select("pos", "edited_sha256", F.col("f0").alias("e0"), F.col("f1").alias("e1")), "pos")


def tables_of(radius: int, blocks: int) -> Column:
    """The block tables as an array of masks: a table for each choice of ``blocks - radius`` of the blocks that the bits are cut in."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    low = (1 << HALF) - 1
    masks = [sum((1 << edges[b + 1]) - (1 << edges[b]) for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m & low).alias("m0"), F.lit(m >> HALF).alias("m1")) for t, m in enumerate(masks)])


def dealt(marks: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``marks`` (``id, f0, f1``) once in each table: ``t`` and, in ``k0, k1``, the bits of the table's blocks."""
    rows = marks.select("id", "f0", "f1", F.explode(tables_of(radius, blocks)).alias("_m"))
    return rows.select(F.col("_m.t").alias("t"), F.col("f0").bitwiseAND(F.col("_m.m0")).alias("k0"), F.col("f1").bitwiseAND(F.col("_m.m1")).alias("k1"), "id", "f0", "f1")


BUCKET = ["t", "k0", "k1"]


def near(radius: int) -> Column:
    return distance(F.col("f0"), F.col("f1"), F.col("g0"), F.col("g1")) <= radius


def classes(marks: DataFrame, shared: Shared, radius: int, blocks: int) -> DataFrame:
    """``(v, root)`` of the ids of ``marks`` (``id, f0, f1``, each fingerprint once) that have others within ``radius``, directly or over others.

    First every fingerprint is held against the smallest id of each of its buckets, which joins dense groups by as many rows as
    they have members; buckets whose members are all joined by then are done. In the others every fingerprint outside the largest class
    is held against all those of other classes, so no link between classes is missed and no pairs inside a class are made.
    """
    rows = dealt(marks, radius, blocks)
    shared_keys = rows.groupBy(*BUCKET).agg(F.count("*").alias("size"), F.min("id").alias("lead")).where("size > 1").drop("size")
    shared_keys = shared.write(shared_keys, "buckets")
    met = shared.write(rows.join(small(shared_keys, SMALL_BUCKETS), BUCKET), "met")
    led = met.select(F.col("lead").alias("id")).distinct().join(marks, "id").select(F.col("id").alias("lead"), F.col("f0").alias("g0"), F.col("f1").alias("g1"))
    first = met.where("id <> lead").join(small(led, SMALL_BUCKETS), "lead").where(near(radius)).select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    first = shared.write(first, "led")
    roots = components(first, shared, "first")
    rooted = met.drop("lead").join(roots.select(F.col("v").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    counted = rooted.groupBy(*BUCKET, "root").agg(F.count("*").alias("members"))
    mixed = counted.groupBy(*BUCKET).agg(F.count("*").alias("classes"), F.max(F.struct("members", "root")).alias("largest")).where("classes > 1")
    mixed = shared.write(mixed.select(*BUCKET, F.col("largest.root").alias("largest")), "mixed")
    left = shared.write(rooted.join(small(mixed, SMALL_BUCKETS), BUCKET), "left")
    others = left.select(*BUCKET, F.col("id").alias("other"), F.col("root").alias("other_root"), F.col("f0").alias("g0"), F.col("f1").alias("g1"))
    pairs = left.where("root <> largest").join(others, BUCKET).where((F.col("root") != F.col("other_root")) & near(radius))
    second = shared.write(pairs.select(F.col("root").alias("a"), F.col("other_root").alias("b")).distinct(), "crossing")
    above = components(second, shared, "second").select(F.col("v").alias("root"), F.col("root").alias("top"))
    ends = roots.select("v", "root").unionByName(second.select(F.col("a").alias("v"), F.col("a").alias("root"))).unionByName(second.select(F.col("b").alias("v"), F.col("b").alias("root"))).distinct()
    made = ends.join(above, "root", "left").select("v", F.coalesce("top", "root").alias("root"))
    made = shared.write(made, "classes")
    shared.drop("buckets", "met", "led", "mixed", "left", "crossing")
    return made


def report(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, their likeness, the likeness to the next document's, and
    ``class_id``, the smallest id among the documents whose fingerprints are within ``radius``, directly or over others."""
    shared = Shared(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.md5(text)).alias("_key"))
    order = in_order(docs, shared)
    made = shared.write(prints(docs, order, shared), "prints")
    shared.drop("votes")
    marks = made.join(order.select("pos", "doc_id"), "pos").groupBy("f0", "f1").agg(F.min("pos").alias("id"), F.min("doc_id").alias("least"))
    marks = shared.write(marks, "marks")
    linked = classes(marks.select("id", "f0", "f1"), shared, radius, blocks)
    rooted = marks.join(linked.select(F.col("v").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    named = shared.write(rooted.join(named, "root").select("f0", "f1", "class_id"), "named")
    f0, f1 = F.col("f0"), F.col("f1")
    following = made.select(F.col("pos").alias("_next"), F.col("f0").alias("g0"), F.col("f1").alias("g1"))
    rows = order.select("pos", "key", "doc_id", "n_chars", F.expr("(pos + 1) % n").alias("_next")).join(made, "pos").join(following, "_next")
    rows = rows.join(small(named, SMALL_BUCKETS), ["f0", "f1"])
    result = rows.select(
        "key", "doc_id", "n_chars", "edited_sha256", shown(f0, f1).alias("fingerprint"), shown(F.col("e0"), F.col("e1")).alias("edited_fingerprint"),
        likeness(f0, f1, F.col("e0"), F.col("e1")).alias("near_edited"), likeness(f0, f1, F.col("g0"), F.col("g1")).alias("near_next"), "class_id",
    )
    if order.where("copies > 1").limit(1).count():
        result = result.join(shared.read(order.select("doc_id", "key", "n_chars"), "ids").select("key"), "key")
    return result.drop("key")
