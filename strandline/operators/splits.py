"""Train/test design: seeded splits, never-seen-key statistics and the instability sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.plans.lookup import lookup_join
from strandline.plans.running import HASH_BLOCK_DIGITS, Blocks, numbered, ranged, running, shuffled
from strandline.session import written


def share_cut(total: Column, ratio: float | Column) -> Column:
    """First ``int(total * ratio)`` rows."""
    return F.floor(total.cast("double") * F.lit(ratio)).cast("long")


def normal_split(sequences: DataFrame, ratio: float, seed: int, abnormal_seed: int = 12) -> DataFrame:
    """Assign ``part``: normals to ``train`` / ``test_normal``, abnormal ones half to ``test_abnormal`` / ``valid_abnormal``.

    ``sequences`` has ``seq_id`` and ``label``; sequences without a label fall out.
    """
    labelled = sequences.filter(F.col("label").isin(0, 1))
    class_seed = F.when(F.col("label") == 0, str(seed)).otherwise(str(abnormal_seed))
    ranked = shuffled(labelled, "seq_id", class_seed, "_rank", within=["label"], total="_total")
    first = F.when(F.col("label") == 0, "train").otherwise("test_abnormal")
    second = F.when(F.col("label") == 0, "test_normal").otherwise("valid_abnormal")
    share = F.when(F.col("label") == 0, F.lit(float(ratio))).otherwise(F.lit(0.5))
    return ranked.withColumn(
        "part", F.when(F.col("_rank") <= share_cut(F.col("_total"), share), first).otherwise(second)
    ).drop("_rank", "_total")


def holdout(sequences: DataFrame, ratio: float, seed: int, chosen: str, rest: str, out: str = "part") -> DataFrame:
    """Seeded split: ``int(n * ratio)`` sequences are ``chosen``, the others ``rest``. Without replacement."""
    ranked = shuffled(sequences, "seq_id", seed, "_rank", total="_total")
    return ranked.withColumn(
        out, F.when(F.col("_rank") <= share_cut(F.col("_total"), ratio), chosen).otherwise(rest)
    ).drop("_rank", "_total")


def sample_count(sequences: DataFrame, n: int, seed: int) -> DataFrame:
    """A seeded sample of exactly ``n`` sequences (all when there are fewer)."""
    return shuffled(sequences, "seq_id", seed, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def class_uniform_split(sequences: DataFrame, ratio: float, order_col: str, block: Column | Blocks) -> DataFrame:
    """Within each class the first ``int(n * ratio)`` sequences in log order train, the rest test."""
    ranked = numbered(sequences, [order_col], block, "_rank", within=["label"], total="_total")
    return ranked.withColumn(
        "part", F.when(F.col("_rank") <= share_cut(F.col("_total"), ratio), "train").otherwise("test")
    ).drop("_rank", "_total")


def sequential_split(sequences: DataFrame, ratio: float, order_col: str, block: Column | Blocks) -> DataFrame:
    """The first ``int(n * ratio)`` sequences in log order train, whatever their class."""
    ranked = numbered(sequences, [order_col], block, "_rank", total="_total")
    return ranked.withColumn(
        "part", F.when(F.col("_rank") <= share_cut(F.col("_total"), ratio), "train").otherwise("test")
    ).drop("_rank", "_total")


def supervised_split(parts: DataFrame, seed: int) -> DataFrame:
    """Training set with some abnormal sequences: ``min(n_train // 2, int(0.4 * n_abnormal))`` of them.

    ``parts`` has ``seq_id, label, part`` with parts ``train``, ``test_normal``, ``test_abnormal``; other parts fall out.
    """
    sizes = parts.agg(
        F.count(F.when(F.col("part") == "train", 1)).alias("train"),
        F.count(F.when(F.col("part") == "test_abnormal", 1)).alias("abnormal"),
    ).first()
    moved = min(sizes["train"] // 2, int(sizes["abnormal"] * 0.4))
    abnormal = shuffled(parts.filter(F.col("part") == "test_abnormal"), "seq_id", seed, "_rank")
    abnormal = abnormal.withColumn("split", F.when(F.col("_rank") <= moved, "train").otherwise("test")).drop("_rank")
    rest = parts.filter(F.col("part").isin("train", "test_normal")).withColumn(
        "split", F.when(F.col("part") == "train", "train").otherwise("test")
    )
    return rest.unionByName(abnormal)


def sequence_key_counts(elements: DataFrame) -> DataFrame:
    """``seq_id, key, cnt``: the sparse form every key statistic starts from."""
    return elements.groupBy("seq_id", "key").agg(F.count(F.lit(1)).alias("cnt"))


def unseen_statistics(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Never-seen-key statistics of one split, or of many at once when ``by`` names a step column.

    ``counts`` has ``seq_id, key, cnt, part`` with parts ``train``, ``test_normal``, ``test_abnormal`` (others are
    ignored).
    """
    by = list(by)
    parts = ["train", "test_normal", "test_abnormal"]
    pairs = counts.filter(F.col("part").isin(*parts))
    keys = pairs.groupBy(*by, "key").agg(
        *[F.max((F.col("part") == p).cast("int")).alias(f"in_{p}") for p in parts]
    )
    both = (F.col("in_test_normal") == 1) | (F.col("in_test_abnormal") == 1)
    known = F.col("in_train") == 1
    vocab = keys.groupBy(*by).agg(
        F.count(F.when(known, 1)).alias("train_vocab"),
        F.count(F.when(F.col("in_test_normal") == 1, 1)).alias("test_normal_vocab"),
        F.count(F.when(F.col("in_test_abnormal") == 1, 1)).alias("test_abnormal_vocab"),
        F.count(F.lit(1)).alias("total_vocab"),
        F.count(F.when(both, 1)).alias("_both"),
        F.count(F.when(known & (F.col("in_test_normal") == 1), 1)).alias("_seen_n"),
        F.count(F.when(known & (F.col("in_test_abnormal") == 1), 1)).alias("_seen_a"),
        F.count(F.when(known & both, 1)).alias("_seen_b"),
    )
    flagged = lookup_join(pairs, keys.select(*by, "key", "in_train"), [*by, "key"], "inner", F.col("seq_id"))
    per_seq = flagged.groupBy(*by, "seq_id", "part").agg(
        F.sum("cnt").alias("n"), F.max(1 - F.col("in_train")).alias("unseen")
    )

    def size(part):
        return F.count(F.when(F.col("part") == part, 1))

    def unseen(part):
        return F.count(F.when((F.col("part") == part) & (F.col("unseen") == 1), 1))

    seqs = per_seq.groupBy(*by).agg(
        size("train").alias("train_size"),
        size("test_normal").alias("test_normal_size"),
        size("test_abnormal").alias("test_abnormal_size"),
        unseen("test_normal").alias("_un"),
        unseen("test_abnormal").alias("_ua"),
        F.avg("n").alias("mean_seq_length"),
    )
    joined = vocab.join(seqs, by) if by else vocab.withColumn("_one", F.lit(1)).join(
        seqs.withColumn("_one", F.lit(1)), "_one"
    )

    def missing(seen, all_):
        return 1 - F.col(seen) / F.col(all_)

    return joined.select(
        *by,
        missing("_seen_n", "test_normal_vocab").alias("ratio_unseen_normal"),
        missing("_seen_a", "test_abnormal_vocab").alias("ratio_unseen_abnormal"),
        missing("_seen_b", "_both").alias("ratio_unseen_total"),
        "train_size", "test_normal_size", "test_abnormal_size",
        "train_vocab", "test_normal_vocab", "test_abnormal_vocab", "total_vocab",
        (F.col("_un") / F.col("test_normal_size")).alias("ratio_unseen_normal_sequences"),
        (F.col("_ua") / F.col("test_abnormal_size")).alias("ratio_unseen_abnormal_sequences"),
        ((F.col("_un") + F.col("_ua")) / (F.col("test_normal_size") + F.col("test_abnormal_size"))).alias(
            "ratio_unseen_total_sequences"
        ),
        "mean_seq_length",
    )


def removal_order(counts: DataFrame) -> DataFrame:
    """Order in which normal sequences leave the training pool: ``seq_id, leaves_at`` (1 = first).

    Training keys are ranked by the number of pool sequences holding them (ties in key order); a sequence leaves with
    its rarest training key, training sequences before test ones, then by hash of the id. Sequences without a training
    key never leave and are absent. The numbering runs inside each key and adds the sizes of the keys before it, so a
    key shared by most sequences is still cut into hash blocks.
    """
    pairs = counts.filter(F.col("part").isin("train", "test_normal")).select("seq_id", "key", "part")
    keys = pairs.groupBy("key").agg(
        F.count(F.lit(1)).alias("df"), F.max((F.col("part") == "train").cast("int")).alias("in_train")
    ).filter(F.col("in_train") == 1)
    ranked = written(numbered(ranged(keys, ["df", "key"]), ["df", "key"], F.col("_range"), "key_rank").select("key", "key_rank"))
    earliest = lookup_join(pairs, ranked, ["key"], "inner", F.col("seq_id")).groupBy("seq_id").agg(
        F.min("key_rank").alias("first_key"), F.max((F.col("part") == "test_normal").cast("int")).alias("_second")
    )
    earliest = written(earliest)
    per_key = earliest.groupBy("first_key").agg(F.count(F.lit(1)).alias("_n"))
    reach = running(
        per_key, ["first_key"], F.floor(F.col("first_key") / 4096), {"_upto": ("sum", F.col("_n"))}
    ).select("first_key", (F.col("_upto") - F.col("_n")).alias("_earlier"))
    hashed = earliest.withColumn("_hash", F.md5(F.col("seq_id").cast("string")))
    block = F.concat(F.col("_second").cast("string"), F.substring("_hash", 1, HASH_BLOCK_DIGITS))
    inside = numbered(hashed, ["_second", "_hash", "seq_id"], block, "_at", within=["first_key"])
    return lookup_join(inside, reach, ["first_key"], "inner", F.col("seq_id")).select("seq_id", (F.col("_at") + F.col("_earlier")).alias("leaves_at"))


def instability_sweep(parts: DataFrame, counts: DataFrame, steps: int, seed: int = 42) -> DataFrame:
    """All splits of the sweep at once: ``step, seq_id, part`` for steps ``0..steps`` (0 is the original split).

    At step ``j`` the first ``ceil(j / steps * surplus)`` sequences in removal order become test data; the remaining
    pool is sampled down to the original training size and the rest joins the normal test set. The abnormal test set is
    the same at every step.
    """
    sizes = parts.agg(
        F.count(F.when(F.col("part") == "train", 1)).alias("train"),
        F.count(F.when(F.col("part") == "test_normal", 1)).alias("surplus"),
    ).first()
    train, surplus = sizes["train"], sizes["surplus"]
    order = written(removal_order(counts))
    pool = parts.filter(F.col("part").isin("train", "test_normal")).select("seq_id", "part").join(
        order, "seq_id", "left"
    )
    budgets = [-(-j * surplus // steps) for j in range(1, steps + 1)]
    stepped = pool.withColumn(
        "_s", F.explode(F.array(*[F.struct(F.lit(j + 1).alias("step"), F.lit(b).alias("budget")) for j, b in enumerate(budgets)]))
    ).select("seq_id", "part", "leaves_at", "_s.step", "_s.budget")
    leaving = F.coalesce(F.col("leaves_at") <= F.col("budget"), F.lit(False))
    staying = shuffled(stepped.filter(~leaving), "seq_id", seed, "_rank", within=["step"])
    moved = stepped.filter(leaving).select("step", "seq_id", F.lit("test_normal").alias("part"))
    sampled = staying.select(
        "step", "seq_id", F.when(F.col("_rank") <= train, "train").otherwise("test_normal").alias("part")
    )
    abnormal = parts.filter(F.col("part") == "test_abnormal").select(
        F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"), "seq_id", "part"
    )
    original = parts.filter(F.col("part").isin("train", "test_normal")).select(F.lit(0).alias("step"), "seq_id", "part")
    return original.unionByName(moved).unionByName(sampled).unionByName(abnormal)


def covering_prefix(elements: DataFrame, n_distinct: int, order_col: str, block: Column | Blocks) -> DataFrame:
    """Shortest run of sequences, in ``order_col`` order, that holds ``n_distinct`` distinct keys."""
    first = elements.groupBy("key").agg(F.min(order_col).alias(order_col))
    new = first.groupBy(order_col).agg(F.count(F.lit(1)).alias("_new"))
    sequences = elements.select("seq_id", order_col).distinct().join(new, order_col, "left")
    counted = running(
        sequences, [order_col], block, {"_seen": ("sum", F.coalesce("_new", F.lit(0).cast("long")))}
    ).withColumn("_new", F.coalesce("_new", F.lit(0).cast("long")))
    return counted.filter(F.col("_seen") - F.col("_new") < n_distinct).select("seq_id", order_col)


def by_length(summary: DataFrame) -> DataFrame:
    """Place of every sequence when sorted from longest to shortest: ``seq_id, n, place``.

    Equal lengths are numbered inside their length by hash of the id and shifted by the number of longer sequences.
    """
    lengths = summary.groupBy("n").agg(F.count(F.lit(1)).alias("_c"))
    longer = running(
        lengths, [F.desc("n")], -F.floor(F.col("n") / 4096), {"_upto": ("sum", F.col("_c"))}
    ).select("n", (F.col("_upto") - F.col("_c")).alias("_before"))
    hashed = summary.withColumn("_hash", F.md5(F.col("seq_id").cast("string")))
    same = numbered(hashed, ["_hash", "seq_id"], F.substring("_hash", 1, HASH_BLOCK_DIGITS), "_at", within=["n"])
    return lookup_join(same, longer, ["n"], "inner", F.col("seq_id")).select("seq_id", "n", (F.col("_at") + F.col("_before")).alias("place"))


def vocabulary_overlap(counts: DataFrame) -> DataFrame:
    """Every key of the training and test vocabularies with the side it occurs on: both, train_only, test_only."""
    sides = counts.filter(F.col("part").isin("train", "test_normal", "test_abnormal")).groupBy("key").agg(
        F.max((F.col("part") == "train").cast("int")).alias("_tr"),
        F.max((F.col("part") != "train").cast("int")).alias("_te"),
    )
    side = (
        F.when((F.col("_tr") == 1) & (F.col("_te") == 1), "both").when(F.col("_tr") == 1, "train_only").otherwise("test_only")
    )
    return sides.select(side.alias("side"), "key")
