"""Detectors built on key counts: unseen keys, context ranks of masked keys, next-event top-g, decisions, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.vocabulary import by_frequency
from strandline.plans.lookup import lookup_join
from strandline.plans.neighbours import over_neighbours
from strandline.session import written

START, END = "<sos>", "<eos>"


def unseen_scores(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``seq_id, score``: share of elements whose key is not in the dictionary. ``counts`` is ``seq_id, key, cnt``."""
    known = vocab.select("key", F.lit(1).alias("_known"))
    found = lookup_join(counts, known, ["key"], "left", F.col("seq_id"))
    return found.groupBy("seq_id").agg(
        (F.sum(F.when(F.col("_known").isNull(), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("score")
    )


def with_context(elements: DataFrame) -> DataFrame:
    """Add the keys before and after each element."""
    return over_neighbours(
        elements, ["seq_id"], "pos", 1, 1,
        {
            "left_key": lambda w: F.coalesce(F.lag("key").over(w), F.lit(START)),
            "right_key": lambda w: F.coalesce(F.lead("key").over(w), F.lit(END)),
        },
    )


class ContextRankModel:
    """Rank of a masked key among all training keys, given its two neighbours.

    Candidates are ordered by how often they stood between the same neighbours, then after the same left neighbour,
    then overall, then by key. The keys seen in a context are few, so a rank is its place in the sparse lists plus the
    number of better-placed candidates that the wider list ranks below it; no context is paired with all keys.
    """

    def __init__(self, train: DataFrame):
        context = with_context(train)
        triples = written(context.groupBy("left_key", "right_key", "key").agg(F.count(F.lit(1)).alias("c3")))
        pairs = triples.groupBy("left_key", "key").agg(F.sum("c3").alias("c2"))
        singles = pairs.groupBy("key").agg(F.sum("c2").alias("freq"))
        self.overall = written(by_frequency(singles, "overall_rank").select("key", "overall_rank"))
        after_left = Window.partitionBy("left_key").orderBy(F.desc("c2"), "overall_rank")
        # Joined by shuffles: the compressed tables hold far more rows than their files tell.
        self.followers = written(pairs.join(self.overall.hint("merge"), "key").select(
            "left_key", "key", "overall_rank", F.row_number().over(after_left).alias("left_rank")
        ))
        between = Window.partitionBy("left_key", "right_key").orderBy(F.desc("c3"), "left_rank")
        self.fillers = written(triples.join(self.followers.hint("merge"), ["left_key", "key"]).select(
            "left_key", "right_key", "key", "left_rank", F.row_number().over(between).alias("fill_rank")
        ))

    def ranks(self, contexts: DataFrame) -> DataFrame:
        """0-based rank of every distinct ``(left_key, right_key, key)``; a key never trained on ranks after all."""
        asked = contexts.select("left_key", "right_key", "key").distinct()
        known = written(asked.join(self.fillers.drop("left_rank").hint("merge"), ["left_key", "right_key", "key"], "left").join(
            self.followers.select("left_key", "key", "left_rank").hint("merge"), ["left_key", "key"], "left"
        ).join(self.overall.hint("merge"), "key", "left"))
        middle = known.filter(F.col("fill_rank").isNull() & F.col("left_rank").isNotNull())
        ahead = _worse_placed(middle, self.fillers, ["left_key", "right_key"], "left_rank")
        outer = known.filter(F.col("left_rank").isNull() & F.col("overall_rank").isNotNull())
        beside = outer.join(
            _worse_placed(outer, self.followers, ["left_key"], "overall_rank").drop("overall_rank").hint("merge"), ["left_key", "key"]
        )
        size = self.overall.agg(F.max("overall_rank")).first()[0] or 0
        columns = ["left_key", "right_key", "key"]
        inner = known.filter(F.col("fill_rank").isNotNull()).select(*columns, (F.col("fill_rank") - 1).alias("rank"))
        unseen = known.filter(F.col("overall_rank").isNull()).select(*columns, F.lit(size).alias("rank"))
        return (
            inner.unionByName(ahead.select(*columns, (F.col("left_rank") - 1 + F.col("_ahead")).alias("rank")))
            .unionByName(beside.select(*columns, (F.col("overall_rank") - 1 + F.col("_ahead")).alias("rank")))
            .unionByName(unseen)
            .withColumn("rank", F.col("rank").cast("long"))
        )

    def score(self, elements: DataFrame) -> DataFrame:
        """Add ``rank`` to every element, each masked on its own."""
        context = written(with_context(elements))
        return lookup_join(
            context, self.ranks(context), ["left_key", "right_key", "key"], "left", F.col("pos")
        ).drop("left_key", "right_key")

    def score_sequences(self, elements: DataFrame, g: int) -> DataFrame:
        """``seq_id, undetected_tokens, masked_tokens, element_anomaly_score`` with equal contexts counted once."""
        context = with_context(elements)
        counted = written(context.groupBy("seq_id", "left_key", "right_key", "key").agg(F.count(F.lit(1)).alias("cnt")))
        ranked = lookup_join(
            counted, self.ranks(counted), ["left_key", "right_key", "key"], "left", F.col("seq_id")
        )
        return ranked.groupBy("seq_id").agg(
            F.sum(F.when(F.col("rank") >= g, F.col("cnt")).otherwise(0)).alias("undetected_tokens"),
            F.sum("cnt").alias("masked_tokens"),
            (F.sum(F.col("rank") * F.col("cnt")) / F.sum("cnt")).alias("element_anomaly_score"),
        )


def _worse_placed(asked: DataFrame, listed: DataFrame, context: list[str], place: str) -> DataFrame:
    """For every asked key: how many keys listed for its context stand below it in the wider ranking ``place``."""
    columns = [*context, "key", place]
    questions = asked.select(*columns).distinct().withColumn("_listed", F.lit(0))
    entries = listed.select(*columns, F.lit(1).alias("_listed"))
    below = Window.partitionBy(*context).orderBy(F.desc(place)).rangeBetween(Window.unboundedPreceding, -1)
    return questions.unionByName(entries).withColumn(
        "_ahead", F.coalesce(F.sum("_listed").over(below), F.lit(0))
    ).filter(F.col("_listed") == 0).drop("_listed")


class NextEventModel:
    """Top-g candidates for the next key after the last ``width`` keys, backing off to shorter contexts."""

    def __init__(self, windows: DataFrame, width: int, g: int):
        self.width, self.g = width, g
        counted = windows.groupBy("context", "next_key").agg(F.count(F.lit(1)).alias("cnt"))
        orders = counted.select(
            "next_key", "cnt", F.explode(self._suffixes(F.col("context"))).alias("_s")
        ).groupBy("_s.order", "_s.suffix", "next_key").agg(F.sum("cnt").alias("cnt"))
        self.candidates = written(self.best_of(orders, g))

    @staticmethod
    def best_of(orders: DataFrame, g: int) -> DataFrame:
        """``order, suffix, top``: the ``g`` most frequent next keys of every context (``order, suffix, next_key, cnt``)."""
        # The empty context holds the whole vocabulary: the best of each hash part are taken first.
        parted = Window.partitionBy("order", "suffix", F.pmod(F.xxhash64("next_key"), F.lit(256))).orderBy(F.desc("cnt"), "next_key")
        best = Window.partitionBy("order", "suffix").orderBy(F.desc("cnt"), "next_key")
        part_best = orders.withColumn("_r", F.row_number().over(parted)).filter(F.col("_r") <= g)
        top = part_best.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= g)
        return top.groupBy("order", "suffix").agg(
            F.array_sort(F.collect_list(F.struct("_r", "next_key"))).getField("next_key").alias("top")
        )

    def _suffixes(self, context: Column) -> Column:
        return F.array(*[
            F.struct(F.lit(n).alias("order"), F.array_join(F.slice(context, self.width - n + 1, n), " ").alias("suffix"))
            if n else F.struct(F.lit(0).alias("order"), F.lit("").alias("suffix"))
            for n in range(self.width + 1)
        ])

    def flag(self, windows: DataFrame) -> DataFrame:
        """Add ``flag`` and ``first``: whether the key that followed is not among the candidates of the longest known
        context, and whether it is the best one."""
        asked = written(windows.select("context", "next_key").distinct())
        tried = asked.select("*", F.explode(self._suffixes(F.col("context"))).alias("_s")).select(
            "context", "next_key", "_s.order", "_s.suffix"
        )
        answered = lookup_join(tried, self.candidates, ["order", "suffix"], "inner", F.col("next_key"))
        verdict = answered.groupBy("context", "next_key").agg(
            F.max_by(F.array_position("top", F.col("next_key")), F.col("order")).alias("_place")
        )
        joined = lookup_join(windows, verdict, ["context", "next_key"], "left", F.struct("seq_id", "start"))
        place = F.coalesce("_place", F.lit(0).cast("long"))
        return joined.withColumn("flag", (place == 0).cast("long")).withColumn("first", (place == 1).cast("long")).drop("_place")


def flag_totals(flagged: DataFrame) -> DataFrame:
    """``seq_id, flags, predicted, any_flag``: window verdicts summed per sequence."""
    return flagged.groupBy("seq_id").agg(
        F.sum("flag").alias("flags"), F.count(F.lit(1)).alias("predicted"), F.max("flag").alias("any_flag")
    )


def decide_by_flags(totals: DataFrame, threshold: int | float) -> DataFrame:
    """Anomalous when the flags exceed a count (int) or a share of the predictions (float)."""
    limit = F.lit(threshold) * F.col("predicted") if isinstance(threshold, float) else F.lit(threshold)
    return totals.withColumn("pred", (F.col("flags") > limit).cast("long"))


def undetected_ratio(undetected: Column, masked: Column) -> Column:
    return F.when(masked != 0, undetected / masked).otherwise(F.lit(0.0))


def decide_by_score(scored: DataFrame, threshold: Column, use_sphere: bool = False) -> DataFrame:
    """Anomalous when ``score`` reaches the threshold, or the hypersphere flag is set and enabled."""
    hit = F.col("score") >= threshold
    if use_sphere:
        hit = hit | (F.col("sphere_flag") == 1)
    return scored.withColumn("pred", hit.cast("long"))


def masked_only(scored: DataFrame) -> DataFrame:
    """Sequences in which nothing was masked carry no score and are skipped."""
    return scored.filter(F.col("masked_tokens") > 0)


def roll_up_elements(elements: DataFrame) -> DataFrame:
    """Element records to one record per sequence: sums, means, and the last element's carried values."""
    return elements.groupBy("seq_id").agg(
        F.avg("num_error").alias("num_error"),
        F.sum("undetected_tokens").alias("undetected_tokens"),
        F.sum("masked_tokens").alias("masked_tokens"),
        F.max_by("total_logkey", "pos").alias("total_logkey"),
        F.max_by("sphere_flag", "pos").alias("sphere_flag"),
        F.avg("element_anomaly_score").alias("element_anomaly_score"),
    )


