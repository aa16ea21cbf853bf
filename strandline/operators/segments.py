"""Fast template mining: a positional similarity join of distinct messages, leaders, and templates merged by position.

Two messages of one length are as similar as the share of their positions that hold the same token; a wildcard equals nothing.
Messages of ``n`` tokens with ``m`` equal ones differ in ``n - m`` positions, so if both are cut in ``n - m + 1`` segments at the
same places, one segment is the same in both. Segments ``(length, number, hash)`` are the index of the join.

Leaders are messages of which no two are similar, chosen in the order of a hash. A round draws a bounded number of undecided messages
of every length, takes the leaders among them and drops what is similar to a leader; large families go in the first round, and a
round decides at least what it drew. Then every message joins the leader that is most like it, and the members of a leader make its
template: a token where all agree, the wildcard elsewhere. The result does not depend on the order of the lines.

Only distinct messages leave the scan of the log. Messages that are null or without tokens have the empty template; a message in which nothing but
wildcards could agree leads itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.functions.text import WILDCARD
from strandline.operators.templates import merge_by_position
from strandline.plans.lookup import lookup_join
from strandline.session import written

DRAWN = 512


def needed(n: Column, similarity: float) -> Column:
    """Equal positions that messages of ``n`` tokens need; at least one."""
    return F.greatest(F.ceil(n * F.lit(similarity) - F.lit(1e-9)), F.lit(1)).cast("int")


def equal_positions(a: Column, b: Column) -> Column:
    """Positions at which two lists of one length hold the same token, wildcards aside."""
    same = F.zip_with(a, b, lambda x, y: ((x == y) & (x != WILDCARD)).cast("int"))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x)


def segments(messages: DataFrame, similarity: float, *kept: str) -> DataFrame:
    """``kept`` columns, ``n, part, code`` of every segment without a wildcard of ``messages`` (``tokens``)."""
    n = F.size("tokens")
    parts = n - needed(n, similarity) + 1

    def cut(k: Column) -> Column:
        first, last = F.floor(k * n / parts).cast("int"), F.floor((k + 1) * n / parts).cast("int")
        piece = F.slice("tokens", first + 1, last - first)
        return F.when(~F.array_contains(piece, WILDCARD), F.struct(k.alias("part"), F.xxhash64(piece).alias("code")))

    cuts = F.transform(F.sequence(F.lit(0), parts - 1), cut)
    opened = messages.where(n > 0).select(*kept, n.alias("n"), F.explode(F.array_compact(cuts)).alias("_s"))
    return opened.select(*kept, "n", "_s.part", "_s.code")


def best_leaders(messages: DataFrame, leaders: DataFrame, similarity: float) -> DataFrame:
    """``message, leader, equal`` of the messages that are similar to a leader: the most similar one, the first by name on ties.

    Both are ``message, tokens``. The leaders' segments are the dictionary of the join; a dictionary too large to be
    broadcast is salted, so a segment that a third of the messages hold is split over many tasks.
    """
    asked = segments(messages, similarity, "message", "tokens")
    index = segments(leaders, similarity, "message", "tokens").withColumnsRenamed({"message": "leader", "tokens": "of"})
    met = lookup_join(asked, index, ["n", "part", "code"], "inner", F.col("message"))
    scored = met.select("message", "n", "leader", equal_positions(F.col("tokens"), F.col("of")).alias("equal"))
    similar = scored.where(F.col("equal") >= needed(F.col("n"), similarity))
    best = similar.groupBy("message").agg(F.min(F.struct((-F.col("equal")).alias("less"), "leader")).alias("_b"))
    return best.select("message", F.col("_b.leader").alias("leader"), (-F.col("_b.less")).alias("equal"))


def _first_of(similarity: float):
    """Leaders among a bounded number of messages of one length, read in the order of their hashes."""

    def pick(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["code", "message"])
        rows = np.array([list(t) for t in batch["tokens"]], dtype=object)
        _, codes = np.unique(rows.astype(str), return_inverse=True)
        codes = codes.reshape(rows.shape)
        codes[rows == WILDCARD] = -1
        least = max(int(np.ceil(rows.shape[1] * similarity - 1e-9)), 1)
        chosen: list[int] = []
        for k in range(len(codes)):
            if not chosen or ((codes[chosen] == codes[k]) & (codes[k] >= 0)).sum(axis=1).max() < least:
                chosen.append(k)
        return batch.iloc[chosen][["message"]]

    return pick


def leaders(messages: DataFrame, similarity: float, drawn: int = DRAWN) -> DataFrame:
    """``message, tokens`` of the leaders of distinct ``messages`` (``message, tokens``)."""
    left = written(messages.where(F.size("tokens") > 0).withColumn("n", F.size("tokens")))
    found, wanted = None, drawn
    while True:
        counts = left.groupBy("n").agg(F.count(F.lit(1)).alias("_rows"))
        if counts.isEmpty():
            break
        # A draw by hash: a limit on the hash first leaves a few times what is wanted, so no task sorts a whole length.
        share = F.least(F.lit(1.0), F.lit(4.0 * wanted + 64) / F.col("_rows"))
        coded = lookup_join(left, counts, ["n"], "inner", F.col("message")).withColumn("code", F.xxhash64("message"))
        thinned = coded.where(F.pmod("code", F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
        first = F.row_number().over(Window.partitionBy("n").orderBy("code", "message"))
        draw = thinned.withColumn("_r", first).where(F.col("_r") <= wanted)
        chosen = draw.select("n", "code", "message", "tokens").groupBy("n").applyInPandas(_first_of(similarity), "message string")
        fresh = written(left.join(chosen, "message", "left_semi"))
        found = fresh if found is None else found.unionByName(fresh)
        near = best_leaders(left.select("message", "tokens"), fresh.select("message", "tokens"), similarity).select("message")
        left = written(left.join(fresh.select("message").unionByName(near).distinct().hint("merge"), "message", "left_anti"))
        wanted = min(2 * wanted, 16 * drawn)  # for logs in which few messages are alike
    if found is None:
        return messages.select("message", "tokens").limit(0)
    return written(found.select("message", "tokens"))


def mine_segments(lines: DataFrame, content: str, rules: list[str], similarity: float = 0.4, drawn: int = DRAWN) -> DataFrame:
    """Add ``EventTemplate`` and ``EventId`` of the fast mode to ``lines`` (``line_id`` and the text column ``content``)."""
    tokens = text.tokens(text.mask(F.col(content), rules))
    named = lines.withColumn("_message", F.array_join(tokens, " "))
    messages = named.select(F.col("_message").alias("message")).distinct()
    messages = written(messages.select("message", F.when(F.col("message") == "", F.array().cast("array<string>")).otherwise(F.split("message", " ")).alias("tokens")))
    chosen = leaders(messages, similarity, drawn)
    placed = best_leaders(messages, chosen, similarity).select("message", "leader")
    # A leader is its own, also where only its wildcards could agree.
    # Joined by shuffles: nearly every line may be a message of its own, and its compressed file is small.
    placed = messages.join(placed.hint("merge"), "message", "left").join(chosen.select("message", F.lit(True).alias("_own")).hint("merge"), "message", "left")
    placed = written(placed.select("message", "tokens", F.when(F.col("_own"), F.col("message")).otherwise(F.col("leader")).alias("leader")))
    merged = merge_by_position(placed.where(F.size("tokens") > 0).select("leader", "tokens"), ["leader"], "tokens")
    templates = lookup_join(placed.select("message", "leader"), merged.select("leader", F.array_join("template", " ").alias("EventTemplate")), ["leader"], "left", F.col("message"))
    dictionary = templates.select(F.col("message").alias("_message"), F.coalesce("EventTemplate", F.lit("")).alias("EventTemplate"))
    made = lookup_join(named, dictionary, ["_message"], "left", F.col("line_id")).drop("_message")
    made = made.withColumn("EventTemplate", F.coalesce("EventTemplate", F.lit("")))
    return made.withColumn("EventId", text.event_id(F.col("EventTemplate")))
