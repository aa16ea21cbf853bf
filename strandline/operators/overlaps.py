"""Template mining across lengths: an overlap join with a prefix filter, and longest common subsequences in machine words.

A message and a leader may share a template when the leader holds at least ``share`` of the message's length among its distinct constants.
The constants of a message are ordered by the number of leaders that hold them, rare ones first. A leader that holds enough of
them holds one of the first ``size - needed + 1``, so only those are looked up in the index ``constant -> leader``; constants
that no leader holds come first and cost nothing.

The subsequences of the pairs left are found in Arrow batches, all pairs of a batch together: a bit for each token of the leader, one
addition for each token of the message. What the messages of a leader have in common is the set of leader positions that
every one of them is aligned with: positions are counted, so the template depends neither on order nor on partitions, and is a
subsequence of every member.

Wildcards equal nothing. Messages without constants lead themselves; blank and null ones have the empty template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.functions.text import WILDCARD
from strandline.plans.lookup import by_size, lookup_join
from strandline.session import written

DRAWN = 256
WORD = 63


def constants(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, lambda t: t != WILDCARD))


def overlapping(messages: DataFrame, leaders: DataFrame, share: float = 0.5) -> DataFrame:
    """``message, tokens, leader, of, common`` of all pairs of ``messages`` and ``leaders`` (both ``message, tokens``, distinct) in which
    the leader holds ``common >= share * size(tokens)`` distinct constants of the message, and one at least."""
    index = written(leaders.select(F.col("message").alias("leader"), F.col("tokens").alias("of"), constants(F.col("tokens")).alias("held")))
    held = index.select("leader", F.explode("held").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    least = F.greatest(F.ceil(F.size("tokens") * F.lit(share) - F.lit(1e-9)), F.lit(1)).cast("int")
    asked = messages.select("message", "tokens", constants(F.col("tokens")).alias("own"), least.alias("least")).where(F.size("own") >= F.col("least"))
    opened = lookup_join(asked.select("message", F.explode("own").alias("token")), held, ["token"], "left", F.col("message"))
    ranked = opened.groupBy("message").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "token"))).alias("_t"))
    ordered = asked.join(ranked.hint("merge"), "message").withColumn("prefix", F.slice("_t", 1, F.size("own") - F.col("least") + 1))
    # Constants without a leader have no row in the index.
    first = F.filter("prefix", lambda t: t["freq"] > 0).getField("token")
    spread = ordered.select("message", "tokens", "own", "least", first.alias("prefix")).select("*", F.explode("prefix").alias("token"))
    met = lookup_join(spread, index.select("leader", "of", "held", F.explode("held").alias("token")), ["token"], "inner", F.col("message"))
    # A pair is made by the first constant it shares, so it needs no second shuffle to be made once.
    once = met.where(F.get(F.array_intersect("prefix", "held"), F.lit(0)) == F.col("token"))
    counted = once.withColumn("common", F.size(F.array_intersect("own", "held")))
    return counted.where(F.col("common") >= F.col("least")).select("message", "tokens", "leader", "of", "common")


def _coded(column: pa.Array, codes: np.ndarray, other: int) -> tuple[np.ndarray, np.ndarray]:
    """A padded matrix of token codes and the lengths; ``codes`` are those of the flat column, ``other`` fills."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.full((len(lengths), int(lengths.max(initial=0))), other, np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = codes
    return out, lengths


def _aligned_words(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row, the bits of the positions of ``a`` (at most ``WORD``) on a longest common subsequence with ``b``."""
    bits = np.uint64(1) << np.arange(a.shape[1], dtype=np.uint64)
    whole = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
    v = whole.copy()
    steps = np.empty((b.shape[1] + 1, len(a)), np.uint64)
    steps[0] = v
    for j in range(b.shape[1]):
        match = ((a == b[:, j : j + 1]) * bits).sum(axis=1, dtype=np.uint64)
        v = ((v + (v & match)) | (v & ~match)) & whole
        steps[j + 1] = v
    # Back from both ends: leave the end of a, else of b, where the length stays, and take the token otherwise.
    i, j, taken = size.astype(np.int64).copy(), np.full(len(a), b.shape[1]), np.zeros(len(a), np.uint64)
    rows = np.arange(len(a))

    def length(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << i.astype(np.uint64)) - np.uint64(1)
        return np.bitwise_count(~steps[j, rows] & low).astype(np.int64)

    while True:
        here = length(i, j)
        alive = here > 0
        if not alive.any():
            return taken
        skip_a = alive & (length(np.maximum(i - 1, 0), j) == here)
        skip_b = alive & ~skip_a & (length(i, np.maximum(j - 1, 0)) == here)
        take = alive & ~skip_a & ~skip_b
        taken[take] |= np.uint64(1) << (i[take] - 1).astype(np.uint64)
        i[skip_a | take] -= 1
        j[skip_b | take] -= 1


def _aligned_long(a: list[int], b: list[int]) -> list[int]:
    """The same for one pair of any length, with the words of a Python integer."""
    places: dict[int, int] = {}
    for k, token in enumerate(a):
        places[token] = places.get(token, 0) | 1 << k
    whole = (1 << len(a)) - 1
    steps = [whole]
    for token in b:
        v, match = steps[-1], places.get(token, 0)
        steps.append(((v + (v & match)) | (v & ~match)) & whole)
    i, j, out = len(a), len(b), []
    length = lambda i, j: (~steps[j] & ((1 << i) - 1)).bit_count()
    here = length(i, j)
    while here:
        if length(i - 1, j) == here:
            i -= 1
        elif length(i, j - 1) == here:
            j -= 1
        else:
            i, j, here = i - 1, j - 1, here - 1
            out.append(i)
    return out[::-1]


def _align(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            ours, theirs = (pa.concat_arrays([batch.column(c)]) for c in ("of", "tokens"))
            flat = pa.concat_arrays([ours.flatten(), theirs.flatten()]).fill_null(WILDCARD)
            codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            wild = pc.equal(flat, WILDCARD).to_numpy(zero_copy_only=False)
            cut = len(ours.flatten())
            codes[:cut][wild[:cut]], codes[cut:][wild[cut:]] = -1, -2
            places: list = [None] * batch.num_rows
            lengths = np.diff(ours.offsets.to_numpy())
            short = np.flatnonzero(lengths <= WORD)
            starts = [np.concatenate([[0], np.cumsum(np.diff(c.offsets.to_numpy()))]) for c in (ours, theirs)]
            if len(short):
                a, size = _coded(ours, codes[:cut], -1)
                b, _ = _coded(theirs, codes[cut:], -2)
                taken = _aligned_words(a[short][:, :WORD], b[short], size[short])
                for row, mask in zip(short, taken.tolist()):
                    places[row] = [k for k in range(lengths[row]) if mask >> k & 1]
            for row in np.flatnonzero(lengths > WORD):
                mine, its = codes[:cut][starts[0][row] : starts[0][row + 1]], codes[cut:][starts[1][row] : starts[1][row + 1]]
                places[row] = _aligned_long(mine.tolist(), its.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("message"), batch.column("leader"), pa.array([len(p) for p in places], pa.int32()), pa.array(places, pa.list_(pa.int32()))],
                ["message", "leader", "length", "places"],
            )


def aligned(pairs: DataFrame) -> DataFrame:
    """``message, leader, length, places``: the length of the longest common subsequence and the leader's positions on one."""
    return pairs.select("message", "leader", "tokens", "of").mapInArrow(_align, "message string, leader string, length int, places array<int>")


def best_aligned(messages: DataFrame, leaders: DataFrame, tau: float, share: float = 0.5) -> DataFrame:
    """``message, leader, length, places`` of the leader with the longest subsequence of ``tau`` of the message or more; among equals the
    shorter leader, then the first by name."""
    # The messages are joined by a shuffle: nearly every line may be one of its own, and their compressed file is small.
    found = aligned(overlapping(messages, leaders, share)).join(messages.select("message", F.size("tokens").alias("n")).hint("merge"), "message").join(
        by_size(leaders.select(F.col("message").alias("leader"), F.size("tokens").alias("size"))), "leader"
    )
    enough = found.where(F.col("length") >= F.greatest(F.ceil(F.col("n") * F.lit(tau) - F.lit(1e-9)), F.lit(1)))
    best = enough.groupBy("message").agg(F.min(F.struct((-F.col("length")).alias("less"), "size", "leader", "places")).alias("_b"))
    return best.select("message", "_b.leader", (-F.col("_b.less")).alias("length"), "_b.places")


def _apart(tau: float, share: float):
    """Leaders among a bounded draw, in the order of their hashes: a message that no leader before it is similar to, or that is similar to none."""

    def pick(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["code", "message"])
        lists = [[t for t in tokens if t != WILDCARD] for tokens in batch["tokens"]]
        sizes = [len(t) for t in batch["tokens"]]
        names = {t: k for k, t in enumerate(sorted({t for tokens in lists for t in tokens}))}
        lists = [[names[t] for t in tokens] for tokens in lists]
        sets = [set(t) for t in lists]
        chosen: list[int] = []

        def near(k: int, c: int) -> bool:
            if len(sets[k] & sets[c]) < max(share * sizes[k] - 1e-9, 1):
                return False
            return len(_aligned_long(lists[c], lists[k])) >= max(tau * sizes[k] - 1e-9, 1)

        for k in range(len(lists)):
            if not any(near(k, c) for c in chosen):
                chosen.append(k)
        return batch.iloc[chosen][["message"]]

    return pick


def subsequence_leaders(messages: DataFrame, tau: float, share: float = 0.5, drawn: int = DRAWN) -> DataFrame:
    """Messages to which every message (``message, tokens``, distinct) has a long common subsequence, itself where nothing else has.

    A round draws a bounded number of undecided messages by hash and keeps as leaders those that no leader of the draw is near to;
    what is near to a leader is decided. Draws grow up to eight times ``drawn``, for logs in which few messages are alike.
    """
    left = written(messages.where(F.size("tokens") > 0))
    found, wanted = None, drawn
    while True:
        rows = left.count()
        if not rows:
            break
        coded = left.withColumn("code", F.xxhash64("message"))
        # A limit on the hash leaves a few times what is drawn; the rest is cut by a top list, which holds `drawn` rows a task.
        limit = int(min(1.0, (4.0 * wanted + 64) / rows) * (1 << 30))
        draw = coded.where(F.pmod("code", F.lit(1 << 30)) < limit).orderBy("code", "message").limit(wanted)
        chosen = draw.select(F.lit(0).alias("_g"), "code", "message", "tokens").groupBy("_g").applyInPandas(_apart(tau, share), "message string")
        fresh = written(left.join(chosen, "message", "left_semi"))
        found = fresh if found is None else found.unionByName(fresh)
        near = best_aligned(left, fresh, tau, share).select("message")
        left = written(left.join(fresh.select("message").unionByName(near).distinct().hint("merge"), "message", "left_anti"))
        wanted = min(2 * wanted, 8 * drawn)
    return written(found) if found is not None else messages.limit(0)


def mine_subsequences(lines: DataFrame, split: Column, tau: float = 0.5, share: float = 0.5, drawn: int = DRAWN) -> DataFrame:
    """Add ``EventTemplate`` and ``EventId`` to ``lines`` (``line_id`` and what ``split``, a column of tokens, is made from)."""
    separator = "\x1f"
    named = lines.withColumn("_message", F.array_join(split, separator))
    distinct = named.select(F.col("_message").alias("message")).distinct()
    messages = written(distinct.select("message", F.when(F.col("message") == "", F.array().cast("array<string>")).otherwise(F.split("message", separator)).alias("tokens")))
    chosen = subsequence_leaders(messages, tau, share, drawn)
    own = chosen.select("message", F.col("message").alias("leader"), F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1)).alias("places"))
    near = best_aligned(messages.join(by_size(chosen.select("message")), "message", "left_anti"), chosen, tau, share).select("message", "leader", "places")
    placed = written(own.unionByName(near))
    members = placed.groupBy("leader").agg(F.count(F.lit(1)).alias("members"))
    agreed = placed.select("leader", F.explode("places").alias("place")).groupBy("leader", "place").agg(F.count(F.lit(1)).alias("seen"))
    kept = agreed.join(members, "leader").where("seen = members").groupBy("leader").agg(F.collect_set("place").alias("kept"))
    shapes = chosen.select(F.col("message").alias("leader"), "tokens").join(kept, "leader", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    last = F.coalesce(F.array_max("kept"), F.lit(-1)) + 1
    filled = F.transform("tokens", lambda t, i: F.when(F.array_contains("kept", i), t).otherwise(WILDCARD))
    template = F.concat(F.slice(filled, 1, last), F.when(last < F.size("tokens"), F.array(F.lit(WILDCARD))).otherwise(F.array().cast("array<string>")))
    templates = lookup_join(placed.select("message", "leader"), shapes.select("leader", F.array_join(template, " ").alias("EventTemplate")), ["leader"], "inner", F.col("message"))
    made = lookup_join(named, templates.select(F.col("message").alias("_message"), "EventTemplate"), ["_message"], "left", F.col("line_id")).drop("_message")
    made = made.withColumn("EventTemplate", F.coalesce("EventTemplate", F.lit("")))
    return made.withColumn("EventId", text.event_id(F.col("EventTemplate")))
