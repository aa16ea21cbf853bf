"""Grouping log lines into sequences: id sessions, time windows, count chunks and next-event windows.

A sequence is kept in long form - one row per element with ``(seq_id, pos, ...)``, ``pos`` dense from 0 - because a
session or window may hold any share of the log. Arrays are only built for bounded pieces (a chunk, a context window,
a sequence cut to ``max_len``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.plans.lookup import lookup_join
from strandline.plans.neighbours import over_neighbours
from strandline.plans.running import Blocks, line_block, numbered, running
from strandline.session import written

MIN_LEN = 10
MAX_LEN = 512
PAD_TEXT = "#Pad"


def sessions_by_column(
    lines: DataFrame, id_col: str, order: Sequence[Column | str] = ("line_id",), block: Column | Blocks | None = None
) -> DataFrame:
    """Elements of id sessions: every line belongs to the session named in ``id_col``, in line order."""
    placed = numbered(
        lines.withColumnRenamed(id_col, "seq_id"), list(order), block if block is not None else line_block(),
        "_row", within=["seq_id"],
    )
    return placed.withColumn("pos", F.col("_row") - 1).drop("_row")


def sessions_by_pattern(lines: DataFrame, content: str, pattern: str, group: int = 1) -> DataFrame:
    """A line joins every distinct id its content names; lines without an id join none."""
    named = lines.withColumn(
        "seq_id", F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), group)))
    )
    placed = numbered(named, ["line_id"], line_block(), "_row", within=["seq_id"])
    return placed.withColumn("pos", F.col("_row") - 1).drop("_row")


def sequence_summary(elements: DataFrame, label: str = "el_label") -> DataFrame:
    """One row per sequence: length and label (an anomalous element makes the sequence anomalous)."""
    return elements.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(label).cast("long").alias("label")
    )


def with_running_clock(lines: DataFrame) -> DataFrame:
    """Add ``clock``: the running maximum of ``epoch``. A forward-only scan sees an unsorted log this way."""
    return running(lines, ["line_id"], line_block(), {"clock": ("max", F.col("epoch"))})


def with_delta(lines: DataFrame) -> DataFrame:
    """Seconds since the previous line of the log; 0 for the first line."""
    return over_neighbours(
        lines.withColumn("_all", F.lit(0)), ["_all"], "line_id", 1, 0,
        {"_prev": lambda w: F.lag("epoch").over(w)},
    ).withColumn("delta_t", F.coalesce(F.col("epoch") - F.col("_prev"), F.lit(0)).cast("double")).drop("_all", "_prev")


class TimeWindows:
    """Overlapping time windows aligned to the first line, as ranges of line ids.

    Windows that hold the same lines are one window and empty ones vanish. The scan stops at the first window that
    reaches the last line. Lines are first reduced to slots of ``gcd(window, step)`` seconds - every slot lies wholly
    inside or outside a window - so only the slot table is multiplied by ``window / step``, never the log.
    """

    def __init__(
        self, lines: DataFrame, window: int, step: int, min_len: int = MIN_LEN, max_len: int = MAX_LEN,
        stop: str = "window", distinct: bool = True, keep_empty: bool = False,
    ):
        self.window, self.step, self.min_len, self.max_len = window, step, min_len, max_len
        self.distinct, self.keep_empty = distinct, keep_empty
        self.lines = with_running_clock(lines)
        first, last = lines.agg(F.min_by("epoch", "line_id"), F.max("epoch")).first()
        self.first, self.last = first, last
        self.reach = window
        if stop == "last_event":
            ended = self.lines.filter(F.col("clock") < first + window).agg(F.max("clock")).first()[0]
            self.reach = ended - first
        self._slots = None
        self.slot_size = math.gcd(math.gcd(window, step), self.reach) if self.reach else step
        self.last_window = max(0, (last - first - self.reach) // step + 1)
        if last - first < window:
            self.last_window = 0

    def _slot(self) -> Column:
        return F.floor((F.col("clock") - F.lit(self.first)) / F.lit(self.slot_size)).cast("long")

    def _windows_of_slot(self, slot: Column) -> Column:
        """Ids of the windows that hold a slot; an array, empty when the step jumps over it."""
        start = slot * F.lit(self.slot_size)
        low = F.greatest(
            F.lit(0).cast("long"), F.floor((start - F.lit(self.reach)) / F.lit(self.step)).cast("long") + 1
        )
        high = F.least(F.lit(self.last_window).cast("long"), F.floor(start / F.lit(self.step)).cast("long"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    def _head(self, ids: Column, slot: Column) -> Column:
        """The first window ends at the full width even when later ones end at the last event."""
        if self.reach == self.window:
            return ids
        inside = slot * F.lit(self.slot_size) < F.lit(self.window)
        has_zero = F.array_contains(ids, F.lit(0).cast("long"))
        return F.when(
            inside & ~has_zero, F.concat(F.array(F.lit(0).cast("long")), ids)
        ).otherwise(ids)

    def slot_windows(self) -> DataFrame:
        if self._slots is None:
            self._slots = written(self.lines.groupBy(self._slot().alias("slot")).agg(
                F.min("line_id").alias("low"), F.max("line_id").alias("high"),
                F.count(F.lit(1)).alias("n"), F.max("el_label").alias("label"),
            ))
        slots = self._slots
        ids = self._head(self._windows_of_slot(F.col("slot")), F.col("slot"))
        return slots.withColumn("k", F.explode(ids))

    def all_windows(self) -> DataFrame:
        """Window table before the length filter: ``seq_id, first_line, last_line, n, label``."""
        windows = self.slot_windows().groupBy("k").agg(
            F.min("low").alias("first_line"), F.max("high").alias("last_line"),
            F.sum("n").alias("n"), F.max("label").cast("long").alias("label"),
        )
        if self.distinct:
            windows = windows.groupBy("first_line", "last_line").agg(
                F.min("k").alias("k"), F.first("n").alias("n"), F.first("label").alias("label")
            )
        if self.keep_empty:
            spark = self.lines.sparkSession
            windows = spark.range(self.last_window + 1).withColumnRenamed("id", "k").join(windows, "k", "left")
            windows = windows.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn(
                "label", F.coalesce("label", F.lit(0).cast("long"))
            )
        return windows.select(F.col("k").alias("seq_id"), "first_line", "last_line", "n", "label")

    def windows(self) -> DataFrame:
        """Windows of at least ``min_len`` lines; the label covers the whole window, also beyond ``max_len``."""
        return self.all_windows().filter(F.col("n") >= self.min_len)

    def elements(self) -> DataFrame:
        """Elements of the kept windows, cut to the first ``max_len`` lines; ``pos`` follows from the line range."""
        kept = self.windows()
        slots = self.slot_windows().select("slot", F.col("k").alias("seq_id"))
        placed = slots.join(kept.select("seq_id", "first_line", "n", "label"), "seq_id")
        in_slot = self.lines.withColumn("slot", self._slot())
        joined = _many_lookup(in_slot, placed, "slot", F.col("line_id"))
        return joined.withColumn("pos", F.col("line_id") - F.col("first_line")).filter(
            F.col("pos") < self.max_len
        ).drop("slot", "first_line", "clock")

    def key_counts(self) -> DataFrame:
        """Event counts per window over all its lines: counted per slot first, so the log is never multiplied."""
        per_slot = self.lines.groupBy(self._slot().alias("slot"), "key").agg(F.count(F.lit(1)).alias("cnt"))
        slots = self.slot_windows().select("slot", F.col("k").alias("seq_id"))
        return per_slot.join(slots, "slot").groupBy("seq_id", "key").agg(F.sum("cnt").alias("cnt"))


def _many_lookup(lines: DataFrame, slots: DataFrame, on: str, spread: Column) -> DataFrame:
    """Join each line to its slot's windows; a slot's windows travel as one array so the dictionary stays unique."""
    packed = slots.groupBy(on).agg(
        F.collect_list(F.struct(*[c for c in slots.columns if c != on])).alias("_in")
    )
    joined = lookup_join(lines, packed, [on], "inner", spread)
    opened = joined.withColumn("_w", F.explode("_in")).drop("_in")
    return opened.select(*lines.columns, "_w.*")


def tumbling_windows(lines: DataFrame, seconds: int) -> DataFrame:
    """Epoch-aligned windows with their length and label; windows without a line are present with no label."""
    spark = lines.sparkSession
    start = F.floor(F.col("epoch") / F.lit(seconds)).cast("long") * F.lit(seconds)
    filled = lines.groupBy(start.alias("start")).agg(
        F.count(F.lit(1)).alias("n"), F.max("el_label").cast("long").alias("label")
    )
    low, high = lines.agg(F.min(start), F.max(start)).first()
    spine = spark.range(low, high + 1, seconds).withColumnRenamed("id", "start")
    return spine.join(filled, "start", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def tumbling_elements(lines: DataFrame, seconds: int) -> DataFrame:
    """The lines of every tumbling window in log order."""
    start = F.floor(F.col("epoch") / F.lit(seconds)).cast("long") * F.lit(seconds)
    return sessions_by_column(lines.withColumn("start", start), "start").withColumnRenamed("seq_id", "start")


def zero_first_delta(elements: DataFrame) -> DataFrame:
    """The duration before the first element of a sequence belongs to no sequence: 0."""
    return elements.withColumn("delta_t", F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(F.col("delta_t")))


def at_least(elements: DataFrame, min_len: int, lengths: DataFrame | None = None) -> DataFrame:
    """Keep sequences of at least ``min_len`` elements. A sequence is that long iff it has position ``min_len - 1``."""
    long_enough = lengths if lengths is not None else elements.filter(F.col("pos") == min_len - 1).select("seq_id")
    return elements.join(long_enough, "seq_id", "left_semi")


def cut(elements: DataFrame, max_len: int) -> DataFrame:
    """First ``max_len`` elements of every sequence."""
    return elements.filter(F.col("pos") < max_len)


def leave_room_for_start(elements: DataFrame, seq_len: int) -> DataFrame:
    """Drop the last element of sequences that already fill ``seq_len`` (sequences are cut to ``seq_len`` before)."""
    return elements.filter(F.col("pos") < seq_len - 1)


def to_arrays(elements: DataFrame, columns: Sequence[str], max_len: int | None) -> DataFrame:
    """One row per sequence with an array per column.

    ``max_len`` cuts the sequences to so many elements; ``None`` keeps all, for sequences known to fit in a row.
    """
    kept = elements if max_len is None else cut(elements, max_len)
    packed = kept.groupBy("seq_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("_e")
    )
    return packed.select("seq_id", *[F.col(f"_e.{c}").alias(c) for c in columns])


def to_elements(sequences: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inverse of :func:`to_arrays`."""
    opened = sequences.select("seq_id", F.posexplode(F.arrays_zip(*columns)).alias("pos", "_e"))
    return opened.select("seq_id", F.col("pos").cast("long").alias("pos"), *[f"_e.{c}" for c in columns])


def chunks(elements: DataFrame, size: int, columns: Sequence[str], seq_len: int | None = None, min_len: int = 0) -> DataFrame:
    """Count windows: each sequence cut to ``seq_len`` and split in pieces of ``size`` elements."""
    kept = at_least(elements, min_len) if min_len > 1 else elements
    kept = cut(kept, seq_len) if seq_len else kept
    packed = kept.groupBy("seq_id", F.floor(F.col("pos") / F.lit(size)).cast("long").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("_e")
    )
    return packed.select("seq_id", "chunk", *[F.col(f"_e.{c}").alias(c) for c in columns])


def next_event_windows(elements: DataFrame, width: int, pad: Column) -> DataFrame:
    """Sliding contexts of ``width`` keys and the key that follows: ``seq_id, start, context, next_key``.

    The last context of a sequence has the pad as its target; a sequence shorter than ``width`` is padded on the right.
    """
    def context(w):
        return F.collect_list(F.struct("pos", "key")).over(w.rowsBetween(1 - width, 0))

    seen = over_neighbours(
        elements.select("seq_id", "pos", "key"), ["seq_id"], "pos", width - 1, 1,
        {"_ctx": context, "_next": lambda w: F.lead("key").over(w)},
    )
    last = F.col("_next").isNull()
    full = F.size("_ctx") == width
    padded = F.slice(
        F.concat(F.col("_ctx.key"), F.array_repeat(pad, F.lit(width))), F.lit(1), F.lit(width)
    )
    return seen.filter(full | last).select(
        "seq_id",
        F.greatest(F.col("pos") - (width - 1), F.lit(0)).cast("long").alias("start"),
        padded.alias("context"),
        F.coalesce("_next", pad).alias("next_key"),
    )


def training_windows(elements: DataFrame, width: int, pad: Column, value: str, value_pad: Column) -> DataFrame:
    """:func:`next_event_windows` with a number of each element, such as the seconds since the one before, in step with the context:
    ``seq_id, start, context, values, next_key``. The pad has the value ``value_pad``."""
    def context(w):
        return F.collect_list(F.struct("pos", "key", value)).over(w.rowsBetween(1 - width, 0))

    seen = over_neighbours(
        elements.select("seq_id", "pos", "key", value), ["seq_id"], "pos", width - 1, 1, {"_ctx": context, "_next": lambda w: F.lead("key").over(w)}
    )
    kept = seen.filter((F.size("_ctx") == width) | F.col("_next").isNull())
    return kept.select(
        "seq_id", F.greatest(F.col("pos") - (width - 1), F.lit(0)).cast("long").alias("start"),
        truncate_or_pad(F.col("_ctx.key"), width, pad).alias("context"), truncate_or_pad(F.col(f"_ctx.{value}"), width, value_pad).alias("values"),
        F.coalesce("_next", pad).alias("next_key"),
    )


def required(found: Column, what: str, name: Column) -> Column:
    """``found``, or an error that names what was looked up without success."""
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit(f"no {what} for "), F.coalesce(name.cast("string"), F.lit("null")))))


def labelled_strictly(sessions: DataFrame, labels: DataFrame, by: str = "seq_id") -> DataFrame:
    """Sessions with their ``label`` from a table that must know all of them; an unknown session is an error."""
    found = sessions.join(labels.select(by, F.col("label").alias("_label")), by, "left")
    return found.withColumn("label", required(F.col("_label"), "label", F.col(by))).drop("_label")


def truncate_or_pad(values: Column, n: int | Column, fill: Column) -> Column:
    """Array cut or right-padded to exactly ``n`` entries."""
    return F.slice(F.concat(values, F.array_repeat(fill, n)), 1, n)


def length_distribution(summary: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """Number of sequences per class and length."""
    return summary.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("sequences"))
