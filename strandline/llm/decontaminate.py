"""Benchmark decontamination by multi-pattern search with block shifts over words.

Benchmark items become windows of ``window`` consecutive words (a shorter item is one window). A task hashes the words of
its documents and moves cursors over them: the hash of the block under a cursor indexes a shift table; a positive shift
jumps over positions where no window can end. Where the shift is zero, the block selects the bucket of windows with that
last block, their first block and word hashes are compared, and at last the words themselves.

Defined cases: null and empty texts have no words, no hits and are not contaminated; an item without words has no window;
items that share a window all count; repeated documents are judged row by row; an empty benchmark leaves every document
clean. Other columns of either table are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, Hasher, byte_class, chained, grouped_ranges, lists, slabs, text_bytes, word_bounds

WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
BLOCK_BITS = 18
REGION = 192
ITEM_BYTES = 16 << 20


def item_windows(texts: list[str | None], window: int) -> list[tuple[int, tuple[bytes, ...]]]:
    """``(item index, words)`` of every window of every item."""
    out = []
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode(), np.uint8)
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]), WORD)
        folded = FOLD[data]
        words = [folded[a:b].tobytes() for a, b in zip(starts, ends)]
        n = min(window, len(words))
        out += [(i, tuple(words[k : k + n])) for k in range(len(words) - n + 1) if n]
    return out


class Patterns:
    """The windows of one length: shift table, suffix buckets and the item lists of each distinct window."""

    def __init__(self, length: int, windows: list[tuple[int, tuple[bytes, ...]]], hasher: Hasher) -> None:
        self.length, self.block = length, min(2, length)
        owners: dict[tuple[bytes, ...], set[int]] = {}
        for item, words in windows:
            owners.setdefault(words, set()).add(item)
        self.words = list(owners)
        self.items = [np.array(sorted(owners[w])) for w in self.words]
        flat = [w for words in self.words for w in words]
        data = np.frombuffer(b"".join(flat), np.uint8)
        ends = np.cumsum([len(w) for w in flat])
        hashes = hasher.pieces(data, ends - np.array([len(w) for w in flat]), ends).reshape(len(self.words), length)
        blocks = np.stack([chained(row, self.block) for row in hashes])
        order = np.argsort(blocks[:, -1], kind="stable")
        self.words = [self.words[i] for i in order]
        self.items = [self.items[i] for i in order]
        self.hashes, blocks = hashes[order], blocks[order]
        last = blocks.shape[1] - 1
        self.shifts = np.full(1 << BLOCK_BITS, last + 1, np.int64)
        for j in range(last + 1):
            slot = self.slot(blocks[:, j])
            np.minimum.at(self.shifts, slot, last - j)
        self.suffix, self.bucket = np.unique(blocks[:, -1], return_index=True)
        self.bucket = np.append(self.bucket, len(order))
        self.first = blocks[:, 0]

    @staticmethod
    def slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)

    def candidates(self, blocks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Last-word positions where the block has shift zero. ``bounds``: word offsets of the documents."""
        begin, end = bounds[:-1] + self.length - 1, bounds[1:]
        regions = np.maximum(0, -(-(end - begin) // REGION))
        document = np.repeat(np.arange(len(begin)), regions)
        cursor = grouped_ranges(np.zeros(len(begin)), regions) * REGION + begin[document]
        stop = np.minimum(cursor + REGION, end[document])
        slots, found = self.slot(blocks), []
        while len(cursor):
            step = self.shifts[slots[cursor - self.block + 1]]
            found.append(cursor[step == 0])
            cursor = cursor + np.maximum(step, 1)
            left = cursor < stop
            cursor, stop = cursor[left], stop[left]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, bounds: np.ndarray):
        """``(first word position, window)`` of all occurrences."""
        blocks = chained(hashes, self.block)
        at = self.candidates(blocks, bounds)
        if not len(at):
            return at, at
        value = blocks[at - self.block + 1]
        bucket = np.minimum(np.searchsorted(self.suffix, value), len(self.suffix) - 1)
        right = self.suffix[bucket] == value
        at, bucket = at[right], bucket[right]
        sizes = self.bucket[bucket + 1] - self.bucket[bucket]
        window, at = grouped_ranges(self.bucket[bucket], sizes), np.repeat(at, sizes) - self.length + 1
        right = blocks[at] == self.first[window]
        at, window = at[right], window[right]
        right = (hashes[at[:, None] + np.arange(self.length)] == self.hashes[window]).all(axis=1)
        at, window = at[right], window[right]
        same = np.fromiter(
            (all(data[starts[p + k] : ends[p + k]].tobytes() == w for k, w in enumerate(self.words[i])) for p, i in zip(at, window)),
            bool, len(at),
        )
        return at[same], window[same]


class Searcher:
    """All windows of some items, by length."""

    def __init__(self, ids: list, texts: list[str | None], window: int) -> None:
        self.ids, self.hasher = [str(i) for i in ids], Hasher()
        windows = item_windows(texts, window)
        self.by_length = [Patterns(n, [w for w in windows if len(w[1]) == n], self.hasher) for n in sorted({len(w[1]) for w in windows})]

    def search(self, data: np.ndarray, offsets: np.ndarray):
        """Words of each document, its merged hit runs as word ranges, and its items."""
        starts, ends, bounds = word_bounds(data, offsets, WORD)
        folded = FOLD[data]
        hashes = self.hasher.pieces(folded, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        n, cover = len(offsets) - 1, np.zeros(len(starts) + 1, np.int64)
        pairs = []
        for patterns in self.by_length:
            at, window = patterns.occurrences(folded, starts, ends, hashes, bounds)
            if len(at):
                np.add.at(cover, at, 1)
                np.add.at(cover, at + patterns.length, -1)
                document = np.searchsorted(bounds, at, side="right") - 1
                sizes = np.array([len(patterns.items[w]) for w in window])
                items = np.concatenate([patterns.items[w] for w in window])
                pairs.append(np.stack([np.repeat(document, sizes), items], axis=1))
        hit = np.cumsum(cover)[:-1] > 0
        edge = np.zeros(len(starts) + 1, bool)
        edge[bounds] = True
        padded = np.concatenate([[False], hit, [False]])
        first = np.flatnonzero(padded[1:-1] & (~padded[:-2] | edge[:-1]))
        last = np.flatnonzero(padded[1:-1] & (~padded[2:] | edge[1:])) + 1
        found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        owner = np.searchsorted(bounds, first, side="right") - 1
        run_counts = np.bincount(owner, minlength=n)
        return np.diff(bounds), first - bounds[owner], last - bounds[owner], run_counts, found


RAW = "n_words bigint, runs array<struct<first:bigint,last:bigint>>, items array<string>"


def _search_task(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    searcher = Searcher(*sent.value)
    names = np.array(searcher.ids, dtype=object)
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        words, first, last, counts, items, item_counts = [], [], [], [], [], []
        for a, b in slabs(offsets):
            n_words, f, l, c, found = searcher.search(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            words.append(n_words), first.append(f), last.append(l), counts.append(c)
            items.append(names[found[:, 1]])
            item_counts.append(np.bincount(found[:, 0], minlength=b - a))
        if not words:
            continue
        runs = pa.StructArray.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(last))], names=["first", "last"])
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"],
                pa.array(np.concatenate(words)), lists(runs, np.concatenate(counts)),
                lists(pa.array(list(np.concatenate(items)), pa.string()), np.concatenate(item_counts)),
            ],
            names=[*[c for c in batch.schema.names if c != "text"], "n_words", "runs", "items"],
        )


def _union_runs(runs):
    """Runs of several item blocks merged, in SQL."""
    ordered = F.array_sort(runs)
    empty = F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")

    def add(acc, run):
        tail = F.element_at(acc, -1)
        joined = F.struct(tail["first"].alias("first"), F.greatest(tail["last"], run["last"]).alias("last"))
        return F.when((F.size(acc) > 0) & (run["first"] < tail["last"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(
            F.concat(acc, F.array(run))
        )

    return F.aggregate(ordered, empty, add)


def occurrences(docs: DataFrame, items: DataFrame, window: int = 13, item_bytes: int = ITEM_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``keep`` columns, ``n_words``, hit ``runs`` as word ranges, and sorted ``items``.

    Items reach the tasks in blocks of about ``item_bytes`` of text, one pass over the documents for each block, so no
    broadcast outgrows that bound; usually there is one block.
    """
    spark = docs.sparkSession
    items = items.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // item_bytes) + 1
    fields = [docs.schema["doc_id"], *[docs.schema[c] for c in keep]]
    schema = T.StructType(fields + T._parse_datatype_string(RAW).fields)
    # Rows are told apart by their content when blocks are merged; equal rows give equal results.
    source = docs.select("doc_id", *keep, "text")
    parts = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows], window))
        task = lambda batches, sent=sent: _search_task(sent, batches)
        if blocks == 1:
            found = source.mapInArrow(task, schema)
        else:
            keyed = source.withColumn("row_key", F.sha2(F.coalesce("text", F.lit("")), 256))
            found = keyed.mapInArrow(task, T.StructType(fields + [T.StructField("row_key", T.StringType())] + T._parse_datatype_string(RAW).fields))
        parts.append(found)
    if blocks == 1:
        return parts[0].withColumn("items", F.array_sort(F.array_distinct("items")))
    every = parts[0].withColumn("block", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("block", F.lit(k)))
    merged = every.groupBy("doc_id", *keep, "row_key").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"),
        (F.count("*") / F.lit(blocks)).cast("int").alias("copies"),
    )
    merged = merged.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("_copy", "copies", "row_key")
    return merged.withColumn("runs", _union_runs(F.array_distinct("runs"))).withColumn("items", F.array_sort(F.array_distinct("items")))


def judged(found: DataFrame, one_in: int = 20) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: at least one word in ``one_in`` lies inside an occurrence."""
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda acc, r: acc + r["last"] - r["first"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The digest columns of the registered query."""
    return judged(occurrences(docs, items, **options)).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    columns = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*columns).alias("carried"))
    flagged = judged(occurrences(packed, items, keep=("carried",), **options))
    return flagged.where(~F.col("contaminated")).select(*[F.col("carried").getField(c).alias(c) for c in columns])
