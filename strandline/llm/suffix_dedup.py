"""Removal of byte strings that occur more than once, by suffix arrays over co-located segments.

A string of ``length`` bytes that starts at two places contains the same ``GRAM``-byte grams, so the same smallest gram hash.
Each window (start position) is keyed by its smallest gram; neighbouring windows that share one occurrence of it form a
segment. Equal windows therefore meet under one key:

1. segments are keyed and written without their text; keys of a single segment are dropped (most of the text);
2. segments with equal content are counted: a content that occurs twice is repeated as a whole;
3. the distinct contents of a key that has several are fetched, one copy each, and a suffix array is built over chunks of
   them. Two-stage sorting: suffixes smaller than their successor are sorted directly, the others are induced by scanning
   the buckets of the first byte in order. Neighbours with a common prefix of ``length`` bytes are repeated windows;
4. the contents of a hot key, one with more than ``GROUP`` of them, are cut once more, where the window's smallest grams in ``ORDERS``
   other orders of the hashes change: equal windows agree in them too, and windows that only touch a common passage do so rarely.
   These cuts go through 2 and 3 under their new keys. A key that is hot still is dealt to several chunks; there, one hash per
   distinct window and chunk is counted over all chunks, so no task holds a whole hot group and no repetition is missed;
5. the windows found are turned into byte ranges per document and cut out.

Defined cases: null and empty texts have no bytes; a document shorter than ``length`` loses nothing; rows repeated with
the same id and text are separate documents (so both lose what they share); ids may be null or repeated; other columns are
ignored. Matches never cross documents. Strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Hasher, Shared, grouped_ranges, mixed, slabs, small, text_bytes

LENGTH = 200
GRAM = 32
GROUP = 4000
ORDERS = 3
CHUNK = 1 << 20
SMALL_IDS = 1_000_000
POSITION_BITS = 24

SEGMENTS = "k1 bigint, k2 bigint, start bigint, n int, key bigint, content bigint"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all ``GRAM``-byte grams, by doubling."""
    with np.errstate(over="ignore"):
        h, width = mixed(data.astype(np.uint64) + np.uint64(77)), 1
        while width < GRAM:
            h = h[: len(h) - width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
            h ^= h >> np.uint64(29)
            width *= 2
        return h * np.uint64(0xD6E8FEB86659FD93)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(data: np.ndarray, offsets: np.ndarray, length: int, hasher: Hasher):
    """``(document, start in document, windows, key, content)`` of all segments of a slab of documents."""
    valid_to = offsets[1:] - length + 1  # first start position that no longer fits
    long_enough = np.flatnonzero(valid_to > offsets[:-1])
    if not len(long_enough):
        return None
    low = np.uint64((1 << POSITION_BITS) - 1)
    grams = gram_hashes(data)
    tagged = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    least = sliding_min(tagged, length - GRAM + 1)
    sizes = valid_to[long_enough] - offsets[long_enough]
    at = grouped_ranges(offsets[long_enough], sizes)
    owner = np.repeat(long_enough, sizes)
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start, document = at[first], owner[first]
    key = grams[(value[first] & low).astype(np.int64)]
    content = hasher.pieces(data, start, start + n + length - 1)
    return document, start - offsets[document], n, key, content


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Slabs as ``(first row, last row, first byte, last byte)``; a document too long for a position tag comes in
    overlapping parts that share no window."""
    most = (1 << POSITION_BITS) - 1
    for a, b in slabs(offsets):
        begin, end = int(offsets[a]), int(offsets[b])
        if end - begin <= most:
            yield a, b, begin, end
            continue
        step = most - length
        for at in range(begin, max(begin + 1, end - length + 1), step):
            yield a, b, at, min(end, at + step + length - 1)


def _segment_task(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(seed=7)
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        k1, k2 = (np.asarray(batch.column(c)) for c in ("k1", "k2"))
        columns: list[list] = [[] for _ in range(6)]
        for a, b, begin, end in _pieces(offsets, length):
            local = offsets[a : b + 1] - begin if b - a > 1 or end == offsets[b] and begin == offsets[a] else np.array([0, end - begin])
            found = segments(data[begin:end], local, length, hasher)
            if found is None:
                continue
            document, start, n, key, content = found
            start = start + begin - offsets[a] if b - a == 1 else start
            for out, value in zip(columns, (k1[a + document], k2[a + document], start, n, key.view(np.int64), content.view(np.int64))):
                out.append(value)
        if columns[0]:
            arrays = [np.concatenate(c) for c in columns]
            arrays[3] = arrays[3].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["k1", "k2", "start", "n", "key", "content"])


def finer_keys(piece: np.ndarray, key: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, windows, key)`` of the runs of windows of a segment whose smallest grams in all ``ORDERS`` orders stand in the same places."""
    grams = gram_hashes(piece)
    low = np.uint64((1 << POSITION_BITS) - 1)
    place = np.arange(len(grams), dtype=np.uint64) & low
    windows = len(piece) - length + 1
    new = np.zeros(windows, bool)
    new[0] = True
    keys = np.full(windows, np.uint64(key))
    with np.errstate(over="ignore"):
        for k in range(ORDERS):
            turned = mixed(grams ^ np.uint64(0xA24BAED4963EE407 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
            least = sliding_min((turned & ~low) | place, length - GRAM + 1)
            new[1:] |= least[1:] != least[:-1]
            keys = mixed(keys * np.uint64(0xC2B2AE3D27D4EB4F) + turned[(least & low).astype(np.int64)])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, windows)), keys[first]


FINER = "k1 bigint, k2 bigint, start bigint, n int, key bigint, content bigint, offset int, key2 bigint, content2 bigint"


def _finer_task(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the wanted segments of hot keys by their finer keys."""
    schema = pa.schema([(f.split()[0], {"bigint": pa.int64(), "int": pa.int32()}[f.split()[1]]) for f in FINER.split(", ")])
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        k1, k2, wanted = (batch.column(c).to_pylist() for c in ("k1", "k2", "wanted"))
        rows: list[tuple] = []
        for i, ws in enumerate(wanted):
            for w in ws:
                begin = int(offsets[i]) + w["start"]
                piece = data[begin : begin + w["n"] + length - 1]
                for first, n, key in zip(*(x.tolist() for x in finer_keys(piece, w["key"] & 0xFFFFFFFFFFFFFFFF, length))):
                    content = xxhash.xxh3_64_intdigest(piece[first : first + n + length - 1].tobytes())
                    signed = [x - (1 << 64) if x >> 63 else x for x in (key, content)]
                    rows.append((k1[i], k2[i], w["start"] + first, n, w["key"], w["content"], first, *signed))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


# ---- suffix array -----------------------------------------------------------------------------------------------


def suffix_array(data: bytes, ends: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of the strings that end at ``ends`` (covering ``data``), in order of their first ``depth`` bytes.

    A string's end is smaller than any byte. A suffix is *small* if it is less than the suffix one byte on, else *large*;
    the last of a string is large. Small ones are sorted directly. Within the bucket of a first byte the large come before
    the small, and a large suffix has a lower bucket's, or an earlier, suffix as its successor: going through the buckets in
    order and through each from its start, every suffix met hands its predecessor, if large, to the end of the large
    part of that bucket. A bucket's entries are handed on together; runs of one byte take a round for each repetition.
    """
    text = np.frombuffer(data, np.uint8)
    n = len(text)
    final = np.zeros(n, bool)
    final[ends - 1] = True
    after = np.append(text[1:], 0)
    differs = np.flatnonzero((text != after) | final)
    decides = differs[np.searchsorted(differs, np.arange(n))]
    is_small = (text[decides] < after[decides]) & ~final[decides]
    small = np.flatnonzero(is_small)
    stop = np.repeat(ends, np.diff(np.append(0, ends)))
    slices = [data[i : min(i + depth, e)] for i, e in zip(small.tolist(), stop[small].tolist())]
    small = small[sorted(range(len(slices)), key=slices.__getitem__)]
    del slices
    small_from = np.searchsorted(text[small], np.arange(257))
    incoming: list[list[np.ndarray]] = [[] for _ in range(256)]

    def hand_on(suffixes: np.ndarray) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[~final[before] & ~is_small[before]]
        if len(before):
            before = before[np.argsort(text[before], kind="stable")]
            bytes_, first = np.unique(text[before], return_index=True)
            for c, part in zip(bytes_.tolist(), np.split(before, first[1:])):
                incoming[c].append(part)

    hand_on_ends = ends - 1  # the empty suffix precedes all: it hands on the last byte of each string
    for c in np.unique(text[hand_on_ends]).tolist():
        incoming[c].append(hand_on_ends[text[hand_on_ends] == c])
    out = []
    for c in range(256):
        done = 0
        while done < len(incoming[c]):
            part = incoming[c][done]
            done += 1
            out.append(part)
            hand_on(part)
        mine = small[small_from[c] : small_from[c + 1]]
        if len(mine):
            out.append(mine)
            hand_on(mine)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefix_reaches(text: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes at ``left`` and ``right`` agree on ``depth`` bytes, eight at a time."""
    padded = np.append(text, np.zeros(8, np.uint8))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    same, at = np.ones(len(left), bool), 0
    live = np.arange(len(left))
    while at < depth and len(live):
        at = min(at, depth - 8)
        equal = (words[left[live] + at] == words[right[live] + at]).all(axis=1)
        same[live[~equal]] = False
        live, at = live[equal], at + 8
    return same


def repeated_windows(pieces: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(start, class)`` of all windows of ``depth`` bytes in the concatenated pieces; equal windows have equal classes."""
    data = b"".join(pieces)
    ends = np.cumsum([len(p) for p in pieces])
    order = suffix_array(data, ends, depth)
    stop = np.repeat(ends, np.diff(np.append(0, ends)))
    order = order[order + depth <= stop[order]]
    new = np.ones(len(order), bool)
    new[1:] = ~common_prefix_reaches(np.frombuffer(data, np.uint8), order[:-1], order[1:], depth)
    return order, np.cumsum(new) - 1


def _chunk(rows: list[tuple], depth: int) -> Iterator[tuple]:
    """Rows ``(key, content, hot, text)`` to ``(key, content, first, last, w1, w2)``: ranges of repeated windows, and for hot keys
    one row with the window's hash for each distinct window (``last`` is first + 1; ``lone`` marks those not yet known)."""
    pieces = [r[3] for r in rows]
    begins = np.append(0, np.cumsum([len(p) for p in pieces]))
    at, group = repeated_windows(pieces, depth)
    if not len(at):
        return
    counts = np.bincount(group)
    piece = np.searchsorted(begins, at, side="right") - 1
    repeated = np.zeros(begins[-1] + 1, bool)
    repeated[at[counts[group] > 1]] = True
    # Windows of one piece are consecutive starts, so a run never leaves its piece: the last depth-1 bytes hold none.
    padded = np.concatenate([[False], repeated, [False]])
    first, last = np.flatnonzero(padded[1:] & ~padded[:-1]), np.flatnonzero(padded[:-1] & ~padded[1:])
    for f, l in zip(first.tolist(), last.tolist()):
        i = int(np.searchsorted(begins, f, side="right")) - 1
        yield rows[i][0], rows[i][1], f - int(begins[i]), l - int(begins[i]), None, None, False
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for j in heads.tolist():
        i = int(piece[j])
        if rows[i][2]:
            start = int(at[j] - begins[i])
            digest = xxhash.xxh3_128_digest(pieces[i][start : start + depth])
            w = np.frombuffer(digest, np.int64)
            yield rows[i][0], rows[i][1], start, start + 1, int(w[0]), int(w[1]), bool(counts[group[j]] == 1)


FOUND = "key bigint, content bigint, first int, last int, w1 bigint, w2 bigint, lone boolean"


def _suffix_task(depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive in order of (key, part); chunks are cut between those."""
    schema = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("lone", pa.bool_())])
    rows: list[tuple] = []
    size, last = 0, None

    def flush():
        found = list(_chunk(rows, depth))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    for batch in batches:
        for key, part, content, hot, text in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "content", "hot", "piece"))):
            if size >= CHUNK and (key, part) != last:
                yield from flush()
                rows, size = [], 0
            rows.append((key, content, hot, text))
            size, last = size + len(text), (key, part)
    if rows:
        yield from flush()


# ---- plan -------------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Documents with a 128-bit row key made of id and text: rows that are equal in both share one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        *columns, text.alias("text"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit("second"), text, "doc_id").alias("k2")
    )


def _fetch_task(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the wanted segments out of their documents."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        wanted = batch.column("wanted").to_pylist()
        rows = [
            (w["key"], w["part"], w["content"], w["hot"], data[offsets[i] + w["start"] : offsets[i] + w["start"] + w["n"] + length - 1].tobytes())
            for i, ws in enumerate(wanted) for w in ws
        ]
        for k in range(0, len(rows), 20_000):
            key, part, content, hot, piece = zip(*rows[k : k + 20_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(part, pa.int32()), pa.array(content, pa.int64()), pa.array(hot, pa.bool_()), pa.array(piece, pa.binary())],
                names=["key", "part", "content", "hot", "piece"],
            )


def _with_texts(keyed: DataFrame, asked: DataFrame, fields: tuple[str, ...], shared: Shared, name: str) -> DataFrame:
    """The documents that ``asked`` names by ``k1, k2``, with the list ``wanted`` of its ``fields``."""
    wanted = shared.write(asked.groupBy("k1", "k2").agg(F.collect_list(F.struct(*fields)).alias("wanted")), name)
    shared.settle()
    ids = small(wanted.select("k1", "k2"), SMALL_IDS)
    # Equal rows give the same segments twice; one of each is enough.
    return keyed.join(ids, ["k1", "k2"], "left_semi").join(wanted, ["k1", "k2"])


def repeated_ranges(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``(k1, k2, ranges)``: for each row key with repeated strings, the byte ranges ``[first, last)`` they cover; written, and no
    other table of the run stays."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    spark = docs.sparkSession
    shared = Shared(spark)
    keyed = _keyed(docs)
    all_segments = shared.write(keyed.mapInArrow(lambda b: _segment_task(length, b), SEGMENTS), "segments")
    keys = all_segments.groupBy("key").agg(F.count("*").alias("places")).where("places > 1").select("key")
    # Both sides of the join come from tables, so that Spark can split a hot key's partition.
    keys = shared.write(keys, "keys")
    shared.settle()
    places = shared.write(all_segments.join(keys, "key"), "places")
    shared.drop("segments", "keys")
    shared.settle()
    contents = shared.write(
        places.groupBy("key", "content").agg(
            F.count("*").alias("times"), F.min(F.struct("k1", "k2", "start", "n")).alias("one")
        ),
        "contents",
    )
    whole = contents.where("times > 1").select("key", "content", F.lit(0).alias("first"), F.col("one.n").alias("last"))
    several = contents.groupBy("key").agg(F.count("*").alias("contents")).where("contents > 1")
    several = shared.write(several, "several")
    asked = contents.join(several.where(F.col("contents") <= group).select("key"), "key").select(
        "one.*", "key", "content", F.lit(False).alias("hot"), F.lit(0).alias("part")
    )
    hot = contents.join(several.where(F.col("contents") > group).select("key"), "key").select("one.*", "key", "content")
    finer = None
    if several.where(F.col("contents") > group).limit(1).count():
        rows = _with_texts(keyed, hot, ("key", "content", "start", "n"), shared, "hot")
        finer = shared.write(rows.mapInArrow(lambda b: _finer_task(length, b), FINER), "finer")
        cuts = finer.groupBy("key2", "content2").agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "start", "n")).alias("one"))
        cuts = shared.write(cuts.withColumnsRenamed({"key2": "key", "content2": "content"}), "cuts")
        again = cuts.groupBy("key").agg(F.count("*").alias("contents")).where("contents > 1")
        parts = F.ceil(F.col("contents") / group).cast("int")
        asked = asked.unionByName(cuts.join(again, "key").select(
            "one.*", "key", "content", (parts > 1).alias("hot"), F.pmod(F.xxhash64("content"), parts).cast("int").alias("part")
        ))
    rows = _with_texts(keyed, asked, ("key", "part", "content", "hot", "start", "n"), shared, "wanted")
    pieces = rows.mapInArrow(lambda b: _fetch_task(length, b), "key bigint, part int, content bigint, hot boolean, piece binary")
    dealt = pieces.repartition("key", "part").sortWithinPartitions("key", "part")
    found = shared.write(dealt.mapInArrow(lambda b: _suffix_task(length, b), FOUND), "found")
    shared.drop("wanted", "hot")
    shared.settle()
    ranges = whole.unionByName(found.where("w1 is null").select("key", "content", "first", "last"))
    windows = found.where("w1 is not null")
    shared_windows = windows.groupBy("w1", "w2").agg(F.count("*").alias("chunks")).where("chunks > 1")
    late = windows.where("lone").join(shared_windows, ["w1", "w2"]).select("key", "content", "first", "last")
    ranges = ranges.unionByName(late)
    if finer is not None:
        # Ranges of the cuts belong to the contents they were cut from; a cut found twice is repeated as a whole.
        twice = cuts.where("times > 1").select("key", "content", F.lit(0).alias("first"), F.col("one.n").alias("last"))
        cut_from = finer.select("key", "content", "offset", "key2", "content2")
        of_cuts = ranges.unionByName(twice).withColumnsRenamed({"key": "key2", "content": "content2"}).join(cut_from, ["key2", "content2"])
        ranges = ranges.unionByName(of_cuts.select("key", "content", (F.col("offset") + F.col("first")).alias("first"), (F.col("offset") + F.col("last")).alias("last")))
    bytes_ = F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last") + length - 1).alias("last"))
    ranges = places.join(ranges, ["key", "content"]).groupBy("k1", "k2").agg(F.collect_set(bytes_).alias("ranges"))
    ranges = Shared(spark).write(ranges, "ranges")
    shared.clear()
    shared.settle()
    return ranges


def merged_ranges(ranges: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, non-adjacent ranges with the same cover."""
    if not ranges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cover = np.zeros(size + 1, np.int64)
    first, last = np.array([[r["first"], r["last"]] for r in ranges], np.int64).T
    np.add.at(cover, first, 1)
    np.add.at(cover, last, -1)
    inside = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


def whole_characters(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges shrunk so that no character is cut."""
    continues = lambda i: i < len(data) and (int(data[i]) & 0xC0) == 0x80
    out = []
    for f, l in zip(first.tolist(), last.tolist()):
        while f < l and continues(f):
            f += 1
        while l > f and continues(l):
            l -= 1
        if l > f:
            out.append((f, l))
    return (np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64))


def _cut_task(whole: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the ranges cut out and what is left."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        sizes, removed, spans, kept = [], [], [], []
        for i, ranges in enumerate(batch.column("ranges").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            first, last = merged_ranges(ranges, len(text))
            if whole:
                first, last = whole_characters(text, first, last)
            left = text
            if len(first):
                keep = np.ones(len(text), bool)
                keep[grouped_ranges(first, last - first)] = False
                left = text[keep]
            sizes.append(len(text)), removed.append(int((last - first).sum())), spans.append(len(first)), kept.append(left.tobytes())
        names = ["doc_id", "carried"]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in names], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary()),
            ],
            names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


CUT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def cut(docs: DataFrame, length: int = LENGTH, whole: bool = False, keep: tuple[str, ...] = (), group: int = GROUP) -> DataFrame:
    """Each document with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, the bytes ``kept``, and a struct ``carried`` of
    ``no_text``, whether its text is null, and ``columns``, a struct of the columns ``keep``.

    ``whole``: leave characters that are not covered as a whole, so that ``kept`` is valid UTF-8.
    """
    ranges = repeated_ranges(docs, length, group)
    carried = F.struct(F.col("text").isNull().alias("no_text"), F.struct(F.lit(0).alias("_"), *keep).alias("columns"))
    packed = docs.select("doc_id", "text", carried.alias("carried"))
    rows = _keyed(packed, "doc_id", "carried").join(ranges, ["k1", "k2"], "left")
    fields = [packed.schema["doc_id"], packed.schema["carried"]]
    return rows.mapInArrow(lambda b: _cut_task(whole, b), T.StructType(fields + T._parse_datatype_string(CUT).fields))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents with their repeated strings cut out at whole characters, and ``n_chars`` where there is one; a null text
    stays null."""
    columns = docs.columns
    # The text is sent once, to be cut, and comes back as what is kept.
    made = cut(docs, whole=True, keep=tuple(c for c in columns if c != "text"), **options)
    text = F.when(~F.col("carried.no_text"), F.col("kept").cast("string"))
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {})
    return made.select(*[new.get(c, F.col("carried.columns").getField(c)).alias(c) for c in columns])


def report(docs: DataFrame, **options) -> DataFrame:
    """The digest columns of the registered query."""
    return cut(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
