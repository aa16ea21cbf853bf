"""Exact Jaccard self-join of word n-gram sets by prefix trees, as components of linked documents.

Each distinct n-gram set is one *class* (copies are only counted). Its n-grams are put in one global order, rare before
frequent: n-grams that are frequent within some batch are counted, and the most frequent of them, at most ``FREQUENT``,
come last by count; all others are in hash order. The order decides the work, never the result. Two sets with the needed
overlap share an n-gram among their first ``size - needed + 1``, so only those prefixes are exchanged:

1. prefix entries whose n-gram occurs in one class are dropped;
2. *star rounds*, for groups (classes that share a prefix n-gram) of ``STAR_GROUP`` members or more: a group is joined
   against a few chosen members; verified links collapse groups of near copies, and groups whose members are all connected
   are finished;
3. *full round*: what is left of each group is stored in a tree of its remaining prefixes in global order. All members walk
   it together, level by level, sharing the overlap found so far on common paths, and leave a subtree once the overlap plus
   what remains of either set cannot reach the bound. A group of more than ``CELL`` members is cut in blocks, a task for
   each pair of blocks, so no task holds a hot group;
   Large groups have a round before in which a class takes a few partners of each other component only;
4. every set has a *sketch*: the parities of its n-grams' numbers in ``bits`` buckets. Two sets differ in an n-gram at least for
   each parity in which they differ, so a pair that differs in more parities than a linked pair may differ in n-grams is no link
   and goes, for tree pairs in the task that finds them. No link is lost;
5. candidate pairs between different components that are left are verified on the whole sets.

Defined cases: null and empty texts and texts without words have empty sets, link with nothing and are their own
component; repeated rows share a class; of repeated ids the smallest counts; a document without id takes the component of
the documents with its set, else null. Other columns are ignored. n-grams are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, Hasher, Shared, byte_class, chained, grouped_ranges, lists, mixed, slabs, small, text_bytes, word_bounds, word_hashes
from .components import components

WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D))
FREQUENT = 1 << 17
CELL = 1000
MATRIX = 1 << 22
ENOUGH = 12
TAIL = 16
CELL_ROWS = 1 << 16
SKETCH_PAIRS = 1 << 12
LEAVING = 1 << 19
FEW = 3
CELL_GRAMS = 1 << 21
CELL_PAIRS = 1024
STAR_ROUNDS = 6
CENTRES = 2
ASKED = 4
STAR_GROUP = 50
SMALL_IDS = 1_000_000
SMALL_WANTED = 300_000


def needed(total, percent: int):
    """Smallest overlap of two sets whose sizes add up to ``total``: ``100 * overlap >= percent * union``."""
    return -(-percent * total // (100 + percent))


def sketch_bits(size: np.ndarray, percent: int) -> np.ndarray:
    """Parities a set is sketched by: a power of two, four to eight times the n-grams in which linked sets of its size differ,
    so that sets that differ in one and a half times as many seldom pass."""
    apart = 2 * size - 2 * needed(2 * size, percent)
    return np.where(size > 0, 1 << np.ceil(np.log2(np.maximum(4 * apart, 64))).astype(np.int64), 0)


def sketches(owner: np.ndarray, value: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of sets, one behind the other, and how many 64-bit words each has."""
    bits = sketch_bits(size, percent)
    begin = np.cumsum(bits) - bits
    spot = begin[owner] + (value & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(spot, minlength=int(bits.sum())) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64), bits // 64


class Sketches:
    """Sketches of rows, to be compared in pairs. One of more words is folded to the length of the other."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray) -> None:
        self.words, self.lengths, self.begin = words, lengths, np.cumsum(lengths) - lengths

    def part(self, low: int, high: int) -> Sketches:
        ends = np.append(self.begin, len(self.words))
        return Sketches(self.words[ends[low] : ends[high]], self.lengths[low:high])

    def folded(self, rows: np.ndarray, length: int, short: int) -> np.ndarray:
        words = self.words[self.begin[rows][:, None] + np.arange(length)]
        return np.bitwise_xor.reduce(words.reshape(len(rows), length // short, short), axis=1)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many n-grams at least the sets of each pair of rows differ."""
        out = np.zeros(len(a), np.int64)
        kinds, kind = np.unique(np.stack([self.lengths[a], self.lengths[b]], axis=1), axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        for k, (x, y) in enumerate(kinds.tolist()):
            step = max(1, SKETCH_PAIRS * 64 // max(x, y))
            at = np.flatnonzero(kind == k)
            for low in range(0, len(at), step):
                some = at[low : low + step]
                differ = self.folded(a[some], x, min(x, y)) ^ self.folded(b[some], y, min(x, y))
                out[some] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
        return out


def shingles(data: np.ndarray, offsets: np.ndarray, n: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """``(document, hash)`` of all n-grams of the documents of a slab, with repetitions, in text order."""
    starts, ends, bounds = word_bounds(data, offsets, WORD)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = word_hashes(hasher, FOLD[data], starts, ends)
    counts = np.diff(bounds)
    full = np.flatnonzero(counts >= n)
    owner = np.repeat(full, counts[full] - n + 1)
    grams = chained(words, n)
    value = grams[grouped_ranges(bounds[full], counts[full] - n + 1)]
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        whole = np.concatenate([chained(words[bounds[i] : bounds[i + 1]], int(counts[i])) for i in few])
        owner, value = np.concatenate([owner, few]), np.concatenate([value, whole])
    return owner, value


def _frequent_task(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams that fill a noticeable part of some batch, with their counts in it."""
    hasher = Hasher(3)
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        parts = [shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n, hasher)[1] for a, b in slabs(offsets)]
        if parts:
            value, count = np.unique(np.concatenate(parts), return_counts=True)
            often = count >= max(8, batch.num_rows // 250)
            yield pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(count[often])], names=["token", "times"])


class Order:
    """The global order as a rank pair: frequent n-grams after all others, by count."""

    def __init__(self, tokens: np.ndarray, times: np.ndarray) -> None:
        order = np.argsort(tokens)
        self.tokens, self.times = tokens[order], times[order]

    def weight(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.times[at], 0)

    def sort(self, owner: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return np.lexsort((tokens, self.weight(tokens), owner))


def _sets_task(n: int, percent: int, sent, whole: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's set: size, 128-bit digest, and its ordered prefix and sketch (or, if ``whole``, all of it sorted by hash)."""
    hasher, order = Hasher(3), Order(*sent.value)
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        sizes, first, second, tokens, lengths, words, wide = [], [], [], [], [], [], []
        for a, b in slabs(offsets):
            owner, value = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n, hasher)
            at = np.lexsort((value, owner))
            owner, value = owner[at], value[at]
            new = np.ones(len(value), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
            owner, value = owner[new], value[new]
            size = np.bincount(owner, minlength=b - a)
            begin = np.cumsum(size) - size
            with np.errstate(over="ignore"):
                for out, seed in ((first, 11), (second, 13)):
                    total = np.append(np.uint64(0), np.cumsum(mixed(value + np.uint64(seed)), dtype=np.uint64))
                    out.append(total[begin + size] - total[begin])
            take = size
            if not whole:
                some, width = sketches(owner, value, size, percent)
                words.append(some), wide.append(width)
                value = value[order.sort(owner, value)]
                take = np.where(size > 0, size - -(-percent * size // 100) + 1, 0)
                value = value[grouped_ranges(begin, take)]
            sizes.append(size), tokens.append(value), lengths.append(take)
        if sizes:
            signed = lambda parts: pa.array(np.concatenate(parts).view(np.int64))
            columns = [batch.column("doc_id"), pa.array(np.concatenate(sizes).astype(np.int64)), signed(first), signed(second), lists(signed(tokens), np.concatenate(lengths))]
            if not whole:
                columns.append(lists(signed(words), np.concatenate(wide)))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "d1", "d2", "tokens", "sketch"][: len(columns)])


# ---- tree -------------------------------------------------------------------------------------------------------


class Cells:
    """Rows of whole cells: sets that share an n-gram at position ``at`` of their order, with the n-grams after it up to
    their prefix length (``flat``, ``lengths``), and their sketches. Rows of one cell follow each other."""

    def __init__(self, cell, vertex, root, size, at, side, cross, flat, lengths, sketches=None) -> None:
        self.cell, self.vertex, self.root, self.size, self.at, self.side, self.cross, self.flat, self.lengths = cell, vertex, root, size, at, side, cross, flat, lengths
        self.sketches = sketches

    def part(self, low: int, high: int) -> Cells:
        ends = np.append(0, np.cumsum(self.lengths))
        rows = [x[low:high] for x in (self.cell, self.vertex, self.root, self.size, self.at, self.side, self.cross)]
        return Cells(*rows, self.flat[ends[low] : ends[high]], self.lengths[low:high], self.sketches and self.sketches.part(low, high))


def tree_pairs(cells: Cells, percent: int, order: Order) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs ``(query rows, stored rows)`` of the cells, all cells at once.

    The forest is the sorted matrix of ranked tails: a node is a range of rows with a common path. Above a cell's tails it
    branches by size (so that sizes in a subtree are within the ratio) and by the share of the set that lies behind. A path
    ends where the bound fails, at the end of a tail, or where ``ENOUGH`` n-grams are common: such pairs are near enough to
    be verified, and meet in many cells. It also ends at a stored n-gram behind the end of the query's tail: it and all
    after it may or may not be in the unsent rest of the query, so they count as what remains. Pairs at the end of a path are
    compared by their sketches.
    """
    size, at, g = cells.size, cells.at, len(cells.size)
    every, flat = np.unique(cells.flat, return_inverse=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, order.weight(every)))] = np.arange(len(every))
    lengths, ranked = cells.lengths, rank[flat]
    begin, width = np.cumsum(lengths) - lengths, int(lengths.max(initial=0))
    text = ranked.astype(">u4").tobytes()
    band = np.floor(np.log(size) / np.log(100 / percent)).astype(np.int64)
    behind = at * 32 // size
    keys = list(zip(cells.cell.tolist(), band.tolist(), behind.tolist(), [text[4 * b : 4 * (b + n)] for b, n in zip(begin.tolist(), lengths.tolist())]))
    rows = np.array(sorted(range(g), key=keys.__getitem__), np.int64)
    matrix = np.full((g, width + 1), -1, np.int32)
    matrix[np.repeat(np.arange(g), lengths), grouped_ranges(np.zeros(g), lengths)] = ranked
    matrix = matrix[rows]
    stored_size, stored_left = size[rows], (size - at - 1)[rows]
    scale = len(every) + 1
    held = np.repeat(np.arange(g), lengths) * scale + ranked  # sorted: tails are in global order

    def bounds(new: np.ndarray):
        heads = np.flatnonzero(new)
        return heads, np.append(heads[1:], g), np.minimum.reduceat(stored_size, heads), np.maximum.reduceat(stored_size, heads), np.maximum.reduceat(stored_left, heads)

    def leave(query: np.ndarray, low: np.ndarray, high: np.ndarray, overlap: np.ndarray, rest: np.ndarray, walked: int):
        """The pairs of queries with the rows of a node, as far as sizes, components and the bound of each row allow:
        ``rest`` n-grams of the query and all but ``walked`` of the stored tail may still be common."""
        counts = high - low
        total = np.cumsum(counts)
        if len(total) > 1 and total[-1] > LEAVING:
            # Many pairs at once are taken in turns, as few of them may be left.
            cut = np.flatnonzero(np.diff(total // LEAVING, prepend=0)).tolist()
            for first, last in zip([0, *cut], [*cut, len(total)]):
                if first < last:
                    yield from some_leave(*(x[first:last] for x in (query, low, high, overlap, rest)), walked)
        else:
            yield from some_leave(query, low, high, overlap, rest, walked)

    def some_leave(query: np.ndarray, low: np.ndarray, high: np.ndarray, overlap: np.ndarray, rest: np.ndarray, walked: int):
        counts = high - low
        at_most = np.repeat(overlap, counts) + np.minimum(np.repeat(rest, counts), stored_left[grouped_ranges(low, counts)] - walked)
        stored, q = rows[grouped_ranges(low, counts)], np.repeat(query, counts)
        fine = (cells.root[q] != cells.root[stored]) & (100 * size[stored] >= percent * size[q])
        fine &= ~cells.cross[q] | (cells.side[q] != cells.side[stored])
        fine &= (size[q] > size[stored]) | ((size[q] == size[stored]) & (q > stored))
        fine &= at_most >= needed(size[q] + size[stored], percent)
        q, stored = q[fine], stored[fine]
        if cells.sketches is not None:
            both = size[q] + size[stored]
            fine = both - 2 * needed(both, percent) >= cells.sketches.apart(q, stored)
            q, stored = q[fine], stored[fine]
        if len(q):
            yield q, stored

    new = np.ones(g, bool)
    parts = np.stack([cells.cell[rows], band[rows], behind[rows]])
    new[1:] = (parts[:, 1:] != parts[:, :-1]).any(axis=0)
    heads, stops, least, most, left = bounds(new)
    # Every query meets the branches of its own cell that its size and position allow.
    cell_of_head = cells.cell[rows][heads]
    a, b = np.searchsorted(cell_of_head, cells.cell), np.searchsorted(cell_of_head, cells.cell, side="right")
    query, child = np.repeat(np.arange(g), b - a), grouped_ranges(a, b - a)
    fine = (100 * np.minimum(size[query], most[child]) >= percent * np.maximum(size[query], least[child])) & (size[query] >= least[child])
    fine &= 1 + np.minimum((size - at - 1)[query], left[child]) >= needed(size[query] + least[child], percent)
    query, low, high = query[fine], heads[child[fine]], stops[child[fine]]
    overlap, rest = np.ones(len(query), np.int64), (size - at - 1)[query]
    for depth in range(width + 1):
        if not len(query):
            return
        new[1:] |= matrix[1:, depth] != matrix[:-1, depth]
        heads, stops, least, _, left = bounds(new)
        a, b = np.searchsorted(heads, low), np.searchsorted(heads, high)
        child = grouped_ranges(a, b - a)
        query, overlap, rest = (np.repeat(x, b - a) for x in (query, overlap, rest))
        token = matrix[heads[child], depth].astype(np.int64)
        spot = np.searchsorted(held, query * scale + token)
        behind_tail = spot == begin[query] + lengths[query]
        rest = np.where(behind_tail, size[query] - at[query] - 1 - lengths[query], rest)
        ended = (token < 0) | behind_tail
        if ended.any():
            yield from leave(query[ended], heads[child[ended]], stops[child[ended]], overlap[ended], rest[ended], depth)
        going = ~ended
        query, child, overlap, token, spot = query[going], child[going], overlap[going], token[going], spot[going]
        if not len(query):
            return
        matched = held[spot] == query * scale + token
        overlap = overlap + matched
        rest = size[query] - at[query] - 1 - (spot - begin[query]) - matched
        fine = overlap + np.minimum(rest, left[child] - depth - 1) >= needed(size[query] + least[child], percent)
        query, overlap, rest, low, high = query[fine], overlap[fine], rest[fine], heads[child[fine]], stops[child[fine]]
        sure = overlap >= ENOUGH
        if sure.any():
            yield from leave(query[sure], low[sure], high[sure], overlap[sure], rest[sure], depth + 1)
            query, overlap, rest, low, high = (x[~sure] for x in (query, overlap, rest, low, high))


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[Cells]:
    """Rows, those of one (token, i, j) side by side, as groups of whole cells with a bounded matrix."""
    left: pa.Table | None = None

    def cut(table: pa.Table, last: bool) -> tuple[list[Cells], pa.Table | None]:
        token, i, j = (table.column(c).to_numpy() for c in ("token", "i", "j"))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        heads = np.flatnonzero(new)
        stop = len(token) if last else int(heads[-1])
        whole, rest = table.slice(0, stop).combine_chunks(), None if last else table.slice(stop)
        if not stop:
            return [], rest
        lists_ = whole.column("tail").chunk(0)
        lengths = np.diff(lists_.offsets.to_numpy())
        vertex, root, size, at, side = (whole.column(c).to_numpy() for c in ("v", "root", "size", "at", "side"))
        sketch = whole.column("sketch").chunk(0)
        compared = Sketches(sketch.flatten().to_numpy().view(np.uint64), np.diff(sketch.offsets.to_numpy()).astype(np.int64))
        cells = Cells(np.cumsum(new)[:stop] - 1, vertex, root, size, at, side, (i != j)[:stop], lists_.flatten().to_numpy().view(np.uint64), lengths, compared)
        heads = np.append(heads[heads < stop], stop)
        out, first = [], 0
        for k in range(1, len(heads)):
            widest = int(lengths[heads[first] : heads[k]].max(initial=0)) + 1
            after = k + 1 < len(heads) and heads[k + 1] - heads[first] <= CELL_ROWS and (heads[k + 1] - heads[first]) * max(widest, int(lengths[heads[k] : heads[k + 1]].max(initial=0)) + 1) <= MATRIX
            if not after:
                out.append(cells.part(int(heads[first]), int(heads[k])))
                first = k
        return out, rest

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            found, left = cut(pa.concat_tables([left, table]) if left is not None else table, False)
            yield from found
    if left is not None:
        yield from cut(left, True)[0]


def first_few(rows: np.ndarray, roots: np.ndarray, few: int) -> np.ndarray:
    """Marks of the first ``few`` entries of each pair of row and component."""
    order = np.lexsort((roots, rows))
    new = np.ones(len(rows), bool)
    new[1:] = (rows[order][1:] != rows[order][:-1]) | (roots[order][1:] != roots[order][:-1])
    heads = np.flatnonzero(new)
    place = np.arange(len(rows)) - np.repeat(heads, np.diff(np.append(heads, len(rows))))
    out = np.empty(len(rows), bool)
    out[order] = place < few
    return out


def _cell_task(percent: int, sent, few: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``few``: of the pairs of a class with one other component, only so many, as a later round takes the rest."""
    order = Order(*sent.value)
    for cells in whole_cells(batches):
        for q, s in tree_pairs(cells, percent, order):
            if few is not None:
                kept = first_few(q, cells.root[s], few) & first_few(s, cells.root[q], few)
                q, s = q[kept], s[kept]
            a, b = cells.vertex[q], cells.vertex[s]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _sketch_task(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches allow a link."""
    for batch in batches:
        a, size_a, b, size_b = (batch.column(c).to_numpy() for c in ("a", "size_a", "b", "size_b"))
        columns = [batch.column("sketch_a"), batch.column("sketch_b")]
        lengths = [np.diff(c.offsets.to_numpy()).astype(np.int64) for c in columns]
        words = [c.flatten().to_numpy().view(np.uint64) for c in columns]
        n = np.arange(len(a))
        apart = Sketches(np.concatenate(words), np.concatenate(lengths)).apart(n, n + len(n))
        both = size_a + size_b
        fine = both - 2 * needed(both, percent) >= apart
        yield pa.RecordBatch.from_arrays([pa.array(a[fine]), pa.array(b[fine])], names=["a", "b"])


def _verify_task(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole sets (sorted hashes) with the partners to compare with, those of one cell side by side."""

    def links(sets: dict[int, np.ndarray], partners: dict[int, list[int]]) -> Iterator[tuple[int, int]]:
        for a, others in partners.items():
            x = sets[a]
            for b in others:
                y = sets[b]
                few, many = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(many, few)
                common = int((many[np.minimum(at, len(many) - 1)] == few).sum())
                if common >= needed(len(x) + len(y), percent):
                    yield a, b

    def flush() -> Iterator[pa.RecordBatch]:
        found = list(links(sets, partners))
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    cell, sets, partners = None, {}, {}
    for batch in batches:
        tokens = batch.column("tokens")
        flat, ends = tokens.flatten().to_numpy().view(np.uint64), tokens.offsets.to_numpy()
        ends = ends - ends[0]
        for k, (c, i, j, v, others) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("cell", "i", "j", "v", "partners")))):
            if (c, i, j) != cell:
                yield from flush()
                cell, sets, partners = (c, i, j), {}, {}
            sets[v] = flat[ends[k] : ends[k + 1]]
            if others:
                partners[v] = others
    yield from flush()


# ---- plan -------------------------------------------------------------------------------------------------------


class Join:
    """One run of the join over a table of documents."""

    def __init__(self, docs: DataFrame, n: int = 4, percent: int = 85, cell: int = CELL, star_rounds: int = STAR_ROUNDS, star_group: int = STAR_GROUP) -> None:
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        self.n, self.percent, self.cell, self.star_rounds, self.star_group = n, percent, cell, star_rounds, star_group
        self.spark = docs.sparkSession
        self.shared = Shared(self.spark)
        self.scratch: list[str] = []
        self.steps = 0
        counted = self.docs.mapInArrow(lambda b: _frequent_task(n, b), "token bigint, times bigint")
        counted = counted.groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(FREQUENT)
        # As two lists: that many rows as Python objects would be most of what the driver's Python holds.
        token, times = (np.array(x, np.int64) for x in counted.agg(F.collect_list("token"), F.collect_list("times")).first())
        self.order = self.spark.sparkContext.broadcast((token.view(np.uint64), times))

    def sets(self, docs: DataFrame, whole: bool) -> DataFrame:
        n, percent, sent = self.n, self.percent, self.order
        schema = "doc_id bigint, size bigint, d1 bigint, d2 bigint, tokens array<bigint>" + ("" if whole else ", sketch array<bigint>")
        return docs.mapInArrow(lambda b: _sets_task(n, percent, sent, whole, b), schema)

    def run(self) -> DataFrame:
        """``(doc_id, size, component_id)`` of every document, written; no other table of the run stays."""
        shared = self.shared
        sets = shared.write(self.sets(self.docs, whole=False), "sets")
        members = shared.write(sets.select("doc_id", "size", "d1", "d2"), "members")
        classes = sets.where("size > 0 and doc_id is not null").groupBy("size", "d1", "d2").agg(F.min("doc_id").alias("one"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
        classes = shared.write(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
        shared.drop("sets")
        shared.settle()
        # Dealt by n-gram before both uses, which need the same columns, so that Spark shuffles the entries once.
        entries = classes.select("v", "size", F.posexplode("tokens").alias("at", "token")).repartition("token")
        # Of two sets, the smaller must share an n-gram of the part of its prefix that ends at "store".
        store = F.col("size") - F.ceil(2 * self.percent * F.col("size") / (100 + self.percent)) + 1
        several = entries.groupBy("token").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max((F.col("at") < store).cast("int")).alias("stored"))
        several = several.where("low < high and stored = 1").select("token")
        entries = shared.write(entries.join(several, "token"), "entries")
        shared.settle()
        left = self.with_partners(entries.withColumn("root", F.col("v")))
        left = shared.write(left, "open-0")
        shared.drop("entries")
        shared.settle()
        links, roots = [], None
        star, step, current = self.star_rounds > 0, 0, "open-0"
        # Star rounds, then a tree round of a few pairs for the large groups, then the full round.
        rounds = [("star", k) for k in range(self.star_rounds)] + ([("few", 0)] if star else []) + [("full", 0)]
        while rounds:
            (kind, k), step = rounds.pop(0), step + 1
            if kind == "star":
                met = self.kept_for_round(self.star_pairs(left, k), "met")
                pairs, tried = self.possible(met, classes), met.count()
            else:
                pairs = self.pairs_by_tree(left, classes, FEW if kind == "few" else None)
            pairs = shared.write(pairs, f"pairs-{step}")
            if kind != "star":
                shared.settle()
            found = shared.write(self.verified(pairs, classes), f"links-{step}")
            linked = found.count()
            shared.drop(f"pairs-{step}", *self.scratch)
            self.scratch.clear()
            shared.settle()
            if linked:
                links.append(found)
                roots = components(reduce(DataFrame.union, links), shared, f"roots-{step}")
                if rounds:
                    # Components only merge, so a group that is finished stays so.
                    left, before, current = self.unfinished(left, roots, f"open-{step}"), current, f"open-{step}"
                    shared.drop(before)
            if kind == "star" and 10 * linked < tried:
                # Another star round pays only while a good part of the last one's pairs were links.
                rounds = [r for r in rounds if r[0] != "star"]
        shared.drop(current)
        rooted = classes.select("v", "one", "size", "d1", "d2")
        if roots is None:
            named = rooted.select("size", "d1", "d2", F.col("one").alias("component_id"))
        else:
            rooted = rooted.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
            smallest = rooted.groupBy("root").agg(F.min("one").alias("component_id"))
            named = rooted.join(smallest, "root").select("size", "d1", "d2", "component_id")
        named = members.join(named, ["size", "d1", "d2"], "left").select(
            "doc_id", "size", F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
        )
        named = Shared(self.spark).write(named, "components")
        shared.clear()
        shared.settle()
        return named

    def unfinished(self, entries: DataFrame, roots: DataFrame, name: str) -> DataFrame:
        """Entries with their component, of groups that still join several components; written."""
        marked = entries.drop("root").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
        open_ = marked.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
        return self.shared.write(marked.select(*entries.columns).join(open_, "token"), name)

    def kept_for_round(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written until the end of the round."""
        self.steps += 1
        self.scratch.append(f"{name}-{self.steps}")
        return self.shared.write(df, self.scratch[-1])

    def star_pairs(self, left: DataFrame, step: int) -> DataFrame:
        """Each class with the ``CENTRES`` chosen members that it shares most large groups with, where sizes and positions
        allow a link. A group's members of least hash are chosen, so groups of the same classes choose the same ones."""
        large = left.groupBy("token").agg(F.count("*").alias("members")).where(F.col("members") >= self.star_group).select("token")
        left = left.join(large, "token")
        fields = ("v", "size", "at", "root")
        picks = [F.min(F.struct(F.xxhash64("v", F.lit(CENTRES * step + k)).alias("h"), *fields)) for k in range(CENTRES)]
        chosen = left.groupBy("token").agg(F.array(*picks).alias("p"))
        # A class asks the centres of its first large groups only, others of them in the next round; what they miss, the
        # full round finds.
        places = F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("token", F.lit(step)).alias("h"), "token", "at"))), 1, ASKED)
        own = left.groupBy("v", "size", "root").agg(places.alias("_t")).select("v", "size", "root", F.explode("_t").alias("_t"))
        own = own.select("v", "size", "root", "_t.token", "_t.at")
        met = own.join(chosen, "token").withColumn("p", F.explode("p")).select(*fields, *[F.col(f"p.{c}").alias(f"p_{c}") for c in fields])
        total = F.col("size") + F.col("p_size")
        overlap = F.ceil(self.percent * total / (100 + self.percent))
        met = met.where("root <> p_root").where((F.col("size") - F.col("at") >= overlap) & (F.col("p_size") - F.col("p_at") >= overlap))
        times = met.groupBy("v", "p_v").agg(F.count("*").alias("times"))
        best = times.groupBy("v").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "p_v")), asc=False), 1, CENTRES).alias("best"))
        pairs = best.select("v", F.explode("best.p_v").alias("p_v"))
        return pairs.select(F.least("v", "p_v").alias("a"), F.greatest("v", "p_v").alias("b")).distinct()

    def pairs_by_tree(self, left: DataFrame, classes: DataFrame, few: int | None = None) -> DataFrame:
        """Candidates among all members of the unfinished groups; with ``few``, some of those of the large groups, as one
        link is enough to join two components."""
        percent, sent, cell = self.percent, self.order, self.cell
        left = self.with_partners(left)
        if few is not None:
            left = left.join(left.groupBy("token").agg(F.count("*").alias("members")).where(F.col("members") >= self.star_group).select("token"), "token")
        left = self.kept_for_round(left, "open-tree")
        self.shared.settle()
        sizes = left.groupBy("token").agg(F.count("*").alias("members"), F.max("size").alias("widest"))
        blocks = F.ceil(F.col("members") / cell).cast("int")
        rows = left.join(sizes, "token").withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("v", "token"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # Longer tails would seldom be walked further; a path that ends with a tail cut here ends in candidates.
        tail = F.slice("tokens", F.col("at") + 2, F.least(F.greatest(F.size("tokens") - F.col("at") - 1, F.lit(0)), F.lit(TAIL)))
        rows = rows.join(classes.select("v", "tokens", "sketch"), "v").select(
            "token", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "v", "root", "size", F.col("at").cast("bigint").alias("at"), "side", tail.alias("tail"), "sketch", "widest"
        )
        # Cells of sets of like sizes follow each other, so that trees walked together have like depths.
        dealt = rows.repartition("token", "i", "j").sortWithinPartitions("widest", "token", "i", "j").drop("widest")
        return dealt.mapInArrow(lambda b: _cell_task(percent, sent, few, b), "a bigint, b bigint").distinct()

    def possible(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs whose sketches allow a link."""
        percent = self.percent
        ids = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
        named = classes.select("v", "size", "sketch").join(small(ids, SMALL_IDS), "v", "left_semi")
        for end in ("a", "b"):
            pairs = pairs.join(named.select(F.col("v").alias(end), F.col("size").alias(f"size_{end}"), F.col("sketch").alias(f"sketch_{end}")), end)
        return pairs.mapInArrow(lambda b: _sketch_task(percent, b), "a bigint, b bigint")

    def with_partners(self, left: DataFrame) -> DataFrame:
        """Entries whose group has members of another component, of a size and position that allow a link.

        Sizes are taken in bands of the ratio, so partners lie in the same or a neighbouring band; the most favourable
        values of a band decide.
        """
        percent = self.percent
        band = F.floor(F.log("size") / F.log(F.lit(100 / percent)))
        rows = left.withColumn("band", band)
        groups = rows.groupBy("token", F.col("band").alias("near")).agg(
            F.count("*").alias("members"), F.min("size").alias("least"), F.max(F.col("size") - F.col("at")).alias("most"), F.min("root").alias("low"), F.max("root").alias("high")
        )
        asked = rows.withColumn("near", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(groups, ["token", "near"])
        overlap = F.ceil(percent * (F.col("size") + F.col("least")) / (100 + percent))
        good = ((F.col("near") != F.col("band")) | (F.col("members") > 1)) & ((F.col("low") != F.col("root")) | (F.col("high") != F.col("root")))
        good &= F.least(F.col("size") - F.col("at"), F.col("most")) >= overlap
        return asked.where(good).select(*left.columns).distinct()

    def verified(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs whose whole sets have the needed overlap.

        A pair is checked in the cell of the smallest class that either end is paired with, so the pairs of a group of near
        copies meet in one cell and each set travels to it once. A cell whose sets hold more than ``CELL_GRAMS`` n-grams,
        or with many times ``CELL_PAIRS`` pairs, is cut in blocks of either end.
        """
        percent = self.percent
        both = pairs.select("a", "b").union(pairs.select("b", "a"))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("near"))
        celled = pairs.join(near.withColumnRenamed("near", "near_a"), "a").join(near.select(F.col("a").alias("b"), F.col("near").alias("near_b")), "b")
        celled = celled.select("a", "b", F.least("near_a", "near_b").alias("cell"))
        named = classes.select("v", "one", "size", "d1", "d2")
        ends = celled.select("cell", F.col("a").alias("v")).union(celled.select("cell", F.col("b"))).distinct()
        weights = ends.join(named.select("v", "size"), "v").groupBy("cell").agg(F.ceil(F.sum("size") / CELL_GRAMS).cast("int").alias("blocks"))
        busy = celled.groupBy("cell").agg(F.ceil(F.sqrt(F.count("*") / CELL_PAIRS)).cast("int").alias("busy"))
        celled = celled.join(weights.join(busy, "cell").select("cell", F.greatest("blocks", "busy").alias("blocks")), "cell")
        block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
        celled = celled.select("cell", block("a").alias("i"), block("b").alias("j"), "a", "b")
        nothing = F.lit(None).cast("bigint")
        celled = celled.repartition("cell", "i", "j")  # the blocks of a large cell go to different tasks from here on
        wanted = celled.select("cell", "i", "j", F.col("a").alias("v"), F.col("b").alias("partner")).union(celled.select("cell", "i", "j", F.col("b"), nothing))
        wanted = wanted.groupBy("cell", "i", "j", "v").agg(F.collect_list("partner").alias("partners")).join(named, "v")
        wanted = self.kept_for_round(wanted, "wanted")
        self.shared.settle()
        ids = wanted.select(F.col("one").alias("doc_id")).distinct()
        docs = self.docs.join(small(ids, SMALL_IDS), "doc_id", "left_semi")
        sets = self.sets(docs, whole=True).withColumnRenamed("doc_id", "one")
        # The list of who is wanted where is far smaller than the sets: up to a counted size it goes to them, and the sets are
        # exchanged once, by cell; beyond, they are joined by shuffle before.
        held = wanted.agg(F.count("*").alias("rows"), F.sum(F.size("partners")).alias("partners")).first()
        if held["rows"] <= SMALL_WANTED and (held["partners"] or 0) <= 8 * SMALL_WANTED:
            wanted = F.broadcast(wanted)
        rows = sets.join(wanted, ["one", "size", "d1", "d2"]).select("cell", "i", "j", "v", "partners", "tokens")
        dealt = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
        return dealt.mapInArrow(lambda b: _verify_task(percent, b), "a bigint, b bigint").distinct()


def linked(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document."""
    return Join(docs, **options).run().withColumnRenamed("size", "n_shingles")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents whose id is the smallest of their component, one of each row, with all columns.

    Documents without id cannot be told apart by it and stay.
    """
    named = linked(docs, **options)
    first = named.where("doc_id = component_id").select("doc_id")
    repeated = first.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    kept = docs.join(first.distinct(), "doc_id", "left_semi")
    if repeated:
        text = F.sha2(F.coalesce("text", F.lit("")), 256)
        kept = kept.withColumn("_digest", text).dropDuplicates(["doc_id", "_digest"]).drop("_digest")
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)
