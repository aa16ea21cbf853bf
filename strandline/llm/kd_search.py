"""Exact top-k by inner product with a KD-tree in every shard.

Vectors are quantised to integers. A bounded sample of them gives the upper splits of one KD-tree, which deal all vectors to
shards of neighbours; a shard with more than ``SHARD`` vectors (many equal ones) is cut by row number. In each shard a tree is
built by median splits of the widest side, with the tight box and the smallest id of every node. The most that an inner product
with a vector in a box can be is ``sum(max(q * low, q * high))``; a query visits a tree's nodes best bound first and stops
below its k-th score so far (at equal score, above its id).

Queries first search their own shard, then the shards that their bound ranks best, then all whose bound the k-th score
still allows; what each round found is propagated to the next. Queries travel in blocks, to the shards they need only.

Defined cases: rows without id, vectors that are null, empty or hold null or non-finite components take no part; vectors of
different lengths are not compared; equal ids are different rows; fewer than k partners give all; other columns are
ignored. Quantised components saturate at 64 bits; a score that does not fit 64 bits fails.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared

SHARD = 4096
LEAF = 128
SAMPLE = 20_000
BLOCK = 512
SCALE = 64
NEAR = 2
BOXES = 4096


def quantised(table: DataFrame) -> DataFrame:
    """``vec_id``, ``d`` (length) and ``v`` (integers as doubles) of the rows that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return rows.where(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.size("embedding").alias("d"), scaled.alias("v"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def upper_splits(sample: np.ndarray, shards: int) -> list[tuple[int, float, int, int]]:
    """Nodes ``(side, value, left, right)``; negative children are shards ``-1 - number``."""
    nodes: list = []
    numbers = iter(range(shards))

    def build(rows: np.ndarray, parts: int) -> int:
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(1)
        if parts < 2 or not len(rows) or not spread.max():
            return -1 - next(numbers)
        side = int(spread.argmax())
        value = float(np.median(rows[:, side]))
        if not (rows[:, side] < value).any():
            value = float(rows[rows[:, side] > value, side].min())
        left = rows[:, side] < value
        at = len(nodes)
        nodes.append(None)
        nodes[at] = (side, value, build(rows[left], parts // 2), build(rows[~left], parts - parts // 2))
        return at

    build(sample, shards)
    return nodes


def dealt(nodes: list, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros(len(vectors), np.int64)
    work = [(0, np.arange(len(vectors)))] if nodes else []
    while work:
        at, rows = work.pop()
        if at < 0:
            out[rows] = -1 - at
        elif len(rows):
            side, value, left, right = nodes[at]
            low = vectors[rows, side] < value
            work += [(left, rows[low]), (right, rows[~low])]
    return out


class Tree:
    """A KD-tree over the rows of one shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        order, nodes = np.arange(len(ids)), []
        work = [(0, len(ids), -1, 0)]
        while work:
            low, high, parent, which = work.pop()
            part = vectors[order[low:high]]
            at = len(nodes)
            nodes.append([low, high, -1, -1, part.min(axis=0), part.max(axis=0), int(ids[order[low:high]].min())])
            if parent >= 0:
                nodes[parent][2 + which] = at
            spread = nodes[at][5] - nodes[at][4]
            if high - low > LEAF and spread.max() > 0:
                middle = (high - low) // 2
                split = np.argpartition(part[:, int(spread.argmax())], middle)
                order[low:high] = order[low:high][split]
                work += [(low + middle, high, at, 1), (low, low + middle, at, 0)]
        self.ids, self.rows, self.vectors = ids[order], rows[order], vectors[order]
        self.begin, self.end, self.left, self.right = (np.array([n[i] for n in nodes]) for i in range(4))
        self.low, self.high = np.stack([n[4] for n in nodes]), np.stack([n[5] for n in nodes])
        self.least = np.array([n[6] for n in nodes])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Queries x nodes."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        """``best``: a heap of ``(score, -id, row)`` with at most k entries, improved by this tree's rows."""
        open_ = [(-bounds[0], 0)]
        while open_:
            bound, node = heapq.heappop(open_)
            if len(best) == k and (-bound, -self.least[node]) < best[0][:2]:
                if -bound < best[0][0]:
                    break
                continue
            if self.left[node] >= 0:
                for child in (int(self.left[node]), int(self.right[node])):
                    heapq.heappush(open_, (-bounds[child], child))
                continue
            a, b = self.begin[node], self.end[node]
            scores = self.vectors[a:b] @ query
            if len(best) == k:
                some = np.flatnonzero(scores >= best[0][0])
            else:
                some = np.arange(b - a)
            if len(some) > 4 * k:
                some = some[np.lexsort((self.ids[a + some], -scores[some]))[: k + 1]]
            for i in some.tolist():
                if self.rows[a + i] != own:
                    entry = (int(scores[i]), -int(self.ids[a + i]), int(self.rows[a + i]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry[:2] > best[0][:2]:
                        heapq.heapreplace(best, entry)
        return best


def exact_type(vectors: np.ndarray) -> np.ndarray:
    """Doubles where every inner product is exact in them, else Python integers."""
    most = float(np.abs(vectors).max(initial=0))
    if most * most * vectors.shape[1] < 2**53:
        return vectors
    return np.array([[int(x) for x in row] for row in vectors], dtype=object)


HITS = "query bigint, query_id bigint, vec_id bigint, other bigint, score bigint"


def _hits(queries: list[tuple[int, int, list[tuple]]]) -> pa.RecordBatch:
    rows = [(q, i, -e[1], e[2], e[0]) for q, i, best in queries for e in best]
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "vec_id", "other", "score"])


class Search:
    """One run over the rows of ``vectors`` (``vec_id``, ``v``) of one length ``d``."""

    def __init__(self, rows: DataFrame, d: int, shared: Shared, name: str, k: int, every: int, shard: int, block: int) -> None:
        self.d, self.shared, self.name, self.k, self.block = d, shared, name, k, block
        self.spark = rows.sparkSession
        total = rows.count()
        sample = rows.orderBy(F.xxhash64("row")).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
        nodes = upper_splits(matrix(sample, d), max(1, -(-total // shard)))
        sent = self.spark.sparkContext.broadcast(nodes)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = dealt(sent.value, matrix(batch.column("v"), d)) if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

        placed = shared.write(rows.select("row", "vec_id", "v").mapInArrow(deal, "row bigint, vec_id bigint, v array<double>, part bigint"), f"{name}-placed")
        sizes = placed.groupBy("part").count()
        cuts = F.ceil(F.col("count") / shard)
        self.placed = shared.write(
            placed.join(F.broadcast(sizes), "part").select("row", "vec_id", "v", F.concat_ws("-", "part", F.pmod(F.xxhash64("row"), cuts)).alias("shard"), (F.pmod("vec_id", F.lit(every)) == 0).alias("asks")),
            f"{name}-shards",
        )

    def own_shards(self) -> DataFrame:
        """Each query's best within its shard."""
        d, k = self.d, self.k

        def one(table: pa.Table) -> pa.Table:
            vectors = exact_type(matrix(table.column("v").combine_chunks(), d))
            ids, rows = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
            asks = np.flatnonzero(table.column("asks").to_numpy())
            tree, found = Tree(ids, rows, vectors), []
            if len(asks):
                bounds = tree.bounds(vectors[asks])
                found = [(int(rows[i]), int(ids[i]), tree.search(vectors[i], int(rows[i]), bounds[j], [], k)) for j, i in enumerate(asks)]
            return pa.Table.from_batches([_hits(found)])

        return self.placed.groupBy("shard").applyInArrow(one, HITS)

    def boxes(self) -> DataFrame:
        """The tight box of every shard."""
        low = [F.min(F.element_at("v", i + 1)) for i in range(self.d)]
        high = [F.max(F.element_at("v", i + 1)) for i in range(self.d)]
        return self.placed.groupBy("shard").agg(F.array(*low).alias("low"), F.array(*high).alias("high"))

    def wanted(self, kth: DataFrame, boxes: DataFrame, near: int | None) -> DataFrame:
        """``(query row, shard)`` still to be searched: the best ``near`` other shards, or all that the k-th score allows.

        The boxes go to the tasks in groups of about ``BOXES``; every query is held against each of them (a stated query
        set in blocks), and only the pairs that the bound allows leave the task.
        """
        groups = -(-boxes.count() // BOXES)
        parts = [self.allowed(kth, boxes.where(F.pmod(F.xxhash64("shard"), F.lit(groups)) == g).collect(), near) for g in range(groups)]
        return reduce(DataFrame.unionByName, parts)

    def allowed(self, kth: DataFrame, found: list, near: int | None) -> DataFrame:
        d = self.d
        names = [r["shard"] for r in found]
        sent = self.spark.sparkContext.broadcast((names, np.array([r["low"] for r in found]).reshape(-1, d), np.array([r["high"] for r in found]).reshape(-1, d)))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, low, high = sent.value
            number = {n: i for i, n in enumerate(names)}
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = matrix(batch.column("v"), d)
                kth = np.array([-np.inf if x is None else x for x in batch.column("kth").to_pylist()], float)
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                allowed = bound + np.abs(bound) * 1e-9 + 1 >= kth[:, None]
                for i, done in enumerate(batch.column("done").to_pylist()):
                    allowed[i, [number[s] for s in done if s in number]] = False
                if near is not None and len(names) > near:
                    floor = np.partition(np.where(allowed, bound, -np.inf), -near, axis=1)[:, -near]
                    allowed &= bound >= floor[:, None]
                a, b = np.nonzero(allowed)
                rows = batch.take(pa.array(a))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("row", "vec_id", "v", "kth", "kth_id")), pa.array([names[j] for j in b], pa.string())], names=["row", "vec_id", "v", "kth", "kth_id", "shard"])

        return kth.mapInArrow(pick, "row bigint, vec_id bigint, v array<double>, kth bigint, kth_id bigint, shard string")

    def searched(self, wanted: DataFrame) -> DataFrame:
        """What the queries find in the shards they want: a shard's rows meet its queries block by block."""
        d, k, block = self.d, self.k, self.block
        trees = self.placed.select("shard", "row", "vec_id", "v")
        count = wanted.groupBy("shard").count().withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
        asks = wanted.join(count.select("shard", "blocks"), "shard").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        trees = trees.join(count.select("shard", "blocks"), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def one(key: tuple, stored: pa.Table, asking: pa.Table) -> pa.Table:
            if not stored.num_rows or not asking.num_rows:
                return pa.Table.from_batches([_hits([])])
            both = exact_type(np.concatenate([matrix(t.column("v").combine_chunks(), d) for t in (stored, asking)]))
            vectors, queries = both[: stored.num_rows], both[stored.num_rows :]
            tree = Tree(stored.column("vec_id").to_numpy(), stored.column("row").to_numpy(), vectors)
            bounds, found = tree.bounds(queries), []
            for j, (row, vec_id, kth, kth_id) in enumerate(zip(*(asking.column(c).to_pylist() for c in ("row", "vec_id", "kth", "kth_id")))):
                # The k-th hit so far stands for k of them: nothing below it can count.
                best = [(kth, -kth_id, -1)] * k if kth is not None else []
                best = tree.search(queries[j], row, bounds[j], best, k)
                found.append((row, vec_id, [e for e in best if e[2] >= 0]))
            return pa.Table.from_batches([_hits(found)])

        return trees.select("shard", "block", "row", "vec_id", "v").groupBy("shard", "block").cogroup(asks.select("shard", "block", "row", "vec_id", "v", "kth", "kth_id").groupBy("shard", "block")).applyInArrow(one, HITS)

    def best(self, hits: DataFrame) -> DataFrame:
        top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "other", "query_id"))), 1, self.k)
        return hits.groupBy("query").agg(top.alias("top"))

    def run(self) -> DataFrame:
        """``(query, query_id, vec_id, other, score)`` of each query's k best."""
        shared, name, k = self.shared, self.name, self.k
        queries = self.placed.where("asks").select("row", "vec_id", "v", F.array("shard").alias("done"))
        hits = shared.write(self.own_shards(), f"{name}-hits-0")
        boxes = shared.write(self.boxes(), f"{name}-boxes")
        for step, near in enumerate((NEAR, None), 1):
            top = self.best(hits)
            last = F.when(F.size("top") == k, F.element_at("top", k))
            kth = top.select(F.col("query").alias("row"), (-last["s"]).alias("kth"), last["vec_id"].alias("kth_id"))
            wanted = shared.write(self.wanted(queries.join(kth, "row", "left"), boxes, near), f"{name}-wanted-{step}")
            found = shared.write(self.searched(wanted), f"{name}-hits-{step}")
            done = wanted.groupBy("row").agg(F.collect_list("shard").alias("more"))
            queries = queries.join(done, "row", "left").select("row", "vec_id", "v", F.concat("done", F.coalesce("more", F.array().cast("array<string>"))).alias("done"))
            hits = hits.unionByName(found)
        return self.best(hits).select(F.posexplode("top").alias("at", "hit")).select(
            F.col("hit.query_id").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score")
        )


def top_k(table: DataFrame, k: int = 20, every: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` for the rows whose id is divisible by ``every``, against all other rows."""
    shared = Shared(table.sparkSession)
    rows = shared.write(quantised(table).withColumn("row", F.monotonically_increasing_id()), "rows")
    lengths = sorted(r[0] for r in rows.select("d").distinct().collect())
    parts = [Search(rows.where(F.col("d") == d), d, shared, f"d{d}", k, every, shard, block).run() for d in lengths]
    out = table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    for part in parts:
        out = out.unionByName(part)
    return out
