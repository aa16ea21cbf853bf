"""Detectors on vectors: neighbour mean error, hypersphere, PCA residual, invariants, clustering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.evaluate import exact_quantile
from strandline.plans.lookup import lookup_join
from strandline.plans.neighbours import over_neighbours
from strandline.plans.running import numbered, ranged, shuffled
from strandline.session import written

DENSE_KEYS = 4096
SMALL = 1e-8


def neighbour_error(elements: DataFrame, vectors: DataFrame, dims: int, reach: int) -> DataFrame:
    """Add ``error``: mean squared difference between a key's vector and the mean vector of its neighbours.

    Works for keys never trained on, because a vector depends on the text of the key only. A key without a vector fails.
    """
    names = [f"v{i}" for i in range(dims)]
    found = lookup_join(elements, vectors.withColumn("_known", F.lit(True)), ["key"], "left", F.col("pos"))
    missing = F.raise_error(F.concat(F.lit("no vector for key "), F.coalesce("key", F.lit("null"))))
    placed = found.withColumn(names[0], F.when(F.col("_known"), F.col(names[0])).otherwise(missing.cast("double"))).drop("_known")

    def around(w):
        return w.rowsBetween(-reach, reach)

    sums = {f"_s{i}": (lambda n: lambda w: F.sum(n).over(around(w)))(n) for i, n in enumerate(names)}
    sums["_c"] = lambda w: F.count(F.lit(1)).over(around(w))
    seen = over_neighbours(placed, ["seq_id"], "pos", reach, reach, sums)
    others = F.col("_c") - 1
    error = F.lit(0.0)
    for i, name in enumerate(names):
        mean = F.when(others > 0, (F.col(f"_s{i}") - F.col(name)) / others).otherwise(F.lit(0.0))
        error = error + (mean - F.col(name)) * (mean - F.col(name))
    return seen.withColumn("error", error / dims).drop(*names, *sums)


def mean_vector(rows: DataFrame, array_col: str) -> list[float]:
    """Mean of an array column, combined partially in every task."""
    mean = rows.select(Summarizer.mean(array_to_vector(F.col(array_col).cast("array<double>"))).alias("m"))
    return list(mean.select(vector_to_array("m").alias("m")).first()["m"] or [])


def distance_to(array_col: str, point: list[float]) -> Column:
    """Euclidean distance of an array column to a fixed point."""
    centre = F.array(*[F.lit(float(x)) for x in point])
    diff = F.zip_with(F.col(array_col).cast("array<double>"), centre, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + x))


class Hypersphere:
    """Centre and radius of normal vectors; the radius leaves a share ``nu`` of them outside."""

    def __init__(self, train: DataFrame, array_col: str, nu: float = 0.25):
        self.column = array_col
        self.centre = mean_vector(train, array_col)
        distances = train.select(distance_to(array_col, self.centre).alias("distance"))
        self.radius = exact_quantile(distances, "distance", 1 - nu).first()["quantile"]

    def predict(self, rows: DataFrame) -> DataFrame:
        measured = rows.withColumn("distance", distance_to(self.column, self.centre))
        return measured.withColumn("pred", (F.col("distance") > F.lit(self.radius)).cast("long"))


class CountSphere:
    """One-class detector on sparse count rows: a hypersphere computed without dense vectors.

    ``|x - c|^2`` is ``|c|^2`` plus, for every stored cell, ``(x - c)^2 - c^2``.
    """

    def __init__(self, cells: DataFrame, nu: float = 0.5):
        n = cells.select("seq_id").distinct().count()
        self.centre = written(cells.groupBy("key").agg((F.sum("value") / F.lit(float(n))).alias("c")))
        self.norm = self.centre.agg(F.sum(F.col("c") * F.col("c"))).first()[0]
        self.radius = exact_quantile(self.distances(cells), "distance", 1 - nu).first()["quantile"]

    def distances(self, cells: DataFrame) -> DataFrame:
        found = lookup_join(cells, self.centre, ["key"], "left", F.col("seq_id"))
        c = F.coalesce("c", F.lit(0.0))
        part = (F.col("value") - c) * (F.col("value") - c) - c * c
        summed = found.groupBy("seq_id").agg(F.sum(part).alias("_d"))
        return summed.select("seq_id", F.sqrt(F.greatest(F.col("_d") + F.lit(self.norm), F.lit(0.0))).alias("distance"))

    def predict(self, cells: DataFrame) -> DataFrame:
        return self.distances(cells).withColumn("pred", (F.col("distance") > F.lit(self.radius)).cast("long"))


class CountMatrix:
    """Training keys numbered in key order and sparse rows of indexes and values.

    Detectors that decompose an E x E matrix pass ``key_limit``; those that work on sparse rows leave it out.
    """

    def __init__(self, cells: DataFrame, key_limit: int | None = None):
        keys = numbered(ranged(cells.select("key").distinct(), ["key"]), ["key"], F.col("_range"), "_n")
        self.keys = written(keys.select("key", (F.col("_n") - 1).cast("int").alias("idx")))
        self.size = self.keys.count()
        if key_limit is not None and self.size > key_limit:
            raise ValueError(f"{self.size} keys: a dense {self.size} x {self.size} decomposition is limited to {key_limit}")

    @cached_property
    def key_names(self) -> dict[int, str]:
        """Names of the keys, for models small enough to be read."""
        return {r["idx"]: r["key"] for r in self.keys.collect()}

    def rows(self, cells: DataFrame) -> DataFrame:
        """``seq_id, idx, val`` arrays; keys without a number are ignored, rows without any known key are kept empty."""
        found = lookup_join(cells, self.keys, ["key"], "left", F.col("seq_id"))
        stored = F.when(F.col("idx").isNotNull(), F.struct("idx", F.col("value").cast("double").alias("val")))
        packed = found.groupBy("seq_id").agg(F.array_sort(F.collect_list(stored)).alias("_c"))
        return packed.select("seq_id", F.col("_c.idx").alias("idx"), F.col("_c.val").alias("val"))


def _dense(batch: pd.DataFrame, size: int, rows: int = 1024) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Dense pieces of at most ``rows`` rows of a batch of sparse ones."""
    for at in range(0, len(batch), rows):
        piece = batch.iloc[at : at + rows]
        x = np.zeros((len(piece), size))
        lengths = piece["idx"].str.len().to_numpy()
        if lengths.sum():
            x[np.repeat(np.arange(len(piece)), lengths), np.concatenate(piece["idx"].to_list())] = np.concatenate(
                piece["val"].to_list()
            )
        yield piece, x


PAIRS = 1 << 21


def _add_up(codes: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with the sums of their values."""
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0)
    found, place = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(place, np.concatenate(values), len(found))


def _pair_sums(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Products of the pairs of keys that meet in a row, summed by pair; memory follows the pairs that occur."""
    codes, values, held, limit = [], [], 0, PAIRS
    for batch in batches:
        for idx, val in zip(batch["idx"], batch["val"]):
            order = np.argsort(idx)
            i, x = np.asarray(idx, np.int64)[order], np.asarray(val, float)[order]
            a, b = np.triu_indices(len(i))
            codes.append(i[a] * size + i[b])
            values.append(x[a] * x[b])
            held += len(a)
            if held > limit:
                made = _add_up(codes, values)
                codes, values, held, limit = [made[0]], [made[1]], 0, max(PAIRS, len(made[0]))
    found, sums = _add_up(codes, values)
    kept = sums != 0
    yield pd.DataFrame({"i": found[kept] // size, "j": found[kept] % size, "value": sums[kept]})


def gramian(rows: DataFrame, size: int) -> DataFrame:
    """``i, j, value`` of the uncentred product of the matrix with itself (``i <= j``, non-zero cells).

    Every task adds up its own rows, in a dense block up to ``DENSE_KEYS`` keys and by pair beyond; pairs of keys are never
    shuffled per sequence.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            for _, x in _dense(batch, size):
                total += x.T @ x
        i, j = np.nonzero(np.triu(total))
        yield pd.DataFrame({"i": i, "j": j, "value": total[i, j]})

    run = partial if size <= DENSE_KEYS else (lambda batches: _pair_sums(batches, size))
    return rows.select("idx", "val").mapInPandas(run, "i int, j int, value double").groupBy("i", "j").agg(
        F.sum("value").alias("value")
    )


def gramian_matrix(rows: DataFrame, size: int) -> np.ndarray:
    """The Gramian on the driver: at most ``size`` squared cells, ``size`` checked before."""
    cells = gramian(rows, size).toPandas()
    total = np.zeros((size, size))
    total[cells["i"], cells["j"]] = cells["value"]
    return np.maximum(total, total.T) if (total >= 0).all() else total + np.triu(total, 1).T


class ResidualModel:
    """Principal components of the uncentred count matrix; the squared residual is compared with the Q-statistic."""

    # Fixed value: normal quantile used by the Q-statistic.
    C_ALPHA = 3.2905

    def __init__(self, cells: DataFrame, variance: float = 0.95, threshold: float | None = None, key_limit: int = DENSE_KEYS):
        self.matrix = CountMatrix(cells, key_limit)
        rows = written(self.matrix.rows(cells))
        u, sigma, _ = np.linalg.svd(gramian_matrix(rows, self.matrix.size) / rows.count())
        share = np.cumsum(sigma) / sigma.sum()
        self.k = int(np.searchsorted(share, variance) + 1) if variance < 1 else int(variance)
        self.components = u[:, : self.k]
        self.threshold = threshold or self._q_statistic(sigma[self.k :])

    def _q_statistic(self, rest: np.ndarray) -> float:
        p1, p2, p3 = (float((rest**i).sum()) for i in (1, 2, 3))
        if p1 <= 0 or p2 <= 0:
            return 0.0
        h0 = 1 - 2 * p1 * p3 / (3 * p2 * p2)
        inner = self.C_ALPHA * np.sqrt(2 * p2 * h0 * h0) / p1 + 1 + p2 * h0 * (h0 - 1) / (p1 * p1)
        return float(p1 * inner ** (1 / h0))

    def predict(self, cells: DataFrame) -> DataFrame:
        """``seq_id, residual, pred``; keys unknown at training add nothing."""
        components, size, threshold = self.components, self.matrix.size, self.threshold

        def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for piece, x in _dense(batch, size):
                    left = x - (x @ components) @ components.T
                    yield pd.DataFrame({"seq_id": piece["seq_id"], "residual": (left * left).sum(axis=1)})

        rows = self.matrix.rows(cells)
        scored = rows.mapInPandas(residuals, f"seq_id {rows.schema['seq_id'].dataType.simpleString()}, residual double")
        return scored.withColumn("pred", (F.col("residual") > F.lit(threshold)).cast("long"))


class Invariants:
    """Linear relations between key counts that hold on nearly all training rows.

    The Gramian is built once. The candidates of a level come from its sub-blocks on the driver (their number depends
    on the keys, not on the rows); all of them are then counted over the rows in one pass.
    """

    SCALES = (1, 2, 3)

    def __init__(self, cells: DataFrame, share: float = 0.98, epsilon: float = 0.5, longest: int | None = None, key_limit: int = DENSE_KEYS):
        self.matrix = CountMatrix(cells, key_limit)
        self.share, self.epsilon = share, epsilon
        self.rows = written(self.matrix.rows(cells))
        self.n = self.rows.count()
        self.product = gramian_matrix(self.rows, self.matrix.size)
        self.dimension = self._dimension()
        self.found: dict[tuple[int, ...], list[float]] = {}
        self._search(longest)

    def _count(self, matrix: np.ndarray, below: float) -> np.ndarray:
        """For every column of ``matrix``: rows whose product with it is smaller than ``below`` in absolute value."""
        size, columns = self.matrix.size, matrix.shape[1]

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hits = np.zeros(columns, dtype=np.int64)
            for batch in batches:
                for _, x in _dense(batch, size):
                    hits += (np.abs(x @ matrix) < below).sum(axis=0)
            yield pd.DataFrame({"c": np.arange(columns), "hits": hits})

        summed = self.rows.select("idx", "val").mapInPandas(partial, "c int, hits long").groupBy("c").agg(F.sum("hits").alias("hits"))
        out = np.zeros(columns, dtype=np.int64)
        for row in summed.collect():
            out[row["c"]] = row["hits"]
        return out

    def _dimension(self) -> int:
        u, _, _ = np.linalg.svd(self.product)
        enough = self._count(u, self.epsilon) >= self.share * self.n
        tail = np.flatnonzero(~enough[::-1])
        return int(tail[0]) if len(tail) else self.matrix.size

    def _scaled(self, columns: tuple[int, ...]) -> list[np.ndarray]:
        """Integer weight vectors to try: the smallest eigenvector scaled so that its smallest entry is 1, 2, 3."""
        block = self.product[np.ix_(columns, columns)]
        _, vectors = np.linalg.eigh(block)
        theta = vectors[:, 0]
        if (np.abs(theta) < 1e-6).any():
            return []
        smallest = int(np.argmin(np.abs(theta)))
        tried = []
        for scale in self.SCALES:
            weights = np.round(theta * (scale / theta[smallest]))
            weights[smallest] = scale
            if (weights != 0).all():
                tried.append(weights)
        return tried

    def _valid(self, candidates: list[tuple[int, ...]], chunk: int = 4096) -> dict[tuple[int, ...], list[float]]:
        trials = [(c, w) for c in candidates for w in self._scaled(c)]
        valid: dict[tuple[int, ...], list[float]] = {}
        for at in range(0, len(trials), chunk):
            part = trials[at : at + chunk]
            matrix = np.zeros((self.matrix.size, len(part)))
            for j, (columns, weights) in enumerate(part):
                matrix[list(columns), j] = weights
            hits = self._count(matrix, SMALL)
            for (columns, weights), count in zip(part, hits):
                if count >= self.share * self.n and columns not in valid:
                    valid[columns] = weights.tolist()
        return valid

    def _search(self, longest: int | None) -> None:
        alive = {frozenset([i]) for i in range(self.matrix.size)}
        for i in range(self.matrix.size):
            if self.product[i, i] == 0:
                self.found[(i,)] = [1.0]
                alive.discard(frozenset([i]))
        level = sorted(tuple(s) for s in alive)
        length = 2
        while level and (longest is None or length <= longest) and len(self.found) < max(self.dimension, 1):
            joined = sorted({tuple(sorted(set(a) | set(b))) for a, b in combinations(level, 2) if len(set(a) | set(b)) == length})
            open_sets = [c for c in joined if all(frozenset(s) in alive for s in combinations(c, length - 1))]
            alive.update(frozenset(c) for c in open_sets)
            valid = self._valid(open_sets)
            level = []
            for columns in open_sets:
                if frozenset(columns) not in alive:
                    continue
                if columns not in valid:
                    level.append(columns)
                    continue
                self._prune(columns, alive)
                self.found[columns] = valid[columns]
                alive.discard(frozenset(columns))
                if len(self.found) >= max(self.dimension, 1):
                    return
            length += 1

    def _prune(self, columns: tuple[int, ...], alive: set[frozenset[int]]) -> None:
        """Drop the combinations that follow from the new relation and one found before."""
        new = frozenset(columns)
        for earlier in map(frozenset, self.found):
            for shared in earlier & new:
                alive.discard((earlier | new) - {shared})

    def relations(self) -> list[tuple[str, str]]:
        """Readable form: keys and weights in column order, the first weight positive."""
        names = self.matrix.key_names
        return [
            (" ".join(names[c] for c in columns), " ".join(str(int(w * np.sign(weights[0]))) for w in weights))
            for columns, weights in sorted(self.found.items())
        ]


def broken_invariants(cells: DataFrame, relations: DataFrame) -> DataFrame:
    """``seq_id, pred``: 1 when any relation does not hold. ``relations`` is ``rule, key, weight``."""
    weighted = lookup_join(
        cells, relations.groupBy("key").agg(F.collect_list(F.struct("rule", "weight")).alias("_r")), ["key"], "left", F.col("seq_id")
    )
    opened = weighted.select("seq_id", "value", F.explode_outer("_r").alias("_r"))
    sums = opened.groupBy("seq_id", "_r.rule").agg(F.sum(F.col("value") * F.col("_r.weight")).alias("_s"))
    return sums.groupBy("seq_id").agg(F.max((F.coalesce(F.abs("_s"), F.lit(0.0)) > 1e-6).cast("long")).alias("pred"))


def cosine_distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """``1 - cos`` of every row of ``x`` to every point; tiny distances count as 0."""
    norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(points, axis=1)[None, :]
    distance = 1 - (x @ points.T) / (norms + SMALL)
    distance[distance < SMALL] = 0.0
    return distance


def nearest_point(rows: DataFrame, array_col: str, points: np.ndarray) -> DataFrame:
    """Add ``cluster`` and ``distance`` of the nearest of a few fixed points (the first one on ties)."""
    schema = rows.drop(array_col).schema.add("cluster", "long").add("distance", "double")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            distance = cosine_distances(np.vstack(batch[array_col].to_numpy()).astype(float), points)
            best = distance.argmin(axis=1)
            out = batch.drop(columns=[array_col])
            yield out.assign(cluster=best.astype("int64"), distance=distance[np.arange(len(best)), best])

    return rows.mapInPandas(assign, schema)


def complete_linkage(x: np.ndarray, limit: float) -> np.ndarray:
    """Cluster number of every row of a bounded sample: merge the closest clusters while their diameter is <= limit."""
    distance = cosine_distances(x, x)
    np.fill_diagonal(distance, np.inf)
    owner = np.arange(len(x))
    while len(x) > 1:
        a, b = np.unravel_index(np.argmin(distance), distance.shape)
        if distance[a, b] > limit:
            break
        wider = np.maximum(distance[a], distance[b])
        distance[a, :] = distance[:, a] = wider
        distance[a, a] = np.inf
        distance[b, :] = distance[:, b] = np.inf
        owner[owner == b] = a
    return np.unique(owner, return_inverse=True)[1]


class Clusters:
    """Groups of similar rows: a bounded sample is clustered by complete linkage, all rows join the nearest group.

    Rows farther than ``max_distance`` from every group form the next round's input, so the rounds end when no row is
    left; representatives are the means of their members.
    """

    def __init__(self, rows: DataFrame, array_col: str, max_distance: float = 0.3, sample: int = 1000, seed: int = 7):
        self.column, self.max_distance = array_col, max_distance
        points: list[np.ndarray] = []
        left = rows
        while True:
            order = shuffled(left.select("seq_id", array_col), "seq_id", seed, "_rank")
            drawn = order.filter(F.col("_rank") <= sample).select(array_col).toPandas()
            if drawn.empty:
                break
            x = np.vstack(drawn[array_col].to_numpy()).astype(float)
            owner = complete_linkage(x, max_distance)
            fresh = np.vstack([x[owner == c].mean(axis=0) for c in range(owner.max() + 1)])
            placed = written(nearest_point(left.withColumn("_x", F.col(array_col)), "_x", fresh))
            near = placed.filter(F.col("distance") <= max_distance)
            means = {r["cluster"]: np.array(r["m"]) for r in self._means(near)}
            points.extend(means.get(c, fresh[c]) for c in range(len(fresh)))
            far = placed.filter(F.col("distance") > max_distance)
            sampled = order.filter(F.col("_rank") <= sample).select("seq_id")
            # A sampled row has had its round; one that ended up far from every mean becomes a group of its own, so that
            # every round removes its sample and no row is lost.
            alone = far.join(sampled, "seq_id", "left_semi").select(array_col).toPandas()
            points.extend(np.asarray(v, float) for v in alone[array_col])
            left = written(far.join(sampled, "seq_id", "left_anti").drop("cluster", "distance"))
        self.points = np.vstack(points)

    def _means(self, placed: DataFrame) -> list:
        vector = array_to_vector(F.col(self.column).cast("array<double>"))
        return placed.groupBy("cluster").agg(vector_to_array(Summarizer.mean(vector)).alias("m")).collect()

    def predict(self, rows: DataFrame, threshold: float = 0.3) -> DataFrame:
        placed = nearest_point(rows.withColumn("_x", F.col(self.column)), "_x", self.points)
        return placed.withColumn("pred", (F.col("distance") > threshold).cast("long"))


def group_means(rows: DataFrame, group: str, array_col: str, limit: int = 10_000) -> list[tuple[object, np.ndarray]]:
    """Mean vector per group, for at most ``limit`` groups (they are used as fixed points)."""
    vector = array_to_vector(F.col(array_col).cast("array<double>"))
    means = rows.groupBy(group).agg(vector_to_array(Summarizer.mean(vector)).alias("m")).limit(limit + 1).collect()
    if len(means) > limit:
        raise ValueError(f"more than {limit} groups")
    return sorted(((r[group], np.array(r["m"])) for r in means), key=lambda p: p[0])


def pair_relations(cells: DataFrame) -> DataFrame:
    """For every pair of keys that meet in a row: the integer weights of its smallest eigenvector (smallest entry 1) and
    the number of rows in which the weighted counts cancel."""
    matrix = CountMatrix(cells, DENSE_KEYS)
    rows = written(matrix.rows(cells))
    product = gramian_matrix(rows, matrix.size)
    pairs = [(i, j) for i, j in zip(*np.nonzero(np.triu(product, 1)))]
    spark = cells.sparkSession
    kept = []
    for i, j in pairs:
        aa, bb, ab = product[i, i], product[j, j], product[i, j]
        smallest = ((aa + bb) - np.sqrt((aa - bb) ** 2 + 4 * ab * ab)) / 2
        va, vb = ab, smallest - aa
        weights = (1.0, np.round(vb / va)) if abs(va) <= abs(vb) else (np.round(va / vb), 1.0)
        if all(weights):
            kept.append((int(i), int(j), *map(float, weights)))
    hits = count_cancelling(rows, matrix.size, kept)
    names = matrix.key_names
    out = [(names[i], names[j], int(a), int(b), int(h)) for (i, j, a, b), h in zip(kept, hits)]
    return spark.createDataFrame(out, "key_a string, key_b string, weight_a bigint, weight_b bigint, holds bigint")


def count_cancelling(rows: DataFrame, size: int, pairs: list[tuple[int, int, float, float]]) -> np.ndarray:
    """Rows in which ``a * x_i + b * x_j`` is 0, for all pairs in one pass."""
    if not pairs:
        return np.zeros(0, dtype=np.int64)
    i, j, a, b = (np.array(c) for c in zip(*pairs))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = np.zeros(len(i), dtype=np.int64)
        for batch in batches:
            for _, x in _dense(batch, size):
                for k in range(0, len(i), 512):
                    part = slice(k, k + 512)
                    hits[part] += (np.abs(x[:, i[part]] * a[part] + x[:, j[part]] * b[part]) < SMALL).sum(axis=0)
        yield pd.DataFrame({"c": np.arange(len(i)), "hits": hits})

    summed = rows.select("idx", "val").mapInPandas(partial, "c int, hits long").groupBy("c").agg(F.sum("hits").alias("hits"))
    out = np.zeros(len(i), dtype=np.int64)
    for row in summed.collect():
        out[row["c"]] = row["hits"]
    return out


def dense_arrays(rows: DataFrame, size: int, out: str = "counts") -> DataFrame:
    """Sparse rows as arrays of ``size`` numbers."""
    stored = F.map_from_arrays("idx", "val")
    filled = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(stored, i), F.lit(0.0)))
    return rows.select("seq_id", filled.alias(out))
