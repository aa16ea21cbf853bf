"""Linear margins: an L1 machine with squared hinge loss, and a one-class machine on random Fourier features.

Both pass over sparse cells and keep only the weights on the driver: one number a key for the first (keys are a vocabulary),
one number a feature for the second. Every pass sums partial results in the tasks and then by index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.evaluate import exact_quantile
from strandline.operators.subspaces import times
from strandline.operators.vector_detectors import CountMatrix
from strandline.plans.lookup import lookup_join
from strandline.session import written

STEPS = tuple(0.5**k for k in range(12))


class _Rows:
    """Sparse rows of one batch, the bias as a last column that is 1."""

    def __init__(self, batch: pa.RecordBatch, size: int) -> None:
        idx = batch.column("idx")
        lengths = np.diff(pa.concat_arrays([idx]).offsets.to_numpy())
        self.n = batch.num_rows
        self.row = np.concatenate([np.repeat(np.arange(self.n), lengths), np.arange(self.n)])
        self.col = np.concatenate([idx.flatten().to_numpy(zero_copy_only=False), np.full(self.n, size)]).astype(np.int64)
        self.val = np.concatenate([batch.column("val").flatten().to_numpy(zero_copy_only=False), np.ones(self.n)])
        self.y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)


class SparseMargin:
    """``min |w|_1 + c * sum(max(0, 1 - y (x w + b))^2)``, the bias ``b`` in the penalty as one more weight of a column of ones.

    Proximal gradient in rounds of three passes: the loss gradient, summed by key; the curvature among the keys that the penalty lets
    move (at most ``working`` a round, those that violate the optimum most); and the losses at a dozen step lengths at
    once. The penalised quadratic of a round is solved by shrinking one weight after the other, so weights become exactly 0.
    """

    def __init__(self, cells: DataFrame, labels: DataFrame, c: float = 1.0, tol: float = 1e-6, rounds: int = 60, working: int = 512):
        self.matrix = CountMatrix(cells)
        self.size, self.c, self.tol = self.matrix.size, c, tol
        y = F.when(F.col("label") > 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        packed = self.matrix.rows(cells).join(labels.select("seq_id", y.alias("y")), "seq_id")
        self.rows = written(packed.select("idx", "val", "y"))
        self.weights = np.zeros(self.size + 1)
        self.objective = None
        for _ in range(rounds):
            if self._round(working):
                break

    def _sum(self, run, schema: str, by: list[str]) -> dict:
        parts = self.rows.mapInArrow(run, schema)
        summed = parts.groupBy(*by).agg(F.sum("x").alias("x")).toPandas()
        return {**{k: summed[k].to_numpy() for k in by}, "x": summed["x"].to_numpy()}

    def _gradient(self) -> tuple[float, np.ndarray]:
        size, w = self.size, self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss = np.zeros(size + 1), 0.0
            for batch in batches:
                rows = _Rows(batch, size)
                slack = np.maximum(1 - rows.y * rows.times(w), 0)
                loss += float(slack @ slack)
                total += np.bincount(rows.col, rows.val * (rows.y * slack)[rows.row], size + 1)
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total[found], loss))], ["i", "x"])

        parts = self._sum(run, "i bigint, x double", ["i"])
        out, loss = np.zeros(size + 1), 0.0
        for i, x in zip(parts["i"], parts["x"]):
            if i < 0:
                loss = x
            else:
                out[i] = x
        return self.c * loss, -2 * self.c * out

    def _curvature(self, moving: np.ndarray) -> np.ndarray:
        size, w = self.size, self.weights
        place = np.full(size + 1, -1)
        place[moving] = np.arange(len(moving))
        m = len(moving)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((m, m))
            for batch in batches:
                rows = _Rows(batch, size)
                active = 1 - rows.y * rows.times(w) > 0
                at = place[rows.col]
                keep = (at >= 0) & active[rows.row]
                # Dense pieces of a bounded number of rows.
                line, column, value = rows.row[keep], at[keep], rows.val[keep]
                for first in range(0, rows.n, 1024):
                    part = (line >= first) & (line < first + 1024)
                    x = np.zeros((1024, m))
                    x[line[part] - first, column[part]] = value[part]
                    total += x.T @ x
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "x"])

        parts = self._sum(run, "i bigint, j bigint, x double", ["i", "j"])
        out = np.zeros((m, m))
        out[parts["i"], parts["j"]] = parts["x"]
        return 2 * self.c * out

    def _losses(self, direction: np.ndarray) -> np.ndarray:
        size, w = self.size, self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(STEPS))
            for batch in batches:
                rows = _Rows(batch, size)
                here, along = rows.y * rows.times(w), rows.y * rows.times(direction)
                for k, step in enumerate(STEPS):
                    slack = np.maximum(1 - here - step * along, 0)
                    total[k] += float(slack @ slack)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(STEPS))), pa.array(total)], ["i", "x"])

        parts = self._sum(run, "i bigint, x double", ["i"])
        out = np.zeros(len(STEPS))
        out[parts["i"]] = parts["x"]
        return self.c * out

    def _round(self, working: int) -> bool:
        w = self.weights
        loss, g = self._gradient()
        self.objective = loss + float(np.abs(w).sum())
        wrong = np.where(w != 0, np.abs(g + np.sign(w)), np.maximum(np.abs(g) - 1, 0))
        if wrong.max(initial=0.0) <= self.tol * max(1.0, float(np.abs(g).max(initial=0.0))):
            return True
        moving = np.argsort(-wrong, kind="stable")[: max(working, 1)]
        moving = np.sort(moving[wrong[moving] > 0])
        h = self._curvature(moving)
        d = _shrunk(h, g[moving], w[moving])
        direction = np.zeros_like(w)
        direction[moving] = d
        losses = self._losses(direction)
        values = np.array([losses[k] + np.abs(w + s * direction).sum() for k, s in enumerate(STEPS)])
        best = int(values.argmin())
        if values[best] >= self.objective - 1e-12 * max(1.0, abs(self.objective)):
            return True
        self.weights = w + STEPS[best] * direction
        self.weights[np.abs(self.weights) < 1e-12] = 0.0
        self.objective = float(values[best])
        return False

    def weight_table(self) -> DataFrame:
        """``key, weight`` of every training key, zeros included."""
        spark = self.matrix.keys.sparkSession
        rows = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(self.weights[:-1]) if x], "idx int, weight double")
        return self.matrix.keys.join(rows, "idx", "left").select("key", F.coalesce("weight", F.lit(0.0)).alias("weight"))

    def predict(self, cells: DataFrame) -> DataFrame:
        """``seq_id, margin, pred``; unknown keys add nothing. DataFrame operations only."""
        found = lookup_join(cells, self.weight_table().where("weight <> 0"), ["key"], "left", F.col("seq_id"))
        summed = found.groupBy("seq_id").agg(F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))).alias("_m"))
        margin = F.coalesce("_m", F.lit(0.0)) + F.lit(float(self.weights[-1]))
        return summed.select("seq_id", margin.alias("margin")).withColumn("pred", (F.col("margin") > 0).cast("long"))


def _shrunk(h: np.ndarray, g: np.ndarray, w: np.ndarray, sweeps: int = 500) -> np.ndarray:
    """``argmin g d + d h d / 2 + |w + d|_1``, one coordinate after the other."""
    d, hd = np.zeros_like(w), np.zeros_like(w)
    curve = np.diag(h) + 1e-10 * max(float(np.trace(h)), 1e-300) / max(len(w), 1) + 1e-12
    for _ in range(sweeps):
        widest = 0.0
        for j in range(len(w)):
            slope = g[j] + hd[j] + (curve[j] - h[j, j]) * d[j]
            at = w[j] + d[j] - slope / curve[j]
            to = math.copysign(max(abs(at) - 1 / curve[j], 0.0), at)
            move = to - w[j] - d[j]
            if move:
                d[j] += move
                hd += h[:, j] * move
                widest = max(widest, abs(move) * curve[j])
        if widest <= 1e-9 * max(1.0, float(np.abs(g).max())):
            break
    return d


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))


class FourierMargin:
    """One-class detector for the Gaussian kernel ``exp(-gamma |x - y|^2)`` without kernel rows.

    A key's row of random directions comes from a hash of the key, so keys never trained on count as well and no key is numbered.
    Features are ``sqrt(2 / size) cos(directions x + phase)``. Among the weighted means of the features in which no row weighs more than
    ``1 / (nu * rows)``, the shortest is sought: a pass takes the mean of the ``nu`` share of rows with the lowest scores and
    goes the best way towards it. A row is outside when its score is below the ``nu`` quantile of the training scores.
    """

    def __init__(self, cells: DataFrame, nu: float = 0.5, gamma: float | None = None, features: int = 256, passes: int = 15, seed: int = 7):
        cells = written(cells.select("seq_id", "key", F.col("value").cast("double").alias("value")))
        self.features, self.seed = features, seed
        self.gamma = gamma if gamma is not None else self._scale(cells)
        rows = written(self.mapped(cells))
        self.weights = self._mean(rows)
        for _ in range(passes):
            scored = written(rows.withColumn("score", self._score()))
            limit = exact_quantile(scored, "score", nu).first()["quantile"]
            lowest = self._mean(scored.where(F.col("score") <= F.lit(limit)))
            way = lowest - self.weights
            length = float(way @ way)
            step = min(max(float(-(self.weights @ way)) / length, 0.0), 1.0) if length > 0 else 0.0
            if step < 1e-4:
                break
            self.weights = self.weights + step * way
        self.limit = exact_quantile(written(rows.select(self._score().alias("score"))), "score", nu).first()["quantile"]

    @staticmethod
    def _scale(cells: DataFrame) -> float:
        """One over keys times the variance of all entries, zeros included."""
        s = cells.agg(F.countDistinct("seq_id").alias("n"), F.countDistinct("key").alias("e"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).first()
        entries = max(s["n"] * s["e"], 1)
        variance = (s["q"] or 0.0) / entries - ((s["s"] or 0.0) / entries) ** 2
        return 1.0 / (max(s["e"], 1) * variance) if variance > 0 else 1.0

    def _mean(self, rows: DataFrame) -> np.ndarray:
        mean = rows.select(Summarizer.mean(array_to_vector("z")).alias("m")).select(vector_to_array("m").alias("m")).first()["m"]
        return np.array(mean if mean else [0.0] * self.features)

    def _score(self) -> Column:
        weights = F.array(*[F.lit(float(x)) for x in self.weights])
        return F.aggregate(F.zip_with("z", weights, lambda z, w: z * w), F.lit(0.0), lambda total, x: total + x)

    def mapped(self, cells: DataFrame) -> DataFrame:
        """``seq_id, z``: the features of every sequence."""
        seed, numbers = F.lit(self.seed), F.sequence(F.lit(0), F.lit(self.features - 1))
        spread = F.lit(math.sqrt(2 * self.gamma))
        normal = F.transform(
            numbers,
            lambda j: spread * F.sqrt(F.lit(-2.0) * F.ln(_uniform(seed, F.lit("r"), "key", j))) * F.cos(F.lit(2 * math.pi) * _uniform(seed, F.lit("a"), "key", j)),
        )
        directions = cells.select("key").distinct().select("key", normal.alias("q"))
        projected = times(cells, directions, "key", "seq_id")
        phase = F.transform(numbers, lambda j: F.lit(2 * math.pi) * _uniform(seed, F.lit("b"), j))
        scale = F.lit(math.sqrt(2 / self.features))
        return projected.select("seq_id", F.zip_with("q", phase, lambda x, b: scale * F.cos(x + b)).alias("z"))

    def predict(self, cells: DataFrame) -> DataFrame:
        """``seq_id, score, pred``; 1 is outside."""
        values = cells.select("seq_id", "key", F.col("value").cast("double").alias("value"))
        scored = self.mapped(values).select("seq_id", self._score().alias("score"))
        return scored.withColumn("pred", (F.col("score") < F.lit(self.limit)).cast("long"))
