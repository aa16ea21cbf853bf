"""Component residuals on sparse counts by a randomised range finder: no matrix of keys by keys, no limit on the keys.

The count matrix stays in cells ``seq_id, key, value``; a block of directions is a table ``key, q`` (an array of ``size`` numbers). A power
step multiplies the block by the uncentred product of the matrix with itself as two joins and two sums of arrays, first by sequence,
then by key, and orthogonalises it with the block's own Gram matrix, ``size`` by ``size``, which is all that the driver sees. The
Rayleigh-Ritz step gives eigenvalues and components of the product within the block.

The trace of the product is a plain sum of squares, so the share of the components is exact at any block size; while they explain less
than is asked for, the block grows. A block as wide as the number of keys, or as the rank, is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.plans.lookup import lookup_join
from strandline.session import written

# Fixed value: normal quantile used by the Q-statistic.
C_ALPHA = 3.2905
FLAT = 1e-13


def _scaled(array: Column, value: Column) -> Column:
    return F.transform(array, lambda x: x * value)


def _summed(rows: DataFrame, by: str, array: Column, out: str) -> DataFrame:
    """Sums of an array column by group, combined in every task before the shuffle."""
    vectors = rows.select(by, array_to_vector(array).alias("_v"))
    return vectors.groupBy(by).agg(Summarizer.sum(F.col("_v")).alias("_v")).select(by, vector_to_array("_v").alias(out))


def times(cells: DataFrame, block: DataFrame, on: str, other: str) -> DataFrame:
    """Product of the sparse matrix with a block: the rows of ``block`` (``on, q``) weighted by the cells, summed by ``other``."""
    joined = lookup_join(cells, block, [on], "inner", F.col(other))
    return _summed(joined, other, _scaled(F.col("q"), F.col("value")), "q")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def block_gram(block: DataFrame, size: int) -> np.ndarray:
    """``size`` by ``size`` product of a block with itself."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            q = _matrix(batch.column("q"))
            if len(q):
                total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = block.select("q").mapInArrow(partial, "i bigint, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros((size, size))
    out[cells["i"], cells["j"]] = cells["x"]
    return (out + out.T) / 2


def turned(block: DataFrame, by: str, matrix: np.ndarray) -> DataFrame:
    """Every row of a block times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q"))
            rows = q @ matrix if len(q) else q
            yield pa.RecordBatch.from_arrays([batch.column(by), pa.array(list(rows), pa.list_(pa.float64()))], [by, "q"])

    kind = block.schema[by].dataType.simpleString()
    return block.select(by, "q").mapInArrow(run, f"{by} {kind}, q array<double>")


def orthonormal(block: DataFrame, size: int) -> tuple[DataFrame, int]:
    """An orthonormal basis of the block's columns, and its size: dependent columns go. Twice, as the first turn of a badly scaled block
    leaves errors of its squared condition."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(block_gram(block, size))
        keep = values > FLAT * max(values.max(initial=0.0), 1e-300)
        block = written(turned(block, "key", vectors[:, keep] / np.sqrt(values[keep])))
        size = int(keep.sum())
    return block, size


class RangeModel:
    """Principal components of the uncentred product of a count matrix, and the squared residual against the Q-statistic."""

    def __init__(
        self, cells: DataFrame, variance: float | int = 0.95, threshold: float | None = None, block: int = 32, rounds: int = 6, seed: int = 7
    ):
        cells = written(cells.select("seq_id", "key", F.col("value").cast("double").alias("value")).where("value <> 0"))
        self.n = cells.select("seq_id").distinct().count()
        keys = written(cells.select("key").distinct())
        self.size = keys.count()
        self.total = (cells.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0) / max(self.n, 1)
        wanted = int(variance) if variance >= 1 else 0
        width = min(self.size, max(block, wanted + 8))
        while True:
            self._fit(cells, keys, width, rounds, seed)
            share = np.cumsum(self.values) / self.total if self.total else np.ones(len(self.values))
            if wanted or width >= self.size or len(self.values) < width or (len(share) and share[-1] >= variance):
                break
            width = min(self.size, 4 * width)
        self.k = min(wanted, len(self.values)) if wanted else min(int(np.searchsorted(share, variance - 1e-12) + 1), len(self.values))
        self.share = float(share[self.k - 1]) if self.k else 1.0
        self.components = written(turned(self._basis, "key", self._axes[:, : self.k])) if self.k else None
        self.threshold = threshold if threshold is not None else self.q_statistic()

    def _fit(self, cells: DataFrame, keys: DataFrame, width: int, rounds: int, seed: int) -> None:
        whole = width >= self.size
        signs = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.when(F.pmod(F.xxhash64("key", j, F.lit(seed)), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0)))
        basis, size = orthonormal(keys.select("key", signs.alias("q")), width) if self.size else (None, 0)
        for _ in range(1 if whole else rounds):
            if not size:
                break
            basis, size = orthonormal(times(cells, times(cells, basis, "key", "seq_id"), "seq_id", "key"), size)
        if not size:
            self._basis, self._axes, self.values = basis, np.zeros((0, 0)), np.zeros(0)
            return
        product = block_gram(times(cells, basis, "key", "seq_id"), size) / self.n
        values, axes = np.linalg.eigh(product)
        falling = np.argsort(-values)
        self._basis, self._axes, self.values = basis, axes[:, falling], np.maximum(values[falling], 0.0)

    def q_statistic(self) -> float:
        """Threshold from the sums of the powers of the eigenvalues left out. Those outside the block share the rest of the trace evenly."""
        rest = self.values[self.k :]
        tail = max(self.total - float(self.values.sum()), 0.0)
        others = max(self.size - len(self.values), 1)
        p1 = float(rest.sum()) + tail
        p2 = float((rest**2).sum()) + tail**2 / others
        p3 = float((rest**3).sum()) + tail**3 / others**2
        if p1 <= 1e-12 * max(self.total, 1e-300) or p2 <= 0:
            return 0.0
        h0 = 1 - 2 * p1 * p3 / (3 * p2 * p2)
        if abs(h0) < 1e-12:
            return p1
        inner = C_ALPHA * np.sqrt(2 * p2 * h0 * h0) / p1 + 1 + p2 * h0 * (h0 - 1) / (p1 * p1)
        return float(p1 * inner ** (1 / h0)) if inner > 0 else p1

    def predict(self, cells: DataFrame) -> DataFrame:
        """``seq_id, residual, pred``; keys unknown at training add nothing. DataFrame operations only."""
        ids = cells.select("seq_id").distinct()
        if self.components is None:
            return ids.select("seq_id", F.lit(0.0).alias("residual"), F.lit(0).cast("long").alias("pred"))
        values = cells.select("seq_id", "key", F.col("value").cast("double").alias("value"))
        found = lookup_join(values, self.components, ["key"], "inner", F.col("seq_id"))
        joined = found.select("seq_id", F.concat(_scaled(F.col("q"), F.col("value")), F.array(F.col("value") * F.col("value"))).alias("_a"))
        summed = _summed(joined, "seq_id", F.col("_a"), "_s")
        inside = F.aggregate(F.slice("_s", 1, self.k), F.lit(0.0), lambda total, x: total + x * x)
        residual = F.greatest(F.element_at("_s", self.k + 1) - inside, F.lit(0.0))
        scored = ids.join(summed.select("seq_id", residual.alias("residual")), "seq_id", "left").select("seq_id", F.coalesce("residual", F.lit(0.0)).alias("residual"))
        return scored.withColumn("pred", (F.col("residual") > F.lit(self.threshold)).cast("long"))
