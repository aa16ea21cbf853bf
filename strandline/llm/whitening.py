"""Whitening of embeddings by shifted Cholesky QR, on integer vectors whose sums are exact.

Every entry ``c`` becomes ``floor(256 * c)``; the distinct integer vectors are the fit list. Passes over the fit list sum Gram matrices
of the centred rows: the first is shifted by ``SHIFT`` of its trace, so that its Cholesky factor exists whatever the condition; the next
ones are of the rows after triangular solves by the factors before, until they are the identity to ``CLOSE``, so the last factor makes the
rows orthogonal to working precision. The factors are composed to one ``R`` with ``rows = Q R``; its singular values and right vectors are
those of the centred rows. Directions without variance come out of a solve as zeros and leave the factors.

A task holds one Gram matrix (dimension squared) and a piece of a batch; the driver collects one summed matrix a pass. Both depend on the
dimension only, not on the rows. Repeated vectors, however many, are merged before they meet.

Defined cases: vectors that are null, empty, hold a null or a non-finite entry or one beyond 2^62 / 256 take no part, neither do vectors
of another length than the most frequent one (the longer on ties); repeated rows are each transformed; components without variance
(below ``FLAT`` of the largest) are left out, so fewer than ``k`` may come, and none from one distinct vector; an empty table gives no rows; a
null vec_id is kept; a deviation that no long holds is null; equal eigenvalues are ordered as they come; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared

SCALE = 256.0
SHIFT, CLOSE, FLAT = 1e-12, 1e-9, 1e-18
PASSES = 8
CELLS = 1 << 20


def integers(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x``, the scaled integer vector, of the rows that take part."""
    entry = lambda c: c.cast("double") * F.lit(SCALE)
    odd = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(entry(c)) >= F.lit(2.0**62)))
    usable = rows.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~odd)
    return usable.select("vec_id", F.transform(column, lambda c: F.floor(entry(c)).cast("long")).alias("x"))


def pieces(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Row pieces of at most ``CELLS`` entries with their integer matrix."""
    rows = max(CELLS // d, 1)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            yield piece, piece.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Centre:
    """Exact centring: ``n * x - total`` in integers wherever a long holds it."""

    def __init__(self, n: int, total: list[int], largest: int) -> None:
        self.n, self.total, self.d = n, total, len(total)
        self.reach = n * largest + max((abs(t) for t in total), default=0)
        self.exact = self.reach < 1 << 62

    def scaled(self, x: np.ndarray) -> np.ndarray:
        if self.exact:
            return x * np.int64(self.n) - np.array(self.total, np.int64)
        return x.astype(object) * self.n - np.array(self.total, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> pa.Array:
        scaled = self.scaled(x)
        if self.reach * self.reach * self.d < 1 << 63:
            return pa.array((scaled * scaled).sum(axis=1), pa.int64())
        sums = [sum(int(v) * int(v) for v in row) for row in scaled]
        return pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows @ inverse(r)`` for an upper triangular ``r``, by forward substitution over the columns."""
    out = np.empty_like(rows)
    for j in range(len(r)):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def totals(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Number of rows, exact sums of the dimensions and the largest absolute entry."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, largest = 0, 0
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in pieces(batches, d):
            n += len(x)
            largest = max(largest, int(np.abs(x).max(initial=0)))
            high += (x >> 31).sum(axis=0)
            low += (x & 0x7FFFFFFF).sum(axis=0)
        dims = np.arange(d)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (dims, high, low, np.full(d, n), np.full(d, largest))], ["dim", "high", "low", "n", "largest"])

    parts = fit.select("x").mapInArrow(partial, "dim bigint, high bigint, low bigint, n bigint, largest bigint")
    wide = "decimal(38,0)"
    rows = parts.groupBy("dim").agg(
        F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"), F.sum("n").alias("n"), F.max("largest").alias("largest")
    ).orderBy("dim").collect()
    return rows[0]["n"], [int(r["high"]) * (1 << 31) + int(r["low"]) for r in rows], rows[0]["largest"]


def gram(fit: DataFrame, centre: Centre, turn) -> np.ndarray:
    """Sum of ``y' y`` over the rows ``y = turn(centred rows)`` of the fit list."""
    d = centre.d

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in pieces(batches, d):
            y = turn(centre.rows(x))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total))], ["i", "values"])

    parts = fit.select("x").mapInArrow(partial, "i bigint, values array<double>")
    cells = parts.select("i", F.posexplode("values").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    i, j, value = (cells.column(c).to_numpy() for c in ("i", "j", "value"))
    size = int(i.max()) + 1 if len(i) else 0
    out = np.zeros((size, size))
    out[i, j] = value
    return (out + out.T) / 2


def factor(fit: DataFrame, centre: Centre) -> np.ndarray:
    """The composed ``R`` of the centred fit list."""
    d = centre.d
    whole, factors, alive = np.eye(d), [], np.ones(d, bool)
    for step in range(PASSES):
        done = list(factors)

        def turn(rows: np.ndarray, done=done) -> np.ndarray:
            for r in done:
                rows = solved(rows, r)
            return rows

        g = gram(fit, centre, turn)
        size = np.trace(g)
        if size <= 0:
            return np.zeros((d, d))
        if step:
            alive &= np.diag(g) > CLOSE
        g[~alive], g[:, ~alive] = 0.0, 0.0
        off = np.abs(g - np.diag(alive.astype(float))).max()
        g[~alive, ~alive] = 1.0
        shift = 0.0 if step else SHIFT * size
        while True:
            try:
                r = np.linalg.cholesky(g + shift * np.eye(d)).T
                break
            except np.linalg.LinAlgError:
                shift = max(10 * shift, SHIFT * size)
        factors.append(r)
        whole = r @ whole
        if step and shift == 0.0 and off < CLOSE:
            break
    whole[~alive] = 0.0
    return whole


class Whitening:
    """Fitted components: unit vectors, eigenvalues, shares of the variance, and the error of the whitened covariance."""

    def __init__(self, fit: DataFrame, d: int, k: int = 4) -> None:
        self.n, total, largest = totals(fit, d)
        self.centre = Centre(self.n, total, largest)
        _, sigma, axes = np.linalg.svd(factor(fit, self.centre))
        values = sigma * sigma / self.n
        kept = [c for c in range(min(k, d)) if values[0] > 0 and values[c] > FLAT * values[0]]
        self.values, self.axes = values[kept], axes[kept]
        self.shares = self.values / values.sum() if kept else self.values
        self.error = 0.0
        if kept:
            turn = self.turn
            g = gram(fit, self.centre, lambda rows: np.hstack([turn(rows), np.ones((len(rows), 1))]))
            mean = g[:-1, -1] / g[-1, -1]
            self.error = float(np.abs(g[:-1, :-1] / g[-1, -1] - np.outer(mean, mean) - np.eye(len(kept))).max())

    @property
    def turn(self):
        to = (self.axes / np.sqrt(self.values)[:, None]).T
        return lambda rows: rows @ to

    def transformed(self, rows: DataFrame) -> DataFrame:
        """A row for each row and component."""
        centre, turn, k, d = self.centre, self.turn, len(self.values), self.centre.d
        n, shares, error = self.n, self.shares, self.error
        kind = rows.schema["vec_id"].dataType.simpleString()
        schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece, x in pieces(batches, d):
                each = np.repeat(np.arange(len(x)), k)
                columns = [
                    piece.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)),
                    centre.deviations(x).take(pa.array(each)), pa.array(turn(centre.rows(x)).ravel()), pa.array(np.tile(shares, len(x))), pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return rows.where(F.size("x") == d).select("vec_id", "x").mapInArrow(run, schema)


def report(rows: DataFrame, column: str = "embedding", k: int = 4) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every row that takes part and component up to ``k``."""
    shared = Shared(rows.sparkSession)
    kept = shared.write(integers(rows, column), "integers")
    sizes = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    d = sizes["d"]
    fit = shared.write(kept.where(F.size("x") == d).select("x").distinct(), "fit")
    model = Whitening(fit, d, k)
    shared.drop("fit")
    return model.transformed(kept)
