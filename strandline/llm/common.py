"""What the operators share: table access, tables in the shared folder, and byte-level text kernels for Arrow tasks.

The kernels treat a text as its UTF-8 bytes, a null text as empty, and work on slabs: runs of whole documents that
together hold about ``SLAB`` bytes (one longer document makes a slab of its own), so task memory follows the longest
document and not the partition.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.session import ensure_checkpoint_dir

SLAB = 1 << 18


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Shared:
    """Intermediate tables under ``spark.checkpoint.dir``; ``drop`` removes those that no later plan reads."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.read(df, name)

    def read(self, df: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def settle(self) -> None:
        """Let Spark remove the shuffle files of finished jobs now. It does so once the driver has collected their plans,
        which on a quiet driver may be long after the tables made from them were written."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def clear(self) -> None:
        """Remove all tables; for when what was made of them is written elsewhere."""
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it was counted at no more than ``rows``; unmarked, so joined by shuffle, beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def placed(rows: DataFrame, order: Sequence[Column], shared: Shared, name: str) -> DataFrame:
    """``rows`` with ``pos``, dense from 0 within their group ``g`` (not null), and ``n``, the group's size.

    The order is cut in ranges by Spark's own samples; a window never holds more than a range of a group, or the counts of a
    group's ranges.
    """
    ranges = shared.write(rows.repartitionByRange(F.col("g"), *order).withColumn("_part", F.spark_partition_id()), f"{name}-ranges")
    group = Window.partitionBy("g")
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("g", "_part").agg(F.count("*").alias("_size")).select(
        "g", "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.sum("_size").over(group).alias("n")
    )
    inside = F.row_number().over(Window.partitionBy("g", "_part").orderBy(*order))
    numbered = ranges.withColumn("_row", inside).join(starts, ["g", "_part"])
    return numbered.withColumn("pos", F.col("_start") + F.col("_row") - 1).drop("_part", "_row", "_start")


# ---- kernels that run inside tasks ------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slabs(offsets: np.ndarray, size: int = SLAB) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``size`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of many pieces of one byte array from a single running sum: ``sum(table[byte] * base**i)``, shifted to 0."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self, seed: int = 1) -> None:
        self.codes = mixed(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000003))
        self.up = self.down = np.ones(1, np.uint64)

    def reserve(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), SLAB + 4096)
            with np.errstate(over="ignore"):
                self.up = self.powers(self.BASE, n)
                self.down = self.powers(pow(self.BASE, -1, 1 << 64), n)

    @staticmethod
    def powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.reserve(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.codes[data] * self.up[: len(data)], out=total[1:])
            raw = (total[ends] - total[starts]) * self.down[starts]
            return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


LONG_WORD = 64


def word_hashes(hasher: Hasher, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words that stand for them. The running sum is one modulo 2^64, in which long texts can be made to
    collide whatever the seed, so words of more than ``LONG_WORD`` bytes are digested."""
    out = hasher.pieces(data, starts, ends)
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry membership table."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of ``inside`` bytes within one document), and each document's first word."""
    flags = np.zeros(len(data) + 1, bool)
    flags[:-1] = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = flags[:-1]
    starts = np.flatnonzero(flags & (~before | edge))
    ends = np.flatnonzero(before & (~flags | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def chained(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive entries."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = mixed(words[: len(words) - n + 1] + np.uint64(n))
        for i in range(1, n):
            out = mixed(out * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : len(words) - n + 1 + i])
    return out


def grouped_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start, start + length)`` over all pairs."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(np.asarray(starts, np.int64), lengths) + np.arange(total) - skip


def lists(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
