"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled text in hashed buckets; tasks add up their own rows and Spark sums the
sparse counts, so a language that labels most rows is no hot group. The model is a matrix of ``buckets x languages`` log
probabilities, bounded by its parameters, and is broadcast. Scoring gathers the matrix rows of a slab's n-grams and sums
them per document.

Characters are folded to lower case, everything but letters counts as a space. Defined cases: a null text, or one without
a letter, is ``und`` with score 0, as is every text if nothing was learned; rows without language teach nothing; equal
posteriors go to the alphabetically first language; repeated rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grouped_ranges, mixed, slabs, text_bytes

BITS = 16
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 256
UNKNOWN = "und"


def fold_table() -> np.ndarray:
    """Lower-case code of each letter below 65536, 32 for all else."""
    out = np.full(1 << 16, 32, np.uint32)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalpha():
            lower = c.lower()
            out[code] = ord(lower) if len(lower) == 1 else code
    return out


class Grams:
    """Hashed n-grams of the documents of a slab."""

    def __init__(self, bits: int, orders: tuple[int, ...]) -> None:
        self.fold, self.bits, self.orders = fold_table(), bits, orders

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, the number of them in each document, and whether each document has a letter."""
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        before = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        bounds = before[offsets]
        high = codes >= 1 << 16
        folded = self.fold[np.where(high, 32, codes)]
        if high.any():
            folded = folded.copy()
            folded[high] = [c if chr(c).isalpha() else 32 for c in codes[high].tolist()]
        sizes = np.diff(bounds)
        letters = np.add.reduceat(np.append(folded != 32, False), bounds[:-1]) if len(sizes) else np.zeros(0)
        letters = np.where(sizes > 0, letters, 0) > 0
        value = folded.astype(np.uint64) + np.uint64(1)
        buckets, counts = [], []
        with np.errstate(over="ignore"):
            for n in self.orders:
                room = np.maximum(sizes - n + 1, 0)
                total = np.zeros(max(len(value) - n + 1, 0), np.uint64)
                for k in range(n):
                    total = total * np.uint64(0x9E3779B97F4A7C15) + value[k : k + len(total)]
                hashed = mixed(total + np.uint64(n)) >> np.uint64(64 - self.bits)
                buckets.append(hashed[grouped_ranges(bounds[:-1], room)].astype(np.int64))
                counts.append(room)
        return buckets, counts, letters


def _count_task(bits: int, orders: tuple[int, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, totals, rows = Grams(bits, orders), {}, {}

    def flush():
        for language, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * (len(used) + 1), pa.string()), pa.array(np.append(used, -1)), pa.array(np.append(total[used], rows[language]))],
                names=["language", "bucket", "times"],
            )
        totals.clear()
        rows.clear()

    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        languages = np.array(batch.column("language").to_pylist(), dtype=object)
        for a, b in slabs(offsets):
            names, index = np.unique(languages[a:b].astype(str), return_inverse=True)
            buckets, counts, _ = grams.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            table = np.zeros(len(names) << bits, np.int64)
            for found, count in zip(buckets, counts):
                table += np.bincount(found + (np.repeat(index, count) << bits), minlength=len(table))
            for k, name in enumerate(names):
                totals[name] = totals.get(name, 0) + table[k << bits : (k + 1) << bits]
                rows[name] = rows.get(name, 0) + int((index == k).sum())
            if len(totals) > MAX_LANGUAGES:
                yield from flush()
    yield from flush()


class Model:
    """Languages, log probabilities (buckets x languages) and log priors."""

    def __init__(self, languages: list[str], logs: np.ndarray, priors: np.ndarray, bits: int, orders: tuple[int, ...]) -> None:
        self.languages, self.logs, self.priors, self.bits, self.orders = languages, logs, priors, bits, orders

    def score(self, grams: Grams, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language (-1: none) and its posterior for the documents of a slab."""
        n = len(offsets) - 1
        buckets, counts, letters = grams.of(data, offsets)
        total = np.tile(self.priors, (n, 1))
        for found, count in zip(buckets, counts):
            some = np.flatnonzero(count)
            if len(some):
                begin = (np.cumsum(count) - count)[some]
                total[some] += np.add.reduceat(self.logs[found], begin, axis=0)
        best = total.argmax(axis=1)
        posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return np.where(letters, best, -1), np.where(letters, posterior, 0.0)


def fit(labelled: DataFrame, bits: int = BITS, orders: tuple[int, ...] = ORDERS, smoothing: float = 0.5) -> Model:
    """Learn from columns ``text`` and ``language``; at most ``MAX_LANGUAGES`` languages."""
    rows = labelled.select("text", "language").where("text is not null and language is not null")
    # Known before anything is counted, so that no counts of too many languages come to the driver.
    languages = rows.select("language").distinct().limit(MAX_LANGUAGES + 1).count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the model is limited to them")
    counted = rows.mapInArrow(lambda b: _count_task(bits, orders, b), "language string, bucket bigint, times bigint")
    counted = counted.groupBy("language", "bucket").agg(F.sum("times").alias("times"))
    counted = counted.repartition(1).toArrow() if counted.isEmpty() else counted.toArrow()
    names, index = np.unique(np.array(counted.column("language").to_pylist(), dtype=str), return_inverse=True)
    bucket, times = counted.column("bucket").to_numpy(), counted.column("times").to_numpy()
    counts, documents = np.zeros((1 << bits, len(names))), np.zeros(len(names))
    grams = bucket >= 0
    counts[bucket[grams], index[grams]] = times[grams]
    documents[index[~grams]] = times[~grams]
    logs = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * (1 << bits))
    return Model([str(x) for x in names], logs, np.log(np.maximum(documents, 1) / max(documents.sum(), 1)), bits, orders)


def _predict_task(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Model(**sent.value)
    grams = Grams(model.bits, model.orders)
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        best, score = [], []
        for a, b in slabs(offsets):
            if model.languages:
                x, y = model.score(grams, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            else:
                x, y = np.full(b - a, -1), np.zeros(b - a)
            best.append(x), score.append(y)
        if best:
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(names[np.concatenate(best)].tolist(), pa.string()), pa.array(np.concatenate(score))],
                names=[*kept, "lang_pred", "score"],
            )


def predict(docs: DataFrame, model: Model, carried: Column | None = None) -> DataFrame:
    """``doc_id``, the column ``carried`` if given, ``lang_pred`` and ``score`` of every document."""
    from pyspark.sql import types as T

    # Its plain parts, so that executors need no copy of this package to read the broadcast.
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    source = docs.select("doc_id", "text") if carried is None else docs.select("doc_id", "text", carried.alias("carried"))
    fields = [f for f in source.schema.fields if f.name != "text"]
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return source.mapInArrow(lambda b: _predict_task(sent, b), T.StructType(fields + added))


def held_out() -> Column:
    """Documents that are not learned from: crc32 of the id as text is 2 modulo 4; those without id are."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, **options) -> Model:
    """A model of the documents that are not held out."""
    return fit(docs.where(~held_out()).select("text", F.col("lang").alias("language")), **options)


def report(docs: DataFrame, **options) -> DataFrame:
    return predict(docs, learned(docs, **options)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The documents with a language, found with a posterior of ``least`` or more, with all columns."""
    scored = predict(docs, learned(docs, **options), F.struct(*docs.columns))
    good = scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return good.select(*[F.col("carried").getField(c).alias(c) for c in docs.columns])
