"""Numeric features of sequences in sparse long form ``seq_id, key, value``, and vectors of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.plans.lookup import lookup_join

SMALL = 1e-8
HEX = "0123456789abcdef"


class CountFeatures:
    """Event-count features fitted on training sequences and applied to any others.

    ``counts`` is ``seq_id, key, cnt``. Options follow the usual order: rare keys folded into one out-of-vocabulary
    column, inverse document frequency, then centring or a sigmoid on the non-zero cells. Absent cells stay implicit; a
    centred feature has the value ``-mean`` in all of them (see :meth:`absent_cells`).
    """

    OOV_KEY = "<oov>"

    def __init__(self, counts: DataFrame, min_count: int = 1, oov: bool = False, idf: bool = False):
        self.oov, self.idf = oov, idf
        self.n = counts.select("seq_id").distinct().count()
        frequency = counts.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
        self.kept = frequency.filter(F.col("df") >= min_count) if oov and min_count > 1 else frequency
        self.rare = frequency.filter(F.col("df") < min_count).select("key") if oov and min_count > 1 else None
        self.weights = self.kept.select("key", "df", self._idf(F.col("df")).alias("idf"))
        if oov:
            rows = self._oov_cells(counts, fitted=True).agg(F.count(F.lit(1))).first()[0]
            self.oov_idf = float(self._idf_value(rows))

    def _idf(self, df: Column) -> Column:
        return F.ln(F.lit(float(self.n)) / (df + F.lit(SMALL))) if self.idf else F.lit(1.0)

    def _idf_value(self, df: int) -> float:
        import math

        return math.log(self.n / (df + SMALL)) if self.idf else 1.0

    def _oov_cells(self, counts: DataFrame, fitted: bool) -> DataFrame:
        """``seq_id, cnt``: distinct rare keys of a training row, or distinct unknown keys of another row."""
        if fitted:
            if self.rare is None:
                return counts.select("seq_id", F.col("cnt")).limit(0)
            outside = lookup_join(counts, self.rare, ["key"], "left_semi", F.col("seq_id"))
        else:
            outside = lookup_join(counts, self.kept.select("key"), ["key"], "left_anti", F.col("seq_id"))
        return outside.groupBy("seq_id").agg(F.count(F.lit(1)).alias("cnt"))

    def transform(self, counts: DataFrame, fitted: bool = False) -> DataFrame:
        """Weighted non-zero cells; keys not fitted are ignored or, with ``oov``, counted in the extra column."""
        found = lookup_join(counts, self.weights.select("key", "idf"), ["key"], "inner", F.col("seq_id"))
        cells = found.select("seq_id", "key", (F.col("cnt") * F.col("idf")).alias("value"))
        if self.oov:
            extra = self._oov_cells(counts, fitted).select(
                "seq_id", F.lit(self.OOV_KEY).alias("key"), (F.col("cnt") * F.lit(self.oov_idf)).alias("value")
            )
            cells = cells.unionByName(extra)
        return cells

    def means(self, fitted_cells: DataFrame) -> DataFrame:
        """Training mean per key over all rows, absent cells counting as 0."""
        return fitted_cells.groupBy("key").agg((F.sum("value") / F.lit(float(self.n))).alias("mean"))


def centred(cells: DataFrame, means: DataFrame) -> DataFrame:
    """Stored cells minus the training mean of their key."""
    found = lookup_join(cells, means, ["key"], "inner", F.col("seq_id"))
    return found.select("seq_id", "key", (F.col("value") - F.col("mean")).alias("value"))


def absent_cells(means: DataFrame) -> DataFrame:
    """Value every absent cell of a key takes after centring."""
    return means.select("key", (-F.col("mean")).alias("value"))


def sigmoid(cells: DataFrame) -> DataFrame:
    """Logistic function of the non-zero cells."""
    return cells.withColumn("value", F.when(F.col("value") != 0, 1 / (1 + F.exp(-F.col("value")))).otherwise(F.lit(0.0)))


def min_max(elements: DataFrame, column: str) -> DataFrame:
    """Scale a duration column to 0..1 by its smallest and largest value."""
    low, high = elements.agg(F.min(column), F.max(column)).first()
    width = (high - low) or 1.0
    return elements.withColumn(column, (F.col(column) - F.lit(float(low))) / F.lit(float(width)))


def window_counts(windows: DataFrame) -> DataFrame:
    """Count per key inside every context window; the pad counts as a key."""
    opened = windows.select("seq_id", "start", F.explode("context").alias("key"))
    return opened.groupBy("seq_id", "start", "key").agg(F.count(F.lit(1)).alias("cnt"))


def hashed_vectors(keys: DataFrame, tokens: Column, digits: int = 1) -> DataFrame:
    """Sparse vectors of distinct keys: ``key, dim, value`` with ``16 ** digits`` dimensions.

    Every token lands in the dimension given by the leading digits of its md5 and takes its sign from the next digit;
    its weight is ``count * (1 + ln(keys / keys with the token))``.
    """
    distinct = keys.select("key").distinct()
    n = distinct.count()
    counted = distinct.withColumn("token", F.explode(tokens)).groupBy("key", "token").agg(F.count(F.lit(1)).alias("tf"))
    weight = counted.groupBy("token").agg((1 + F.ln(F.lit(float(n)) / F.count(F.lit(1)))).alias("idf"))

    def digit(i: int) -> Column:
        return F.expr(f"instr('{HEX}', substring(md5(token), {i}, 1))") - 1

    dim = digit(1)
    for i in range(2, digits + 1):
        dim = dim * 16 + digit(i)
    sign = F.when(digit(digits + 1) < 8, 1.0).otherwise(-1.0)
    placed = counted.join(weight, "token").select(
        "key", dim.cast("long").alias("dim"), (F.col("tf") * F.col("idf") * sign).alias("_w")
    )
    return placed.groupBy("key", "dim").agg(F.sum("_w").alias("value"))


def dense_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """One row per key with columns ``v0 .. v{dims-1}``."""
    return vectors.groupBy("key").agg(
        *[F.coalesce(F.sum(F.when(F.col("dim") == i, F.col("value"))), F.lit(0.0)).alias(f"v{i}") for i in range(dims)]
    )
