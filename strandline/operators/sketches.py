"""Mergeable sketches: set sketches for the key statistics of many splits, and quantile sketches for thresholds over many days.

Set sketches (theta) count distinct keys and keys shared by two parts. A part with fewer than ``2 ** size`` distinct keys is counted
exactly; beyond, a count of ``n`` keys has a relative standard error of about ``2 ** (-size / 2)``, and an intersection that error
times the root of the union's share in it.

Quantile sketches (KLL) keep a bounded number of values; a quantile's rank is off by at most ``rank_error(k)`` of the rows with 99 %
confidence, merged or not, and not at all while the rows are fewer than ``k``. Days are sketched once and merged for any range of days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN, NORMAL, ABNORMAL = "train", "test_normal", "test_abnormal"


def key_sketches(pairs: DataFrame, by: Sequence[str], size: int = 14) -> DataFrame:
    """``by`` and a sketch of the distinct keys of each part, all groups and parts in one aggregation; ``pairs`` is ``by, part, key``."""
    made = pairs.groupBy(*by, "part").agg(F.theta_sketch_agg("key", size).alias("_s"))
    part = {p: F.max(F.when(F.col("part") == p, F.col("_s"))).alias(p) for p in (TRAIN, NORMAL, ABNORMAL)}
    return made.groupBy(*by).agg(*part.values())


def _size(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0).cast("long"))


def unseen_key_statistics(pairs: DataFrame, by: Sequence[str], size: int = 14) -> DataFrame:
    """Vocabulary sizes and shares of test keys that training does not know: ``by``, ``train_vocab``, ``test_normal_vocab``,
    ``test_abnormal_vocab``, ``total_vocab``, ``ratio_unseen_normal``, ``ratio_unseen_abnormal``, ``ratio_unseen_total``."""
    sketched = key_sketches(pairs, by, size)
    train, normal, abnormal = F.col(TRAIN), F.col(NORMAL), F.col(ABNORMAL)
    # An absent part has no sketch; the difference from nothing is the whole.
    def unseen(test: Column) -> Column:
        return F.when(train.isNull(), _size(test)).otherwise(_size(F.theta_difference(test, train)))

    both = F.when(normal.isNull(), abnormal).when(abnormal.isNull(), normal).otherwise(F.theta_union(normal, abnormal, F.lit(size)))
    every = F.when(train.isNull(), both).when(both.isNull(), train).otherwise(F.theta_union(both, train, F.lit(size)))

    def ratio(test: Column) -> Column:
        return F.when(_size(test) > 0, unseen(test) / _size(test))

    return sketched.select(
        *by, _size(train).alias("train_vocab"), _size(normal).alias("test_normal_vocab"), _size(abnormal).alias("test_abnormal_vocab"), _size(every).alias("total_vocab"),
        ratio(normal).alias("ratio_unseen_normal"), ratio(abnormal).alias("ratio_unseen_abnormal"), ratio(both).alias("ratio_unseen_total"),
    )


def rank_error(k: int) -> float:
    """Bound of the rank error of a quantile, as a share of the rows (single-sided, 99 %)."""
    return 2.296 / k**0.9021


def quantile_sketches(values: DataFrame, column: str, by: Sequence[str], k: int = 1024) -> DataFrame:
    """``by, sketch`` of a numeric column; nulls are left out."""
    number = F.col(column).cast("double")
    return values.where(number.isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(number, F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches merged over everything but ``by``."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The other columns, ``n``, ``share`` and the value below which that share of the rows lies."""
    kept = [c for c in sketches.columns if c != "sketch"]
    found = [F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("value")) for s in shares]
    opened = sketches.select(*kept, F.kll_sketch_get_n_double("sketch").alias("n"), F.explode(F.array(*found)).alias("_q"))
    return opened.select(*kept, "n", "_q.share", "_q.value")
