"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.catalog.registry import STEP_SECONDS, WINDOW_SECONDS
from strandline.operators import sequences, splits
from strandline.session import written
from strandline.sources import tables

TRAIN_RATIO, SPLIT_SEED = 0.8, 42


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Elements of the per-user sessions of ``events``."""
    return sequences.sessions_by_column(tables.event_lines(spark, folder), "session")


def session_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``seq_id, key, cnt, el_label``: needs no position, so it is counted straight from the lines."""
    lines = tables.event_lines(spark, folder).withColumnRenamed("session", "seq_id")
    return lines.groupBy("seq_id", "key").agg(F.count(F.lit(1)).alias("cnt"), F.max("el_label").alias("el_label"))


def session_summary(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.sequence_summary(tables.event_lines(spark, folder).withColumnRenamed("session", "seq_id"))


def session_parts(spark: SparkSession, folder: str) -> DataFrame:
    """``seq_id, label, part`` of the seeded split of the sessions; written once because every branch joins it."""
    summary = session_summary(spark, folder).select("seq_id", "label")
    return written(splits.normal_split(summary, TRAIN_RATIO, SPLIT_SEED))


def split_counts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Sparse counts and split of the sessions from one scan of the log; both written."""
    counts = written(session_counts(spark, folder))
    summary = counts.groupBy("seq_id").agg(F.max("el_label").cast("long").alias("label"))
    return counts.drop("el_label"), written(splits.normal_split(summary, TRAIN_RATIO, SPLIT_SEED))


def counts_by_part(spark: SparkSession, folder: str) -> DataFrame:
    counts, parts = split_counts(spark, folder)
    return counts.join(parts, "seq_id")


def elements_by_part(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(spark, folder).join(session_parts(spark, folder).hint("merge"), "seq_id")


def windows(spark: SparkSession, folder: str, **options) -> sequences.TimeWindows:
    return sequences.TimeWindows(tables.event_lines(spark, folder), WINDOW_SECONDS, STEP_SECONDS, **options)


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Elements of the order sequences; a block of the order is a week of ship dates."""
    return sequences.sessions_by_column(
        tables.order_lines(spark, folder), "seq_id", ["epoch", "line_number", "key"],
        F.floor(F.col("epoch") / F.lit(7 * 86400)),
    )
