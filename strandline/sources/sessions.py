"""Sessions as a bucketed, sorted table of bounded pieces.

A row is a run of at most ``piece`` elements of one session, so no row grows with a session. The rows are bucketed by session and sorted
by session and piece: work by session - counts, summaries, look-ups of a dictionary and running totals over the pieces - reads the
buckets side by side and needs no exchange.

A bucket is one task, so sessions longer than ``hot`` elements go to a second table of the same columns, without buckets: its readers
combine in every task and exchange one row a session and task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans.lookup import lookup_join
from strandline.plans.running import HOT_ROWS
from strandline.session import ensure_checkpoint_dir, remember_folder, written

PIECE = 4096
FIELDS = "elements"


class SessionTable:
    """``seq_id, piece, n, elements`` (an array of ``pos`` and the kept columns) in ``buckets`` and, for long sessions, beside them."""

    def __init__(self, spark: SparkSession, name: str, long_path: str | None) -> None:
        self.spark, self.name, self.long_path = spark, name, long_path

    @classmethod
    def write(cls, elements: DataFrame, columns: Sequence[str], buckets: int = 64, piece: int = PIECE, hot: int = HOT_ROWS) -> SessionTable:
        """Store ``seq_id, pos`` and ``columns`` of ``elements``; ``pos`` is dense from 0 in a session."""
        spark = elements.sparkSession
        number = F.floor(F.col("pos") / F.lit(piece)).cast("long")
        packed = elements.withColumn("piece", number).groupBy("seq_id", "piece").agg(
            F.array_sort(F.collect_list(F.struct("pos", *columns))).alias(FIELDS)
        ).select("seq_id", "piece", F.size(FIELDS).alias("n"), FIELDS)
        packed = written(packed)
        sizes = packed.groupBy("seq_id").agg(F.sum("n").alias("_n")).where(F.col("_n") > hot).select("seq_id")
        long_ids = written(sizes)
        any_long = not long_ids.isEmpty()
        # At most rows / hot sessions are long.
        short = packed.join(F.broadcast(long_ids), "seq_id", "left_anti") if any_long else packed
        name, folder = f"sessions_{uuid.uuid4().hex}", f"{ensure_checkpoint_dir(spark).rstrip('/')}/sessions-{uuid.uuid4().hex}"
        remember_folder(folder)
        # One file a bucket: rows of a bucket come from one task.
        short.repartition(buckets, "seq_id").write.bucketBy(buckets, "seq_id").sortBy("seq_id", "piece").option("path", f"{folder}/short").saveAsTable(name)
        if any_long:
            packed.join(F.broadcast(long_ids), "seq_id", "left_semi").write.parquet(f"{folder}/long")
        return cls(spark, name, f"{folder}/long" if any_long else None)

    def drop(self) -> None:
        """Forget the table; its files go with the other written ones."""
        self.spark.sql(f"drop table if exists {self.name}")

    def _tables(self) -> list[DataFrame]:
        short = self.spark.table(self.name)
        return [short] if self.long_path is None else [short, self.spark.read.schema(short.schema).parquet(self.long_path)]

    def pieces(self) -> DataFrame:
        first, *more = self._tables()
        return first.unionByName(more[0]) if more else first

    def elements(self) -> DataFrame:
        """One row per element, as it was written."""
        opened = self.pieces().select("seq_id", F.explode(FIELDS).alias("_e"))
        return opened.select("seq_id", "_e.*")

    def by_session(self, *sums: Column, per_element: bool = True) -> DataFrame:
        """``seq_id`` and aggregates over its elements, or over its pieces."""
        return self._each(lambda rows: rows.groupBy("seq_id").agg(*sums), per_element)

    def shares(self, vocab: DataFrame, key: str = "key") -> DataFrame:
        """``seq_id, score``: share of a session's elements whose key is not in the dictionary ``key``."""
        known = written(vocab.select(F.col(key), F.lit(1).alias("_known")))
        unknown = F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)) / F.count(F.lit(1))
        return self._each(lambda rows: lookup_join(rows, known, [key], "left", F.col("pos")).groupBy("seq_id").agg(unknown.alias("score")), True)

    def _each(self, make, per_element: bool) -> DataFrame:
        # The short and the long sessions are different ones, so their results only stand side by side.
        parts = []
        for table in self._tables():
            rows = table.select("seq_id", "piece", F.explode(FIELDS).alias("_e")).select("seq_id", "piece", "_e.*") if per_element else table
            parts.append(make(rows))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
