"""Joins of a large table with a dictionary whose size is checked before it is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.session import written

# A broadcast table is held by the driver twice, so what is broadcast stays small whatever the input.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 4 << 20
SALTS = 32
HOT_FACTS = 1 << 18


def _bytes(df: DataFrame) -> Column:
    """About the bytes of a row: text by its length, numbers by their width, nested values by their JSON form."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.length(F.to_json(F.struct(field.name))), F.lit(0))
        else:
            total = total + F.lit(8)
    return total


def fits(kept: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table is small enough to be broadcast, by its counted rows and bytes."""
    size = kept.agg(F.count(F.lit(1)).alias("rows"), F.sum(_bytes(kept)).alias("bytes")).first()
    return size["rows"] <= broadcast_rows and (size["bytes"] or 0) <= BROADCAST_BYTES


def by_size(kept: DataFrame) -> DataFrame:
    """A written table as the right side of a join: broadcast where it is counted small, shuffled otherwise."""
    return F.broadcast(kept) if fits(kept) else kept.hint("merge")


def lookup_join(
    facts: DataFrame,
    dictionary: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: Column | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_facts: int = HOT_FACTS,
) -> DataFrame:
    """Join ``facts`` to a dictionary that is unique on ``on``.

    Up to ``broadcast_rows`` rows and ``BROADCAST_BYTES`` the dictionary is broadcast. A larger one is joined by a shuffle,
    whatever its compressed files say of its size. Keys of more than ``hot_facts`` facts, and facts without a key, are
    joined on ``(on, salt)``: the salt comes from ``spread`` (a column that varies inside a hot key), so a key holding a third
    of the facts is split over as many tasks as a shuffle has, and ``SALTS`` at least. All ways give the same rows.
    """
    # Written, so that its size is taken and its rows are joined from one computation.
    kept = written(dictionary)
    if fits(kept, broadcast_rows):
        return facts.join(F.broadcast(kept), list(on), how)
    if spread is None:
        return facts.join(kept.hint("merge"), list(on), how)
    # At most facts / hot_facts keys can be hot.
    counted = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_facts)
    hot = written(counted.select(*on, F.lit(True).alias("_hot")))
    if hot.isEmpty():
        return facts.join(kept.hint("merge"), list(on), how)
    salts = max(SALTS, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyless = F.lit(False)
    for name in on:
        keyless = keyless | F.col(name).isNull()
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    salted = facts.join(F.broadcast(hot), list(on), "left").withColumn(
        "_salt", F.when(F.col("_hot") | keyless, salt).otherwise(F.lit(0))
    ).select(*facts.columns, "_salt")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = kept.join(F.broadcast(hot), list(on), "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")
