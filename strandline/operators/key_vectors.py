"""Vectors of keys learned from their neighbours: the positive pointwise mutual information of neighbouring keys, factorised.

Everything stays in long form. ``neighbour_counts`` counts ordered pairs of keys within ``reach`` places of a sequence; ``positive_information``
keeps the pairs that meet more often than by chance, with ``ln(count * all / (row * column))``; alternating least squares over that table
(absent pairs weigh as zeros) gives a vector for every key that has a pair. Keys never trained on have none: next to hashed text vectors
they keep those and get zeros in the learned dimensions.
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.plans.lookup import lookup_join
from strandline.plans.neighbours import over_neighbours
from strandline.plans.running import numbered, ranged
from strandline.session import written


def neighbour_counts(elements: DataFrame, reach: int) -> DataFrame:
    """``key, other, cnt`` of all pairs of places up to ``reach`` apart in a sequence, both ways; from ``seq_id, pos, key``."""
    ahead = {"_ahead": lambda w: F.collect_list("key").over(w.rowsBetween(1, reach))}
    seen = over_neighbours(elements.select("seq_id", "pos", "key"), ["seq_id"], "pos", 0, reach, ahead)
    once = seen.select("key", F.explode("_ahead").alias("other")).groupBy("key", "other").agg(F.count(F.lit(1)).alias("cnt"))
    once = written(once)
    back = once.select(F.col("other").alias("key"), F.col("key").alias("other"), "cnt")
    return once.unionByName(back).groupBy("key", "other").agg(F.sum("cnt").alias("cnt"))


def positive_information(counts: DataFrame) -> DataFrame:
    """``key, other, value`` of the pairs with positive pointwise mutual information."""
    counts = written(counts)
    rows = written(counts.groupBy("key").agg(F.sum("cnt").alias("_row")))
    total = rows.agg(F.sum("_row")).first()[0] or 1
    placed = lookup_join(counts, rows, ["key"], "inner", F.col("other"))
    placed = lookup_join(placed, rows.withColumnsRenamed({"key": "other", "_row": "_column"}), ["other"], "inner", F.col("key"))
    value = F.ln(F.col("cnt") * F.lit(float(total)) / (F.col("_row") * F.col("_column").cast("double")))
    return placed.select("key", "other", value.alias("value")).where("value > 0")


def factorised(information: DataFrame, rank: int = 16, rounds: int = 10, weight: float = 4.0, penalty: float = 0.05, seed: int = 7) -> DataFrame:
    """``key, dim, value``: the row factors of the table."""
    information = written(information)
    names = information.select("key").unionByName(information.select(F.col("other").alias("key"))).distinct()
    ids = written(numbered(ranged(names, ["key"]), ["key"], F.col("_range"), "_n").select("key", F.col("_n").cast("int").alias("id")))
    cells = lookup_join(information, ids, ["key"], "inner", F.col("other")).withColumnRenamed("id", "row")
    cells = lookup_join(cells, ids.withColumnsRenamed({"key": "other", "id": "column"}), ["other"], "inner", F.col("key"))
    cells = cells.select("row", "column", F.col("value").cast("float").alias("value"))
    if cells.isEmpty():
        return names.select("key", F.lit(0).cast("long").alias("dim"), F.lit(0.0).alias("value")).limit(0)
    model = ALS(
        rank=rank, maxIter=rounds, regParam=penalty, alpha=weight, implicitPrefs=True, seed=seed, userCol="row", itemCol="column", ratingCol="value", checkpointInterval=-1
    ).fit(cells)
    opened = model.userFactors.select("id", F.posexplode("features").alias("dim", "value"))
    return lookup_join(opened, ids, ["id"], "inner", F.col("dim")).select("key", F.col("dim").cast("long").alias("dim"), F.col("value").cast("double").alias("value"))


def learned_vectors(elements: DataFrame, reach: int, rank: int = 16, **options) -> DataFrame:
    """``key, dim, value`` of the keys of ``elements`` (``seq_id, pos, key``)."""
    return factorised(positive_information(neighbour_counts(elements, reach)), rank, **options)


def beside(hashed: DataFrame, learned: DataFrame, dims: int) -> DataFrame:
    """Hashed vectors of ``dims`` dimensions with the learned ones behind them."""
    return hashed.select("key", "dim", "value").unionByName(learned.select("key", (F.col("dim") + dims).alias("dim"), "value"))
