"""Set sketches against sets, quantile sketches against sorted values."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import sketches


def plain(rows):
    out = {}
    for step in {r[0] for r in rows}:
        part = {p: {k for s, q, k in rows if s == step and q == p} for p in ("train", "test_normal", "test_abnormal")}
        train, normal, abnormal = part["train"], part["test_normal"], part["test_abnormal"]
        share = lambda t: len(t - train) / len(t) if t else None  # noqa: B023, E731
        out[step] = (len(train), len(normal), len(abnormal), len(train | normal | abnormal), share(normal), share(abnormal), share(normal | abnormal))
    return out


def test_small_parts_are_exact(spark):
    rng = random.Random(1)
    rows = [(s, rng.choice(["train", "test_normal", "test_abnormal"]), f"k{rng.randrange(40 * (s + 1))}") for s in range(4) for _ in range(200)]
    rows += [(9, "train", "a"), (10, "test_normal", "a"), (11, "test_abnormal", "b"), (11, "train", "b")]
    df = spark.createDataFrame(rows, "step int, part string, key string").repartition(4)
    got = {r.step: tuple(r)[1:] for r in sketches.unseen_key_statistics(df, ["step"]).collect()}
    assert got == plain(rows)


def test_large_parts_stay_within_the_error(spark):
    parts = [("train", 0, 60_000), ("test_normal", 40_000, 90_000), ("test_abnormal", 80_000, 100_000)]
    df = None
    for name, a, b in parts:
        made = spark.range(a, b).select(F.lit(0).alias("step"), F.lit(name).alias("part"), F.concat(F.lit("k"), F.col("id")).alias("key"))
        df = made if df is None else df.unionByName(made)
    row = sketches.unseen_key_statistics(df, ["step"], size=12).first()
    error = 4 * 2**-6
    assert row.train_vocab == pytest.approx(60_000, rel=error) and row.total_vocab == pytest.approx(100_000, rel=error)
    assert row.ratio_unseen_normal == pytest.approx(0.6, abs=error) and row.ratio_unseen_abnormal == pytest.approx(1.0, abs=error)


@pytest.mark.parametrize("k", [32, 1024])
def test_merged_quantiles_stay_within_the_rank_error(spark, k):
    rng = random.Random(k)
    rows = [(f"day{i % 9}", rng.gauss(0, 1) if i % 3 else float(rng.randrange(4))) for i in range(20_000)] + [("day0", None)]
    df = spark.createDataFrame(rows, "day string, value double").repartition(7)
    daily = sketches.quantile_sketches(df, "value", ["day"], k)
    shares = [0.01, 0.25, 0.5, 0.9, 0.999]
    values = sorted(v for _, v in rows if v is not None)
    for r in sketches.quantiles(sketches.merged(daily), shares).collect():
        assert r.n == len(values)
        below, upto = sum(v < r.value for v in values) / len(values), sum(v <= r.value for v in values) / len(values)
        assert below - sketches.rank_error(k) <= r.share <= upto + sketches.rank_error(k)


def test_few_values_are_exact(spark):
    df = spark.createDataFrame([("d", float(v)) for v in range(100)], "day string, value double")
    got = {r.share: r.value for r in sketches.quantiles(sketches.quantile_sketches(df, "value", ["day"], 1024), [0.0, 0.5, 1.0]).collect()}
    assert got[0.0] == 0.0 and got[0.5] in (49.0, 50.0) and got[1.0] == 99.0
