"""Sessions in pieces: nothing is lost, no row is unbounded, and work by session reads the buckets without an exchange."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.sources.sessions import SessionTable


def elements_of(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows = [(s, p, rng.choice("abcde"), p % 2) for s, n in sizes.items() for p in range(n)]
    return rows, spark.createDataFrame(rows, "seq_id string, pos long, key string, flag int").repartition(5)


@pytest.mark.parametrize("hot", [1 << 20, 100])
def test_round_trip(spark, hot):
    rows, df = elements_of(spark, {"a": 1, "b": 7, "c": 8, "d": 250, "e": 33})
    table = SessionTable.write(df, ["key", "flag"], buckets=4, piece=8, hot=hot)
    assert sorted(map(tuple, table.elements().collect())) == sorted(rows)
    pieces = table.pieces().collect()
    assert max(r.n for r in pieces) == 8 and {(r.seq_id, r.piece) for r in pieces} == {(s, p // 8) for s, p, *_ in rows}
    assert all([e.pos for e in r.elements] == list(range(r.piece * 8, r.piece * 8 + r.n)) for r in pieces)
    got = {r.seq_id: (r.n, r.label) for r in table.by_session(F.count(F.lit(1)).alias("n"), F.max("flag").alias("label")).collect()}
    assert got == {"a": (1, 0), "b": (7, 1), "c": (8, 1), "d": (250, 1), "e": (33, 1)}
    vocab = spark.createDataFrame([("a",), ("b",)], "key string")
    scores = {r.seq_id: r.score for r in table.shares(vocab).collect()}
    for s in "abcde":
        mine = [k for q, _, k, _ in rows if q == s]
        assert scores[s] == pytest.approx(sum(k not in "ab" for k in mine) / len(mine))
    assert (table.long_path is None) == (hot > 250)
    table.drop()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "").count("Exchange")


def test_work_by_session_needs_no_exchange(spark):
    _, df = elements_of(spark, {f"s{k}": 20 for k in range(40)})
    table = SessionTable.write(df, ["key", "flag"], buckets=4, piece=8)
    assert exchanges(df.groupBy("seq_id").count()) == exchanges(df) + 1
    assert exchanges(table.by_session(F.count(F.lit(1)).alias("n"))) == 0
    vocab = spark.createDataFrame([("a",)], "key string")
    assert exchanges(table.shares(vocab)) == 0
    table.drop()


def test_empty(spark):
    _, df = elements_of(spark, {})
    table = SessionTable.write(df, ["key"], buckets=2)
    assert table.elements().collect() == [] and table.by_session(F.count(F.lit(1)).alias("n")).collect() == []
    table.drop()
