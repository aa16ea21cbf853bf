"""Plan helpers: small blocks and low limits force the paths that large data would take."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.plans import lookup, running
from strandline.plans.neighbours import over_neighbours


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.4 else f"g{rng.randrange(20)}", rng.randrange(-5, 30)) for i in range(1, 601)]
    rows += [(601, None, 1), (602, None, 4)]
    return rows, spark.createDataFrame(rows, "line_id long, grp string, x long").cache()


@pytest.mark.parametrize("hot_rows", [50, 10_000])
def test_running_matches_plain_loop(skewed, hot_rows):
    rows, df = skewed
    made = running.running(
        df, ["line_id"], running.line_block(size=7), {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))},
        within=["grp"], totals={"t": "s"}, hot_rows=hot_rows,
    ).collect()
    state, totals = {}, {}
    for line, grp, x in rows:
        totals[grp] = totals.get(grp, 0) + x
    expected = {}
    for line, grp, x in rows:
        s, m = state.get(grp, (0, None))
        state[grp] = (s + x, x if m is None else max(m, x))
        expected[line] = (*state[grp], totals[grp])
    assert {r.line_id: (r.s, r.m, r.t) for r in made} == expected


def test_running_over_whole_table_with_stretches(skewed, monkeypatch):
    rows, df = skewed
    monkeypatch.setattr(running, "BLOCKS_PER_STRETCH", 3)
    made = running.running(df, ["line_id"], running.line_block(size=7), {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))}, totals={"t": "s"})
    s, m, expected = 0, -100, {}
    for line, _, x in rows:
        s, m = s + x, max(m, x)
        expected[line] = (s, m, sum(r[2] for r in rows))
    assert {r.line_id: (r.s, r.m, r.t) for r in made.collect()} == expected


def test_shuffled_is_a_permutation(spark):
    ids = spark.range(500).withColumnRenamed("id", "seq_id")
    got = running.shuffled(ids, "seq_id", 9, "rank", total="n").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 501)) and {r["n"] for r in got} == {500}
    import hashlib

    order = sorted(range(500), key=lambda i: hashlib.md5(f"9|{i}".encode()).hexdigest())
    assert [r["seq_id"] for r in sorted(got, key=lambda r: r["rank"])] == order


def test_value_blocks_never_decrease(spark):
    values = [-1e9, -3.5, -1e-9, 0.0, 1e-12, 0.25, 0.3, 1.0, 1.0000001, 7.0, 1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", running.value_blocks("v").alias("b"))
    blocks = [r["b"] for r in sorted(df.collect(), key=lambda r: r["v"])]
    assert blocks == sorted(blocks)


def test_neighbours_across_blocks(spark):
    rows = [(s, p, f"{s}{p}") for s in "ab" for p in range(23)]
    df = spark.createDataFrame(rows, "seq_id string, pos long, key string")
    made = over_neighbours(
        df, ["seq_id"], "pos", 2, 1,
        {"prev2": lambda w: F.lag("key", 2).over(w), "next": lambda w: F.lead("key").over(w)}, block_size=5,
    ).collect()
    assert len(made) == len(rows)
    for r in made:
        assert r.prev2 == (f"{r.seq_id}{r.pos - 2}" if r.pos >= 2 else None)
        assert r.next == (f"{r.seq_id}{r.pos + 1}" if r.pos < 22 else None)


def test_lookup_join_salted_equals_broadcast(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(200)], "i long, key string")
    words = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "key string, idx long")
    small = lookup.lookup_join(facts, words, ["key"], "left", F.col("i"))
    large = lookup.lookup_join(facts, words, ["key"], "left", F.col("i"), broadcast_rows=1)
    assert sorted(map(tuple, small.select("i", "key", "idx").collect()), key=str) == sorted(map(tuple, large.select("i", "key", "idx").collect()), key=str)


def test_lookup_join_keeps_hot_and_keyless_facts(spark):
    """Only hot keys are copied; facts without a key, and entries without one, meet nothing."""
    facts = spark.createDataFrame([(i, None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 7}") for i in range(300)], "i long, key string")
    words = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), (None, 9)], "key string, idx long")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = sorted(facts.join(words, "key", how).select("i").collect())
        for hot in (20, 1000):
            made = lookup.lookup_join(facts, words, ["key"], how, F.col("i"), broadcast_rows=1, hot_facts=hot)
            assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
            assert sorted(made.select("i").collect()) == plain


def test_driver_gets_no_large_table(spark):
    """Compressed files look small: a dictionary, or a log, of many rows must not be broadcast for that."""
    many = spark.range(200_000).selectExpr("id", "concat('key_', id) as key", "id + 1 as line_id", "1L as v")
    plans = [
        lookup.lookup_join(many, many.selectExpr("key", "id as idx"), ["key"], "left", F.col("id")),
        running.running(many, ["line_id"], running.line_block(), {"total": ("sum", F.col("v"))}),
    ]
    for made in plans:
        assert made.count() == 200_000
        plan = made._jdf.queryExecution().executedPlan().toString()
        broadcast = [line for line in plan.splitlines() if "BroadcastExchange" in line]
        assert "BroadcastHashJoin" in plan or not broadcast
    first = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in first and "SortMergeJoin" in first
    assert "BuildLeft" not in plans[1]._jdf.queryExecution().executedPlan().toString()


def test_groups_are_dealt_by_their_rows(spark):
    """More rows than the shuffle's tasks should hold are numbered in more tasks, with the same numbers."""
    rows = spark.range(2000).selectExpr("id as line_id", "if(id % 50 = 0, null, concat('g', id % 97)) as grp", "1L as x")
    measures = {"at": ("sum", F.col("x"))}
    plain = running.running(rows, ["line_id"], running.line_block(), measures, ["grp"])
    spread = running.running(rows, ["line_id"], running.line_block(), measures, ["grp"], task_rows=100)
    assert spread.rdd.getNumPartitions() == 20
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))


def test_window_counts_add_repeated_windows(spark):
    """A key that is null ends a window early, so a start may come twice; its counts are added."""
    from strandline.operators import features

    windows = spark.createDataFrame([("a", 0, ["x", "x", "y"]), ("a", 0, ["x", None, None]), (None, 0, ["<pad>"])], "seq_id string, start long, context array<string>")
    got = sorted(map(str, (tuple(r) for r in features.window_counts(windows).collect())))
    assert got == sorted(map(str, [("a", 0, "x", 3), ("a", 0, "y", 1), ("a", 0, None, 2), (None, 0, "<pad>", 1)]))
