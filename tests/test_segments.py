"""The segment join and the fast miner against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import segments, templates

SEP = " "


def alike(a, b):
    return sum(x == y and x != "<*>" for x, y in zip(a, b))


def least(n, similarity):
    return next(m for m in range(1, n + 2) if m >= n * similarity - 1e-9)


def random_messages(seed, n):
    rng = random.Random(seed)
    shapes = [["open", "file", None, "ok", None], ["open", "dir", None, "ok", "now"], ["close", None, "now"], [None, "failed", None, "times", None, None], ["x"], [None, None]]
    words = ["a", "b", "c7", "d", "<*>", "f1", "open", "ok"]
    return sorted({SEP.join(t or rng.choice(words) for t in rng.choice(shapes)) for _ in range(n)})


def frame(spark, messages):
    return spark.createDataFrame([(m, m.split(SEP)) for m in messages], "message string, tokens array<string>").repartition(4)


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.8, 1.0])
def test_join_equals_double_loop(spark, similarity):
    messages, chosen = random_messages(1, 200), random_messages(2, 25)
    got = {r.message: (r.equal, r.leader) for r in segments.best_leaders(frame(spark, messages), frame(spark, chosen), similarity).collect()}
    expected = {}
    for m in messages:
        a = m.split(SEP)
        near = [(-alike(a, c.split(SEP)), c) for c in chosen if len(c.split(SEP)) == len(a) and alike(a, c.split(SEP)) >= least(len(a), similarity)]
        if near:
            best = min(near)
            expected[m] = (-best[0], best[1])
    assert got == expected


@pytest.mark.parametrize("drawn", [2, 512])
def test_leaders_are_apart_and_reach_all(spark, drawn):
    messages = random_messages(3, 300)
    chosen = [r.message for r in segments.leaders(frame(spark, messages), 0.5, drawn).collect()]
    assert len(chosen) == len(set(chosen)) and set(chosen) <= set(messages)
    near = lambda a, b: len(a) == len(b) and alike(a, b) >= least(len(a), 0.5)
    for k, a in enumerate(chosen):
        assert not any(near(a.split(), b.split()) for b in chosen[:k])
    for m in messages:
        assert m in chosen or any(near(m.split(), c.split()) for c in chosen)


def covers(template, message):
    return len(template) == len(message) and all(t in ("<*>", m) for t, m in zip(template, message))


def test_separated_log_equals_exact_miner(spark):
    rng = random.Random(7)
    shapes = [lambda: f"user u{rng.randrange(50)} opened f{rng.randrange(50)} in room", lambda: f"disk d{rng.randrange(9)} is full", lambda: "service started", lambda: f"code {rng.randrange(5)}", lambda: ""]
    rows = [(i, rng.choice(shapes)()) for i in range(1, 301)]
    lines = spark.createDataFrame(rows, "line_id long, Content string").repartition(5)
    fast = {r.line_id: r for r in segments.mine_segments(lines, "Content", [r"\d+"], 0.4).collect()}
    exact = {r.line_id: r for r in templates.mine_fixed_depth(lines, "Content", [r"\d+"], 3, 0.4).collect()}
    assert {k: (r.EventTemplate, r.EventId) for k, r in fast.items()} == {k: (r.EventTemplate, r.EventId) for k, r in exact.items()}
    raw = {r.line_id: r.EventTemplate for r in segments.mine_segments(lines, "Content", [], 0.4).collect()}
    for line, content in rows:
        assert covers(raw[line].split(), content.split())
    assert len(set(raw.values())) <= 4 + 5


def test_templates_merge_their_members_and_no_null(spark):
    rows = [(1, "a b c"), (2, "a b d"), (3, None), (4, "   "), (5, "<*> <*>"), (6, "<*> <*>"), (7, "a b c")]
    lines = spark.createDataFrame(rows, "line_id long, Content string")
    got = {r.line_id: r.EventTemplate for r in segments.mine_segments(lines, "Content", [], 0.6).collect()}
    assert got == {1: "a b <*>", 2: "a b <*>", 3: "", 4: "", 5: "<*> <*>", 6: "<*> <*>", 7: "a b <*>"}


def test_only_distinct_messages_are_shuffled(spark):
    """A hot message leaves a task once: the scan's aggregate is partial."""
    lines = spark.range(20_000).select(F.col("id").alias("line_id"), F.lit("one and the same line").alias("Content"))
    made = segments.mine_segments(lines, "Content", [], 0.4)
    assert made.select("EventTemplate").distinct().collect()[0][0] == "one and the same line"
    assert made.count() == 20_000
