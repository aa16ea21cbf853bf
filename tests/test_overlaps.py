"""The overlap join, the bit-parallel subsequences and the fast subsequence miner against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import overlaps, templates


def random_lists(seed, n, longest=12, kinds=14):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(kinds)] + ["<*>"]
    made = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, longest))) for _ in range(n)}
    return sorted(made)


def frame(spark, messages):
    return spark.createDataFrame([(m, m.split()) for m in messages], "message string, tokens array<string>").repartition(4)


def plain_pairs(messages, leaders, share):
    out = {}
    for m in messages:
        for c in leaders:
            common = len((set(m.split()) & set(c.split())) - {"<*>"})
            if common >= max(share * len(m.split()) - 1e-9, 1):
                out[m, c] = common
    return out


def places_of(leader, message):
    """Positions of the leader on the subsequence that leaves the leader's end first, then the message's."""
    a, b = leader, message
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            same = a[i] == b[j] and a[i] != "<*>"
            size[i + 1][j + 1] = size[i][j] + 1 if same else max(size[i][j + 1], size[i + 1][j])
    i, j, out = len(a), len(b), []
    while size[i][j]:
        if size[i - 1][j] == size[i][j]:
            i -= 1
        elif size[i][j - 1] == size[i][j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


@pytest.mark.parametrize("share", [0.3, 0.5, 0.9])
def test_pairs_equal_double_loop(spark, share):
    messages, leaders = random_lists(1, 150), random_lists(2, 40)
    rows = overlaps.overlapping(frame(spark, messages), frame(spark, leaders), share).collect()
    assert len(rows) == len({(r.message, r.leader) for r in rows})
    assert {(r.message, r.leader): r.common for r in rows} == plain_pairs(messages, leaders, share)


def test_lengths_and_places_equal_double_loop(spark):
    rng = random.Random(5)
    messages = random_lists(3, 60) + [" ".join(f"w{rng.randrange(9)}" for _ in range(n)) for n in (62, 63, 64, 65, 200)]
    leaders = random_lists(4, 20) + [" ".join(f"w{rng.randrange(9)}" for _ in range(n)) for n in (63, 64, 130)]
    pairs = overlaps.overlapping(frame(spark, messages), frame(spark, leaders), 0.01)
    got = {(r.message, r.leader): (r.length, r.places) for r in overlaps.aligned(pairs).collect()}
    expected = {}
    for m, c in plain_pairs(messages, leaders, 0.01):
        places = places_of(c.split(), m.split())
        expected[m, c] = (len(places), places)
    assert got == expected
    # The miner that replays lines takes the same tokens where no wildcards are about.
    plain = [(m, c) for m, c in expected if "<*>" not in m and "<*>" not in c]
    assert all(len(templates.longest_common(m.split(), c.split())) == expected[m, c][0] for m, c in plain)


def test_plan_has_no_all_pairs(spark):
    pairs = overlaps.overlapping(frame(spark, random_lists(1, 30)), frame(spark, random_lists(2, 30)))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("drawn", [15, 256])
def test_every_message_has_a_leader(spark, drawn):
    messages = random_lists(6, 60, 9, 7)
    chosen = {r.message for r in overlaps.subsequence_leaders(frame(spark, messages), 0.5, 0.5, drawn).collect()}
    assert chosen <= set(messages)
    for m in messages:
        near = [c for c in chosen if (m, c) in plain_pairs([m], [c], 0.5) and len(places_of(c.split(), m.split())) >= 0.5 * len(m.split())]
        assert m in chosen or near


def is_subsequence(part, whole):
    left = iter(whole)
    return all(t in left for t in part)


def test_templates_are_common_to_their_members(spark):
    rng = random.Random(2)
    shapes = [lambda: f"open file {rng.randrange(30)} ok", lambda: f"open file {rng.randrange(30)} {rng.randrange(9)} ok now", lambda: f"disk d{rng.randrange(20)} is full", lambda: "", lambda: None]
    rows = [(i, rng.choice(shapes)()) for i in range(1, 200)]
    lines = spark.createDataFrame(rows, "line_id long, Content string").repartition(3)
    from strandline.functions import text

    got = {r.line_id: r.EventTemplate for r in overlaps.mine_subsequences(lines, text.tokens(F.col("Content")), 0.5).collect()}
    assert len(got) == len(rows)
    for line, content in rows:
        constants = [t for t in got[line].split() if t != "<*>"]
        assert is_subsequence(constants, (content or "").split())
        if content and content.startswith("open"):
            assert constants == ["open", "file", "ok"]
        if content and content.startswith("disk"):
            assert got[line] == "disk <*> is full"
        if not content:
            assert got[line] == ""
