"""Template miners against a plain sequential loop, with forced chunks and rounds."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import replay, templates


def sequential(messages, make):
    """Read the lines one by one: cluster of every line and the final templates."""
    learner, owner, final = make(), {}, {}
    for line, message in messages:
        if learner.ignores(message):
            continue
        cluster, template = learner.decide(message)
        if cluster is None:
            cluster, template = line, message
        if template is not None:
            learner.learn(cluster, template)
            final[cluster] = template
        owner[line] = cluster
    return owner, {c: replay.SEPARATOR.join(t) for c, t in final.items()}


def random_log(seed, n=400):
    rng = random.Random(seed)
    shapes = [["open", "file", None, "ok"], ["open", "dir", None, "ok"], ["close", None, "now"], [None, "failed", None, "times", None], ["x"]]
    words = ["a", "b", "c7", "d", "e", "f1", "open", "ok"]
    return [(i, [t or rng.choice(words) for t in rng.choice(shapes)]) for i in range(1, n + 1)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(
    "make",
    [
        partial(templates.FixedDepthTree, 3, 0.5),
        partial(templates.FixedDepthTree, 5, 0.5, 3),
        partial(templates.CommonSubsequence, 0.6),
    ],
)
def test_replay_equals_sequential_run(spark, seed, make):
    log = random_log(seed)
    df = spark.createDataFrame([(i, replay.SEPARATOR.join(m)) for i, m in log], "line_id long, message string").repartition(6, "line_id")
    changes = replay.learn_templates(df, make, first_lines=40, growth=3)
    owner, final = sequential(log, make)
    assert replay.final_templates(changes) == final
    got = {r.line_id: r.cluster for r in replay.assign_templates(df, make, changes).collect()}
    assert got == owner


def test_small_report_limit_still_converges(spark, monkeypatch):
    monkeypatch.setattr(replay, "REPORTS_PER_ROUND", 4)
    make = partial(templates.FixedDepthTree, 3, 0.5)
    log = random_log(5, 60)
    df = spark.createDataFrame([(i, replay.SEPARATOR.join(m)) for i, m in log], "line_id long, message string").repartition(3)
    assert replay.final_templates(replay.learn_templates(df, make)) == sequential(log, make)[1]


def test_mined_log_invariants(spark):
    lines = spark.createDataFrame(
        [(i + 1, f"user {n} opened file{n} in {n * 3} ms" if n % 3 else f"disk {n} full") for i, n in enumerate(range(60))] + [(61, "")],
        "line_id long, Content string",
    )
    mined = templates.mine_fixed_depth(lines, "Content", [r"\d+"], depth=3, similarity=0.3)
    table = {r.EventTemplate: r.Occurrences for r in templates.template_table(mined).collect()}
    assert table == {"user <*> opened file<*> in <*> ms": 40, "disk <*> full": 20, "": 1}
    phrased = templates.mine_common_subsequence(lines.filter("Content <> ''"), "Content", [r"\d+"], tau=0.5)
    assert phrased.count() == 60 and phrased.filter("EventTemplate is null").count() == 0


def test_common_subsequence_helpers():
    assert templates.longest_common(list("axbyc"), list("abzc")) == list("abc")
    assert templates.with_gaps(list("ac"), list("abcd")) == ["a", "<*>", "c", "<*>"]
    assert templates.with_gaps([], list("ab")) == ["<*>"]


def test_text_fixtures(spark):
    row = spark.range(1).select(
        text.mask(F.lit("x blk_-12 y"), text.MASKS["block_store"]).alias("masked"),
        text.event_id(F.lit("connection refused <*>")).alias("e1"),
        text.event_id(F.lit("PacketResponder <*> for block blk_<*> terminating")).alias("e2"),
        text.pattern_parameters(F.lit("took 5 ms at [x]"), F.lit("took <*> ms at [<*>]")).alias("p"),
        text.pattern_parameters(F.lit("other"), F.lit("took <*> ms")).alias("q"),
        text.tokens(F.lit("  a  b\tc ")).alias("t"), text.tokens(F.lit("  ")).alias("t0"),
        text.phrases(F.lit("a b: <*>, c;; ")).alias("ph"),
    ).first()
    assert row.masked == "x blk_<*> y" and row.e1 == "4ef4ed4c" and row.e2 == "d58a26f6"
    assert row.p == ["5", "x"] and row.q == [] and row.t == ["a", "b", "c"] and row.t0 == [] and row.ph == ["a b", " <*>", " c"]


def test_merge_and_assign(spark):
    messages = spark.createDataFrame([(1, ["open", "a", "ok"]), (2, ["open", "b", "ok"])], "i long, tokens array<string>")
    grouped = messages.withColumn("g", F.lit(1))
    merged = templates.merge_by_position(grouped, ["g"], "tokens").first()["template"]
    assert merged == ["open", "<*>", "ok"]
    known = spark.createDataFrame([(["connect", "<*>", "failed"],), (["<*>", "<*>", "<*>"],)], "template array<string>")
    asked = spark.createDataFrame([(1, ["connect", "5", "failed"]), (2, ["a", "b"])], "i long, tokens array<string>")
    got = {r.i: (r.template, r.equal, r.wild) for r in templates.assign_known(asked, known, "tokens").collect()}
    assert got == {1: (["connect", "<*>", "failed"], 2, 1), 2: (None, None, None)}
