"""Windows, contexts, codecs and log files against fixtures and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import codec, text
from strandline.operators import sequences, templates
from strandline.sources import logs


def windows_by_scan(times, width, step):
    """Forward scan over the log: distinct non-empty windows as (first, end) index pairs with their number."""
    found, k, start, end = {}, 0, times[0], 0
    first = 0
    while True:
        while end < len(times) and times[end] < start + width:
            end += 1
        while first < len(times) and times[first] < start:
            first += 1
        if first < end:
            found.setdefault((first, end), k)
        if end >= len(times):
            return {v: key for key, v in found.items()}
        k, start = k + 1, start + step


def lines_of(spark, times):
    rows = [(i + 1, t, f"k{t % 5}", int(t % 7 == 0)) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "line_id long, epoch long, key string, el_label int")


def test_window_fixture(spark):
    made = sequences.TimeWindows(lines_of(spark, [0, 10, 20, 65, 70, 130, 400]), 60, 30, min_len=1).windows().collect()
    assert sorted((r.seq_id, r.first_line - 1, r.last_line) for r in made) == [(0, 0, 3), (1, 3, 5), (3, 5, 6), (12, 6, 7)]


@pytest.mark.parametrize("width,step", [(60, 30), (50, 35), (20, 45)])
def test_windows_equal_forward_scan(spark, width, step):
    rng = random.Random(width)
    times, t = [], 1000
    for _ in range(150):
        t += rng.choice([0, 1, 2, 5, 9, 40])
        times.append(t - rng.choice([0, 0, 0, 15]))
    clock, high = [], 0
    for t in times:
        high = max(high, t)
        clock.append(high)
    windows = sequences.TimeWindows(lines_of(spark, times), width, step, min_len=1)
    expected = windows_by_scan(clock, width, step)
    got = {r.seq_id: (r.first_line - 1, r.last_line) for r in windows.windows().collect()}
    assert got == expected
    elements = windows.elements().groupBy("seq_id").agg(F.sort_array(F.collect_list("line_id")).alias("l")).collect()
    assert {r.seq_id: r.l for r in elements} == {k: list(range(a + 1, b + 1)) for k, (a, b) in expected.items()}
    counts = windows.key_counts().groupBy("seq_id").agg(F.sum("cnt").alias("n")).collect()
    by_first = {r.seq_id: r.n for r in counts}
    assert all(by_first[k] == b - a for k, (a, b) in expected.items())


def test_next_event_fixtures(spark):
    df = spark.createDataFrame(
        [(0, i, k) for i, k in enumerate("abcd")] + [(1, 0, "a")], "seq_id long, pos long, key string"
    )
    made = sequences.next_event_windows(df, 2, F.lit("#Pad")).collect()
    got = sorted((r.seq_id, r.start, r.context, r.next_key) for r in made)
    assert got == [
        (0, 0, ["a", "b"], "c"), (0, 1, ["b", "c"], "d"), (0, 2, ["c", "d"], "#Pad"), (1, 0, ["a", "#Pad"], "#Pad"),
    ]


def test_codec_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(7, ["a", "b|"], [0, 1])], "seq_id long, key array<string>, el_label array<int>")
    line = df.select("seq_id", codec.encode_sequence(["key", "el_label"]).alias("line"))
    assert line.first()["line"] == "a!;!0!|!b|!;!1!|!"
    back = codec.decode_sequence(line, "line", ["key", "el_label"]).orderBy("pos").collect()
    assert [(r.seq_id, r.pos, r.key, r.el_label) for r in back] == [(7, 0, "a", "0"), (7, 1, "b|", "1")]
    logs.write_sequences(df, ["key", "el_label"], str(tmp_path / "seq"))
    assert logs.read_sequences(spark, str(tmp_path / "seq"), ["key", "el_label"]).count() == 2


def test_scan_log_numbers_matching_lines_in_file_order(spark, tmp_path):
    lines = [f"2024-01-0{i % 9 + 1} INFO part{i}: message {i}" if i % 4 else f"broken {i}" for i in range(4000)]
    (tmp_path / "app.log").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        made = logs.scan_log(spark, str(tmp_path / "app.log"), "<Date> <Level> <Part>: <Content>").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {r.LineId: r.Content for r in made}
    expected = [line.split(": ", 1)[1] for line in lines if not line.startswith("broken")]
    assert [got[i + 1] for i in range(len(got))] == expected


def test_structured_sinks(spark, tmp_path):
    structured = spark.createDataFrame([(1, "x y", ["5"]), (2, "", [])], "LineId long, Content string, ParameterList array<string>")
    dictionary = spark.createDataFrame([("id", "t", 2)], "EventId string, EventTemplate string, Occurrences long")
    logs.write_structured(structured, dictionary, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p" / "structured")).count() == 2
    logs.write_structured(structured, dictionary, str(tmp_path / "c"), form="csv")
    back = logs.read_structured_csv(spark, str(tmp_path / "c" / "structured"), "LineId long, Content string, ParameterList string")
    assert sorted((r.LineId, r.Content) for r in back.collect()) == [(1, "x y"), (2, "")]
    logs.append_result(dictionary, str(tmp_path / "r"), seed=3)
    logs.append_result(dictionary, str(tmp_path / "r"), seed=4)
    assert sorted(r.param_seed for r in spark.read.parquet(str(tmp_path / "r")).collect()) == ["3", "4"]


def test_header_pattern_and_separators(spark):
    pattern, headers = text.header_pattern("<Date> <Level>: <Content>")
    assert headers == ["Date", "Level", "Content"] and pattern == r"^(.*?)\s+(.*?):\s+(.*?)$"
    df = spark.createDataFrame([("a  b: c d",), ("nothing",), ("a b: c\x1fd",)], "line string")
    got = sorted(tuple(r) for r in text.parse_headers(df, "<Date> <Level>: <Content>").collect())
    assert got == [("a", "b", "c\x1fd"), ("a", "b", "c d")]


def test_sessions_and_chunks(spark):
    lines = spark.createDataFrame([(1, "blk_1 to blk_-2"), (2, "blk_1 blk_1"), (3, "none")], "line_id long, content string")
    made = sequences.sessions_by_pattern(lines, "content", r"(blk_-?\d+)").collect()
    assert sorted((r.seq_id, r.line_id, r.pos) for r in made) == [("blk_-2", 1, 0), ("blk_1", 1, 0), ("blk_1", 2, 1)]
    elements = spark.createDataFrame([(0, i, f"k{i}") for i in range(7)], "seq_id long, pos long, key string")
    got = {r.chunk: r.key for r in sequences.chunks(elements, 3, ["key"], seq_len=5).collect()}
    assert got == {0: ["k0", "k1", "k2"], 1: ["k3", "k4"]}
    assert sequences.at_least(elements, 8).count() == 0 and sequences.at_least(elements, 7).count() == 7


def test_unknown_ids_are_rejected(spark):
    sessions = spark.createDataFrame([(1,), (2,)], "seq_id long")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "seq_id long, label long")
    assert {(r.seq_id, r.label) for r in sequences.labelled_strictly(sessions, labels).collect()} == {(1, 0), (2, 1)}
    with pytest.raises(Exception, match="no label for 2"):
        sequences.labelled_strictly(sessions, labels.where("seq_id = 1")).collect()
    elements = spark.createDataFrame([(0, "e1"), (1, "e2")], "pos long, EventId string")
    known = spark.createDataFrame([("e1", "a <*>")], "EventId string, EventTemplate string")
    with pytest.raises(Exception, match="no template for e2"):
        templates.decode_templates(elements, known).collect()
    assert templates.decode_templates(elements.where("pos = 0"), known).first()["EventTemplate"] == "a <*>"
