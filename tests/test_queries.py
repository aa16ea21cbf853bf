"""The registered queries run and keep their contract on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["window_unseen_result", "instability_sweep", "masked_rank", "template_assign", "mask_ratio", "perf_table", "window_hour_counts"]


def test_registered_names():
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) >= 100


def test_entry(spark):
    assert entry_module.entry(spark).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "documents", "labels", "lineitem", "orders", "embeddings"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = entry_module.queries()[name](spark, FOLDER)
    relation = con.execute(entry_module.oracle_sql()[name])
    names = [c[0] for c in relation.description]
    theirs = sorted(str([dict(zip(names, row))[c] for c in sorted(names)]) for row in relation.fetchall())
    ours = sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())
    assert sorted(df.columns) == sorted(names) and ours == theirs


def test_split_extremes_keep_ties(spark):
    """Splits that share the smallest or largest ratio are all reported; one split alone is both."""
    from strandline.operators import reports

    parts = {"train": ("n", "v")}
    stats = spark.createDataFrame([(0.1, 5, 1), (0.1, 6, 2), (0.3, 7, 3), (0.2, 8, 4), (None, 9, 5)], "r double, n bigint, v bigint")
    got = sorted(tuple(x) for x in reports.split_extremes(stats, "r", parts).collect())
    assert got == [("max", 0.3, "train", 7, 3), ("min", 0.1, "train", 5, 1), ("min", 0.1, "train", 6, 2)]
    alone = reports.split_extremes(stats.where("n = 7"), "r", parts).collect()
    assert sorted(x["extreme"] for x in alone) == ["max", "min"]


def test_session_table_holds_whole_sessions(spark, tmp_path):
    """A session longer than 4 096 elements is still one row."""
    folder, n = str(tmp_path), 5000
    rows = spark.range(n + 3).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as ts", f"if(id < {n}, 1L, 2L) as user_id",
        "'view' as event_type", "cast(id as double) as value", "concat('{\"k\": ', id % 90, '}') as props",
    )
    rows.write.parquet(f"{folder}/events.parquet")
    got = {r["seq_id"]: r for r in entry_module.queries()["session_table_round_trip"](spark, folder).collect()}
    assert {k: r["n"] for k, r in got.items()} == {"1": n, "2": 3}
    assert got["1"]["keys"] == " ".join(f"view_{i % 90}" for i in range(n))


def test_windows_of_one_class(spark, tmp_path):
    """A log whose windows are all abnormal has nothing to train on and no normal window to test."""
    folder, n = str(tmp_path), 2000
    spark.range(n).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 60) as ts", "id % 7 as user_id",
        "if(id % 50 = 0, 'error', 'view') as event_type", "cast(id as double) as value", "if(id % 50 = 0, '{\"k\": 98}', concat('{\"k\": ', id % 90, '}')) as props",
    ).write.parquet(f"{folder}/events.parquet")
    got = entry_module.queries()["window_unseen_result"](spark, folder).first().asDict()
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    relation = con.execute(entry_module.oracle_sql()["window_unseen_result"])
    expected = dict(zip([c[0] for c in relation.description], relation.fetchone()))
    assert str(sorted(got.items())) == str(sorted(expected.items()))
    assert got["TP"] == got["samples"] > 0 and got["AUPRC"] == 1.0 and got["AUROC"] != got["AUROC"]
