"""The result table reads the lines once."""

import datetime as dt

from strandline.catalog import sampling


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_result_table_reads_the_lines_once(spark, tmp_path):
    day = dt.datetime(1995, 3, 1)
    rows = [(o, line, q, d, flag, status, None if o == 5 else day) for o, line, q, d, flag, status in (
        (1, 1, 30.0, 0.01, "R", "F"), (1, 2, 10.0, 0.07, "N", "F"), (2, 1, 25.0, 0.05, "R", "O"), (2, 1, 25.0, 0.05, "R", "O"),
        (3, 1, None, 0.09, "A", "F"), (3, 2, 40.0, None, "R", "F"), (4, 1, 5.0, 0.0, None, "O"), (5, 1, 50.0, 0.1, "R", None), (None, 1, 50.0, 0.1, "R", "F"),
    )]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    made = sampling.result_table(spark, str(tmp_path))
    assert plan_of(made).count("FileScan") == 1
    assert made.columns == ["method", "dataset", "ratio", "phase", "level", "f1", "mcc"]

    groups = {}
    for o, _, q, d, flag, status, when in rows:
        label = None if flag is None else int(flag == "R")
        phase = "valid" if o is not None and o % 2 == 0 else "test"
        for method, pred in (("discount", None if d is None else int(d >= 0.05)), ("quantity", None if q is None else int(q >= 25))):
            at = (method, status, None if when is None else 0.03, phase)
            groups.setdefault((*at, "element"), []).append((label, pred))
            groups.setdefault((*at, "sequence"), {}).setdefault(o, []).append((label, pred))
    expected = {}
    for at, pairs in groups.items():
        if isinstance(pairs, dict):
            most = lambda xs: max((x for x in xs if x is not None), default=None)
            pairs = [(most(y for y, _ in p), most(x for _, x in p)) for p in pairs.values()]
        tp, fp, fn = (pairs.count(c) for c in ((1, 1), (0, 1), (1, 0)))
        p, r = 100 * tp / (tp + fp) if tp + fp else 0, 100 * tp / (tp + fn) if tp + fn else 0
        expected[at] = 2 * p * r / (p + r) if p + r else 0
    got = {(r.method, r.dataset, r.ratio, r.phase, r.level): r.f1 for r in made.collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
