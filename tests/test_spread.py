"""Groups go to tasks by their counted rows also below the shuffle's own number of tasks."""

from pyspark.sql import functions as F

from strandline.plans import running


def test_groups_are_dealt_by_rows_below_the_setting(spark):
    rows = spark.range(2000).selectExpr("id as line_id", "if(id % 50 = 0, null, concat('g', id % 97)) as grp", "1L as x")
    measures = {"at": ("sum", F.col("x"))}
    plain = running.running(rows, ["line_id"], running.line_block(), measures, ["grp"])
    dealt = running.running(rows, ["line_id"], running.line_block(), measures, ["grp"], task_rows=1000)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan(dealt) and "REPARTITION_BY_NUM" not in plan(plain)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
