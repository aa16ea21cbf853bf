"""What building and running a query leaves behind and costs."""

import os

import __spark_entry__ as entry_module
from strandline.operators import vocabulary
from strandline.session import release, written, written_tables

FOLDER = "/root/testdata/sf0.001"


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_masking_is_built_without_jobs(spark):
    release(spark)
    made = []
    built = jobs_of(spark, "build", lambda: made.append(entry_module.queries()["mask_tokens"](spark, FOLDER)))
    assert built <= 3 and len(written_tables()) <= 1
    assert made[0].count() == 1000


def test_released_tables_are_gone(spark):
    path = written(spark.range(5).toDF("x")).inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    release(spark)
    assert not os.path.exists(path) and not written_tables()


def test_equal_keys_are_ranked_in_several_tasks(spark):
    """Keys of one frequency with a common beginning must not meet in one block."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counted = spark.range(4000).selectExpr("concat('view_item_', lpad(cast(id as string), 8, '0')) as key", "cast(1 as bigint) as freq")
        ranked = vocabulary.by_frequency(counted, "rank")
        rows = ranked.orderBy("key").collect()
        assert [r["rank"] for r in rows] == list(range(1, 4001))
        table = spark.read.parquet(written_tables()[-1])
        assert table.select("_range").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
