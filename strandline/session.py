"""Session construction and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; cluster settings given outside win."""
    builder = SparkSession.builder.appName("strandline")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch one only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="strandline-", dir="/tmp")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


_tables: list[str] = []


def written_tables() -> list[str]:
    """Tables that :func:`written` made and :func:`release` has not removed."""
    return list(_tables)


def remember_folder(path: str) -> None:
    """Let :func:`release` remove a folder as well."""
    _tables.append(path)


def release(spark: SparkSession) -> None:
    """Remove the tables that :func:`written` made; call it when the results built on them have been used."""
    jvm = spark._jvm
    while _tables:
        path = jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once as a parquet table in the checkpoint folder and read it back.

    For results that several branches of a job use (:func:`release` removes the tables afterwards): they are computed once, survive the loss of executors, and keep
    column pruning and size statistics, so small ones are broadcast by size. ``schema`` reads columns back as a type that is stored alike.
    """
    folder = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{folder}/strandline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)
