"""Log views over the parquet tables: line logs, text logs, document lines and order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_seconds(column: str) -> Column:
    """Seconds since 1970 of a time without zone, read as UTC whatever the session's zone is."""
    time = F.col(column).cast("timestamp_ntz")
    clock = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    return F.unix_date(time.cast("date")).cast("long") * 86400 + clock


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as a structured log: dense ``line_id``, epoch seconds, session, key and element label."""
    k = F.get_json_object("props", "$.k")
    return table(spark, folder, "events").select(
        (F.col("event_id") + 1).alias("line_id"),
        epoch_seconds("ts").alias("epoch"),
        F.col("user_id").cast("string").alias("session"),
        F.concat_ws("_", "event_type", k).alias("key"),
        F.when((F.col("event_type") == "error") & (k.cast("int") >= 97), 1).otherwise(0).alias("el_label"),
        F.col("value"),
    )


def event_text(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` rendered as raw log text, one line per event, in the shape of a console log."""
    k = F.get_json_object("props", "$.k")
    events = table(spark, folder, "events")
    stamp = F.substring(F.col("ts").cast("timestamp_ntz").cast("string"), 1, 19)
    value = F.col("value").cast("decimal(18,2)").cast("string")
    content = (
        F.when(
            F.col("event_type") == "error",
            F.concat(F.lit("request "), k, F.lit(" for user_"), F.col("user_id"), F.lit(" failed with code "), k),
        )
        .when(
            F.col("event_type") == "purchase",
            F.concat(F.lit("user_"), F.col("user_id"), F.lit(" paid "), value, F.lit(" for item "), k),
        )
        .when(
            F.col("event_type") == "view",
            F.concat(F.lit("page /shop/item/"), k, F.lit(" viewed by user_"), F.col("user_id")),
        )
        .otherwise(
            F.concat(F.col("event_type"), F.lit(" from user_"), F.col("user_id"), F.lit(" took "), value, F.lit(" ms"))
        )
    )
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return events.select(
        (F.col("event_id") + 1).alias("line_no"),
        F.concat_ws(" ", stamp, level, F.concat(F.col("event_type"), F.lit(":")), content).alias("line"),
    )


EVENT_TEXT_FORMAT = "<Date> <Time> <Level> <Component>: <Content>"


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document: session = document, position = line number, key = class of the line."""
    return (
        table(spark, folder, "documents")
        .select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "pos", "lang", "line")
    )


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as event sequences: one sequence per order, key from flags and quantity bucket."""
    bucket = F.floor(F.col("l_quantity") / 10).cast("int")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("seq_id"),
        epoch_seconds("l_shipdate").alias("epoch"),
        F.col("l_linenumber").alias("line_number"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus"), bucket.cast("string")).alias("key"),
    )
