"""Log files: reading lines with dense ids, structured and template tables, sequence text, result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import codec, text
from strandline.plans.lookup import lookup_join
from strandline.plans.running import line_block, numbered

BLOCK_ROWS = 1 << 33


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: file, start of the scanned piece, order inside it."""
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("piece"),
    )


def scan_log(spark: SparkSession, path: str, log_format: str, fold: bool = False) -> DataFrame:
    """Structured log: ``LineId`` 1..N over the matching lines in file order, then the header columns.

    The rows stay where they were read. Every task numbers its own matching lines; the number of lines of each piece,
    one row per piece of a file, gives the offset that turns these into dense ids.
    """
    lines = read_lines(spark, path)
    if fold:
        lines = lines.withColumn("line", text.fold_non_ascii(F.col("line")))
    # The id is added above the filter, so inside a task it counts matching lines only.
    parsed = text.parse_headers(lines, log_format).withColumn("_at", F.monotonically_increasing_id())
    pieces = parsed.groupBy("file", "piece").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("file", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        "file", "piece", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before")
    )
    placed = lookup_join(parsed, offsets, ["file", "piece"], "inner")
    headers = [c for c in parsed.columns if c not in ("file", "piece", "_at")]
    return placed.select((F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("LineId"), *headers)


def structure_table(lines: DataFrame, log_format: str, order: str, line: str = "line") -> DataFrame:
    """:func:`scan_log` for lines held in a table with a dense order column.

    Both passes of the numbering only test the pattern; the headers are cut out afterwards, once.
    """
    matching = text.matching_lines(lines, log_format, line)
    ids = numbered(matching.select(order, line), [order], line_block(order), "LineId").drop(order)
    return text.parse_headers(ids, log_format, line)


def head_sample(lines: DataFrame, n: int, label: str = "el_label") -> tuple[DataFrame, DataFrame]:
    """The first ``n`` lines of a log with dense ids, and their share of anomalous lines."""
    head = lines.filter(F.col("line_id") <= n)
    return head, head.agg(F.count(F.lit(1)).alias("lines"), F.avg(label).alias("abnormal_rate"))


def write_structured(structured: DataFrame, templates: DataFrame, folder: str, form: str = "parquet") -> None:
    """Structured log and template dictionary; csv output escapes with ``~``."""
    for name, table in (("structured", structured), ("templates", templates)):
        writer = table.write.mode("overwrite")
        if form == "csv":
            flat = table.select(*[
                F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in table.dtypes
            ])
            flat.write.mode("overwrite").csv(f"{folder}/{name}", header=True, escape="~")
        else:
            writer.parquet(f"{folder}/{name}")


def read_structured_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Csv tables with a declared schema; an empty field is an empty string, not null."""
    return spark.read.csv(path, header=True, schema=schema, escape="~", nullValue="\u0000", emptyValue="")


def write_sequences(sequences: DataFrame, columns: list[str], folder: str, marks: codec.Marks = codec.STANDARD) -> None:
    """One text line per sequence."""
    sequences.select(codec.encode_sequence(columns, marks).alias("value")).write.mode("overwrite").text(folder)


def read_sequences(spark: SparkSession, folder: str, columns: list[str], marks: codec.Marks = codec.STANDARD) -> DataFrame:
    """Elements of sequence text; the id is made of the file and the place of the line in it."""
    lines = spark.read.text(folder).select(F.monotonically_increasing_id().alias("seq_id"), F.col("value").alias("line"))
    return codec.decode_sequence(lines, "line", columns, marks)


def write_sequence_lines(lines: DataFrame, folder: str) -> None:
    """``seq_id <tab> line``: sequence text that keeps its ids; an id holds no tab."""
    lines.select(F.concat_ws("\t", F.col("seq_id").cast("string"), "line").alias("value")).write.mode("overwrite").text(folder)


def read_sequence_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``seq_id, line`` of :func:`write_sequence_lines`; ids come back as text."""
    at = F.instr("value", "\t")
    return spark.read.text(folder).select(F.expr("substring(value, 1, instr(value, '\t') - 1)").alias("seq_id"), F.substr(F.col("value"), at + 1).alias("line"))


def write_vocabulary(vocab: DataFrame, folder: str) -> None:
    """``key <tab> idx`` lines."""
    vocab.select(F.concat_ws("\t", "key", F.col("idx").cast("string")).alias("value")).write.mode("overwrite").text(folder)


def read_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """``key, idx`` of :func:`write_vocabulary`; the number follows the last tab."""
    pattern = "(?s)^(.*)\t([0-9]+)$"
    return spark.read.text(folder).select(F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).cast("long").alias("idx"))


def append_result(result: DataFrame, folder: str, **parameters: object) -> None:
    """Append result rows; the parameters of the run become columns of the rows."""
    named = result.select("*", *[F.lit(str(v)).alias(f"param_{k}") for k, v in parameters.items()])
    named.write.mode("append").parquet(folder)
