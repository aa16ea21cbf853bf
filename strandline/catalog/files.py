"""Queries that write files below ``spark.checkpoint.dir`` and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.catalog import inputs
from strandline.catalog.registry import EVENT_LINES, SESSIONS, Registry
from strandline.catalog.splitting import VOCAB, train_vocabulary
from strandline.catalog.templating import EVENT_TEXT
from strandline.functions import codec, text
from strandline.operators import templates
from strandline.session import ensure_checkpoint_dir
from strandline.sources import logs, tables
from strandline.sources.sessions import SessionTable

registry = Registry()
query = registry.query


def place(spark, name: str) -> str:
    """A new folder for files of a query."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scanned(spark, folder):
    """The event log written as text files in line order and scanned from them."""
    path = place(spark, "log")
    tables.event_text(spark, folder).orderBy("line_no").select("line").write.text(path)
    return logs.scan_log(spark, path, tables.EVENT_TEXT_FORMAT)


@query(
    "scan_text_log",
    "with " + EVENT_TEXT + r"""
    select line_no as "LineId", split_part(stamp, ' ', 1) as "Date", split_part(stamp, ' ', 2) as "Time", level as "Level",
           component as "Component", content as "Content" from texts""",
)
def scan_text_log(spark, folder):
    return scanned(spark, folder)


def written_csv(spark, folder):
    """Structured log and templates as csv; returns the folder."""
    made = scanned(spark, folder)
    message = text.mask(F.col("Content"), text.MASKS["supercomputer"])
    named = made.select("LineId", "Component", "Content", message.alias("EventTemplate")).withColumn("EventId", text.event_id(F.col("EventTemplate")))
    path = place(spark, "csv")
    logs.write_structured(named, templates.template_table(named), path, "csv")
    return path


@query(
    "structured_csv_round_trip",
    "with " + EVENT_TEXT + """ select line_no as "LineId", component as "Component", content as "Content", message as "EventTemplate" from masked""",
)
def structured_csv_round_trip(spark, folder):
    path = f"{written_csv(spark, folder)}/structured"
    schema = "LineId bigint, Component string, Content string, EventTemplate string, EventId string"
    return logs.read_structured_csv(spark, path, schema).drop("EventId")


@query(
    "template_csv_round_trip",
    "with " + EVENT_TEXT + """ select message as "EventTemplate", cast(count(*) as bigint) as "Occurrences" from masked group by 1""",
)
def template_csv_round_trip(spark, folder):
    path = f"{written_csv(spark, folder)}/templates"
    return logs.read_structured_csv(spark, path, "EventId string, EventTemplate string, Occurrences bigint").drop("EventId")


@query("sequence_text_round_trip", "with " + SESSIONS + " select seq_id, pos, key, cast(el_label as varchar) as el_label from el")
def sequence_text_round_trip(spark, folder):
    """Whole sessions as lines of text, ids kept."""
    path = place(spark, "sequences")
    logs.write_sequence_lines(codec.encode_elements(inputs.sessions(spark, folder), ["key", "el_label"]), path)
    return codec.decode_sequence(logs.read_sequence_lines(spark, path), "line", ["key", "el_label"])


@query(
    "session_table_round_trip",
    "with " + SESSIONS + """
    select seq_id, cast(max(el_label) as int) as label, cast(count(*) as bigint) as n, string_agg(key, ' ' order by pos) as keys from el group by 1""",
)
def session_table_round_trip(spark, folder):
    """Sessions as a csv table with their keys as a JSON list."""
    elements = inputs.sessions(spark, folder)
    # A table row holds a whole session by its format.
    packed = elements.groupBy("seq_id").agg(F.max("el_label").alias("label"), F.array_sort(F.collect_list(F.struct("pos", "key")))["key"].alias("keys"))
    path = place(spark, "sessions")
    packed.withColumn("keys", F.to_json("keys")).write.csv(path, header=True, escape="~")
    back = logs.read_structured_csv(spark, path, "seq_id string, label int, keys string")
    keys = F.from_json("keys", "array<string>")
    return back.select("seq_id", "label", F.size(keys).cast("long").alias("n"), F.array_join(keys, " ").alias("keys"))


def session_buckets(spark, folder):
    return SessionTable.write(inputs.sessions(spark, folder), ["line_id", "key", "el_label"], buckets=8)


@query("session_buckets_elements", "with " + SESSIONS + " select seq_id, pos, line_id, key, el_label from el")
def session_buckets_elements(spark, folder):
    """Elements read back from the bucketed table."""
    return session_buckets(spark, folder).elements()


@query(
    "session_buckets_summary",
    "with " + SESSIONS + " select seq_id, cast(count(*) as bigint) as n, cast(max(el_label) as int) as label, max(line_id) - min(line_id) as reach from el group by 1",
)
def session_buckets_summary(spark, folder):
    """Summaries by session from the buckets, without an exchange."""
    table = session_buckets(spark, folder)
    return table.by_session(F.count(F.lit(1)).alias("n"), F.max("el_label").alias("label"), (F.max("line_id") - F.min("line_id")).alias("reach"))


@query(
    "session_buckets_unseen",
    "with " + VOCAB + """, trained as (select key from vocab where freq > 0)
    select seq_id, round(count(*) filter (key not in (select key from trained)) / count(*), 6) as score from el group by 1""",
)
def session_buckets_unseen(spark, folder):
    """Share of each session's elements that the training vocabulary does not know, from the buckets."""
    scored = session_buckets(spark, folder).shares(train_vocabulary(spark, folder).where("freq > 0").select("key"))
    return scored.select("seq_id", F.round("score", 6).alias("score"))


@query("vocabulary_text", "with " + VOCAB + " select key, cast(idx as bigint) as idx from vocab")
def vocabulary_text(spark, folder):
    path = place(spark, "vocabulary")
    logs.write_vocabulary(train_vocabulary(spark, folder), path)
    return logs.read_vocabulary(spark, path)


@query(
    "append_results",
    "with " + EVENT_LINES + """,
    r as (select cast(el_label as int) as el_label, cast(count(*) as bigint) as lines from event_lines group by 1)
    select el_label, lines, ratio as param_ratio, 'events' as param_data from r, (values ('0.1'), ('0.2')) p(ratio)""",
)
def append_results(spark, folder):
    """The results of two runs, appended to one table with their parameters."""
    path = place(spark, "results")
    for ratio in (0.1, 0.2):
        counts = tables.event_lines(spark, folder).groupBy("el_label").agg(F.count(F.lit(1)).alias("lines"))
        logs.append_result(counts, path, ratio=ratio, data="events")
    return spark.read.parquet(path)
