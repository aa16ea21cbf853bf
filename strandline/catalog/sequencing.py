"""Queries on sequencing: sessions, windows, chunks, contexts, codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog import inputs
from strandline.catalog.registry import EVENT_LINES, ORDERS, SESSIONS, STEP_SECONDS, WINDOW_SECONDS, WINDOWS, Registry
from strandline.functions import codec, text
from strandline.operators import sequences
from strandline.plans.neighbours import over_neighbours
from strandline.sources import tables

registry = Registry()
query = registry.query


@query("session_by_id", "with " + SESSIONS + " select seq_id, pos, line_id, key from el")
def session_by_id(spark, folder):
    return inputs.sessions(spark, folder).select("seq_id", "pos", "line_id", "key")


@query(
    "session_by_pattern",
    r"""
    with lines as (
      select doc_id * 100000 + ln as line_id, doc_id, x as content
      from (select doc_id, unnest(string_split(text, chr(10))) as x,
                   unnest(generate_series(1, len(string_split(text, chr(10))))) as ln from documents)),
    named as (select distinct line_id, unnest(regexp_extract_all(content, '([A-Z][a-z]{1,3})[ .,]', 1)) as seq_id from lines)
    select seq_id, line_id, row_number() over (partition by seq_id order by line_id) - 1 as pos from named""",
)
def session_by_pattern(spark, folder):
    lines = tables.document_lines(spark, folder).withColumn("line_id", F.col("doc_id") * 100000 + F.col("pos") + 1)
    named = sequences.sessions_by_pattern(lines.select("line_id", "line"), "line", r"([A-Z][a-z]{1,3})[ .,]")
    return named.select("seq_id", "line_id", "pos")


@query(
    "session_label_left",
    """with ln as (select doc_id, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) from documents) group by 1)
    select ln.doc_id as seq_id, n, cast(toxic as bigint) as label from ln left join labels using (doc_id)""",
)
def session_label_left(spark, folder):
    lengths = tables.document_lines(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    labels = tables.table(spark, folder, "labels").select("doc_id", F.col("toxic").cast("long").alias("label"))
    return lengths.join(labels, "doc_id", "left").withColumnRenamed("doc_id", "seq_id")


@query(
    "session_label_strict",
    """with ln as (select doc_id, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) from documents) group by 1)
    select cast(count(*) as bigint) as sessions, cast(count(toxic) as bigint) as labelled,
           cast(count(*) - count(toxic) as bigint) as unknown,
           cast(sum(case when toxic = 1 then 1 else 0 end) as bigint) as anomalies
    from ln left join labels using (doc_id)""",
)
def session_label_strict(spark, folder):
    joined = session_label_left(spark, folder)
    return joined.agg(
        F.count(F.lit(1)).alias("sessions"), F.count("label").alias("labelled"),
        (F.count(F.lit(1)) - F.count("label")).alias("unknown"),
        F.count(F.when(F.col("label") == 1, 1)).alias("anomalies"),
    )


@query("window_sliding", "with " + WINDOWS + " select seq_id, first_line, last_line, n, label from windows where n >= 10")
def window_sliding(spark, folder):
    return inputs.windows(spark, folder).windows()


@query(
    "window_sliding_elements",
    "with " + WINDOWS + " select seq_id, pos, line_id, key, cast(el_label as int) as el_label, label from wel",
)
def window_sliding_elements(spark, folder):
    return inputs.windows(spark, folder).elements().select("seq_id", "pos", "line_id", "key", "el_label", "label")


@query(
    "window_summary",
    "with " + WINDOWS + """ select cast(count(*) as bigint) as windows_all, round(avg(n), 6) as mean_all,
    cast(count(case when n >= 10 then 1 end) as bigint) as windows_kept, round(avg(case when n >= 10 then n end), 6) as mean_kept,
    round(avg(case when n >= 10 then least(n, 512) end), 6) as mean_cut from windows""",
)
def window_summary(spark, folder):
    kept = F.col("n") >= sequences.MIN_LEN
    return inputs.windows(spark, folder).all_windows().agg(
        F.count(F.lit(1)).alias("windows_all"), F.round(F.avg("n"), 6).alias("mean_all"),
        F.count(F.when(kept, 1)).alias("windows_kept"), F.round(F.avg(F.when(kept, F.col("n"))), 6).alias("mean_kept"),
        F.round(F.avg(F.when(kept, F.least("n", F.lit(sequences.MAX_LEN)))), 6).alias("mean_cut"),
    )


@query(
    "window_hour_counts",
    "with " + EVENT_LINES + f""",
    clocked as (select *, max(epoch) over (order by line_id) as r from event_lines),
    b as (select min(r) as t0, max(r) as tm from clocked),
    e as (select t0, tm, max(r) - t0 as reach from clocked, b where r < t0 + {WINDOW_SECONDS} group by t0, tm),
    ks as (select unnest(generate_series(0, case when tm - t0 < {WINDOW_SECONDS} then 0 else
             cast(floor((tm - t0 - reach) / {STEP_SECONDS}.0) + 1 as bigint) end)) as k, t0, reach from e)
    select k as seq_id, cast(count(line_id) as bigint) as n, cast(coalesce(max(el_label), 0) as bigint) as label,
           cast(count(distinct key) as bigint) as keys, min(line_id) as first_line, max(line_id) as last_line
    from ks left join clocked on r >= t0 + k * {STEP_SECONDS}
      and r < t0 + k * {STEP_SECONDS} + case when k = 0 then {WINDOW_SECONDS} else reach end
    group by k""",
)
def window_hour_counts(spark, folder):
    windows = inputs.windows(
        spark, folder, stop="last_event", distinct=False, keep_empty=True, min_len=0, max_len=1 << 40
    )
    counts = windows.key_counts()
    keys = counts.groupBy("seq_id").agg(F.count(F.lit(1)).alias("keys"))
    return windows.all_windows().join(keys, "seq_id", "left").select(
        "seq_id", "n", "label", F.coalesce("keys", F.lit(0).cast("long")).alias("keys"), "first_line", "last_line"
    )


@query(
    "window_tumbling",
    "with " + EVENT_LINES + """,
    t as (select *, epoch // 3600 * 3600 as start from event_lines),
    spine as (select unnest(generate_series((select min(start) from t), (select max(start) from t), 3600)) as start)
    select spine.start as start, cast(count(line_id) as bigint) as n, cast(max(el_label) as bigint) as label
    from spine left join t on t.start = spine.start group by 1""",
)
def window_tumbling(spark, folder):
    return sequences.tumbling_windows(tables.event_lines(spark, folder), 3600)


@query(
    "window_tumbling_elements",
    "with " + EVENT_LINES + """
    select epoch // 3600 * 3600 as start, key, line_id,
           row_number() over (partition by epoch // 3600 order by line_id) - 1 as pos from event_lines""",
)
def window_tumbling_elements(spark, folder):
    return sequences.tumbling_elements(tables.event_lines(spark, folder), 3600).select("start", "key", "line_id", "pos")


@query(
    "chunk_fixed",
    "with " + ORDERS + """
    select seq_id, pos // 3 as chunk, string_agg(key, ' ' order by pos) as keys, cast(count(*) as bigint) as n
    from oel where pos < 8 group by 1, 2""",
)
def chunk_fixed(spark, folder):
    made = sequences.chunks(inputs.orders(spark, folder), 3, ["key"], seq_len=8)
    return made.select("seq_id", "chunk", F.array_join("key", " ").alias("keys"), F.size("key").cast("long").alias("n"))


@query(
    "chunk_adaptive",
    "with " + ORDERS + """
    select seq_id, string_agg(key, ' ' order by pos) as keys, cast(count(*) as bigint) as n
    from oel where pos < 8 and seq_id in (select seq_id from oel group by 1 having count(*) >= 3) group by 1""",
)
def chunk_adaptive(spark, folder):
    kept = sequences.at_least(inputs.orders(spark, folder), 3)
    made = sequences.to_arrays(kept, ["key"], 8)
    return made.select("seq_id", F.array_join("key", " ").alias("keys"), F.size("key").cast("long").alias("n"))


NEXT_SQL = """,
    lens as (select seq_id, count(*) as n from oel group by 1),
    starts as (select seq_id, n, unnest(generate_series(0, greatest(n - 3, 0))) as start from lens)
    select s.seq_id, s.start,
           string_agg(coalesce(o.key, '{pad}'), ' ' order by i) as context,
           any_value(coalesce(x.key, '{pad}')) as next_key
    from starts s, (values (0), (1), (2)) as t(i)
    left join oel o on o.seq_id = s.seq_id and o.pos = s.start + i
    left join oel x on x.seq_id = s.seq_id and x.pos = s.start + 3
    group by 1, 2"""


@query("next_event_windows", "with " + ORDERS + NEXT_SQL.format(pad="<pad>"))
def next_event_windows(spark, folder):
    made = sequences.next_event_windows(inputs.orders(spark, folder), 3, F.lit("<pad>"))
    return made.select("seq_id", "start", F.array_join("context", " ").alias("context"), "next_key")


@query("next_event_tail", "with " + ORDERS + NEXT_SQL.format(pad="#Pad"))
def next_event_tail(spark, folder):
    made = sequences.next_event_windows(inputs.orders(spark, folder), 3, F.lit(sequences.PAD_TEXT))
    return made.select("seq_id", "start", F.array_join("context", " ").alias("context"), "next_key")


@query(
    "seq_encode",
    "with " + WINDOWS + """
    select seq_id, string_agg(key || '!;!' || cast(el_label as varchar) || '!|!', '' order by pos) as line
    from wel group by 1""",
)
def seq_encode(spark, folder):
    # The windows themselves are cut to their documented max_len.
    arrays = sequences.to_arrays(inputs.windows(spark, folder).elements(), ["key", "el_label"], sequences.MAX_LEN)
    return arrays.select("seq_id", codec.encode_sequence(["key", "el_label"]).alias("line"))


@query(
    "seq_decode",
    "with " + WINDOWS + " select seq_id, pos, key, cast(el_label as varchar) as el_label from wel",
)
def seq_decode(spark, folder):
    lines = seq_encode(spark, folder)
    return codec.decode_sequence(lines, "line", ["key", "el_label"])


@query(
    "seq_encode_legacy",
    "with " + ORDERS + """
    select seq_id, string_agg(key || ',' || cast(pos as varchar) || ' ', '' order by pos) as line from oel group by 1""",
)
def seq_encode_legacy(spark, folder):
    ordered = inputs.orders(spark, folder).withColumn("at", F.col("pos"))
    return codec.encode_elements(ordered, ["key", "at"], codec.LEGACY)


@query("seq_lengths", "with " + SESSIONS + " select label, n, cast(count(*) as bigint) as sequences from seqs group by 1, 2")
def seq_lengths(spark, folder):
    return sequences.length_distribution(inputs.session_summary(spark, folder))


@query(
    "delta_t",
    "with " + EVENT_LINES + """
    select line_id, cast(coalesce(epoch - lag(epoch) over (order by line_id), 0) as double) as delta_t from event_lines""",
)
def delta_t(spark, folder):
    return sequences.with_delta(tables.event_lines(spark, folder)).select("line_id", "delta_t")


@query(
    "delta_t_in_windows",
    "with " + WINDOWS + """,
    d as (select line_id, coalesce(epoch - lag(epoch) over (order by line_id), 0) as dt from event_lines)
    select seq_id, cast(sum(case when pos = 0 then 0 else dt end) as double) as seconds
    from wel join d using (line_id) group by 1""",
)
def delta_t_in_windows(spark, folder):
    lines = sequences.with_delta(tables.event_lines(spark, folder))
    windows = sequences.TimeWindows(lines, WINDOW_SECONDS, STEP_SECONDS)
    return sequences.zero_first_delta(windows.elements()).groupBy("seq_id").agg(F.sum("delta_t").alias("seconds"))


@query(
    "truncate_or_pad",
    "with " + ORDERS + """,
    lens as (select seq_id from oel group by 1)
    select l.seq_id, string_agg(coalesce(o.key, '0'), ' ' order by i) as keys
    from lens l, (select unnest(generate_series(0, 4)) as i) t left join oel o on o.seq_id = l.seq_id and o.pos = i group by 1""",
)
def truncate_or_pad(spark, folder):
    arrays = sequences.to_arrays(inputs.orders(spark, folder), ["key"], 5)
    return arrays.select(
        "seq_id", F.array_join(sequences.truncate_or_pad(F.col("key"), 5, F.lit("0")), " ").alias("keys")
    )


@query(
    "room_for_start",
    "with " + ORDERS + """,
    c as (select * from oel where pos < 6), l as (select seq_id, count(*) as n from c group by 1)
    select seq_id, cast(count(*) as bigint) as n, max_by(key, pos) as last_key from c join l using (seq_id)
    where not (l.n = 6 and pos = 5) group by 1""",
)
def room_for_start(spark, folder):
    kept = sequences.leave_room_for_start(sequences.cut(inputs.orders(spark, folder), 6), 6)
    return kept.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("key", "pos").alias("last_key"))


@query(
    "line_label_counts",
    "with " + EVENT_LINES + " select cast(el_label as int) as el_label, cast(count(*) as bigint) as lines from event_lines group by 1",
)
def line_label_counts(spark, folder):
    return tables.event_lines(spark, folder).groupBy("el_label").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "contains_key",
    "with " + SESSIONS + """
    select key, cast(count(distinct seq_id) as bigint) as sequences, cast(count(*) as bigint) as elements from el group by 1""",
)
def contains_key(spark, folder):
    return inputs.session_counts(spark, folder).groupBy("key").agg(
        F.count(F.lit(1)).alias("sequences"), F.sum("cnt").alias("elements")
    )


@query("seq_decode_legacy", "with " + ORDERS + " select seq_id, pos, key, cast(pos as varchar) as at from oel")
def seq_decode_legacy(spark, folder):
    """The space-separated text form read back."""
    return codec.decode_sequence(seq_encode_legacy(spark, folder), "line", ["key", "at"], codec.LEGACY)


@query("dash_labels", "select event_id + 1 as line_id, case when event_type = 'error' then 1 else 0 end as label from events")
def dash_labels(spark, folder):
    """Labels of the form that marks normal lines with a dash and others with the name of the alert."""
    mark = F.when(F.col("event_type") == "error", F.upper("event_type")).otherwise("-")
    return tables.table(spark, folder, "events").select((F.col("event_id") + 1).alias("line_id"), text.binary_label(mark).alias("label"))


@query(
    "session_label_required",
    """with ln as (select doc_id, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) from documents) group by 1)
    select doc_id as seq_id, cast(n as bigint) as n, cast(toxic as bigint) as label from ln join labels using (doc_id) where toxic is not null""",
)
def session_label_required(spark, folder):
    """Documents that the labels name, joined so that a missing label would be an error."""
    labels = tables.table(spark, folder, "labels").where("toxic is not null").select(F.col("doc_id").alias("seq_id"), F.col("toxic").cast("long").alias("label"))
    lengths = tables.document_lines(spark, folder).groupBy(F.col("doc_id").alias("seq_id")).agg(F.count(F.lit(1)).alias("n"))
    return sequences.labelled_strictly(lengths.join(labels.select("seq_id"), "seq_id", "left_semi"), labels)


@query(
    "arrays_round_trip",
    "with " + ORDERS + " select seq_id, pos, key, epoch from oel where pos < 5",
)
def arrays_round_trip(spark, folder):
    """Elements to arrays of at most five entries and back."""
    arrays = sequences.to_arrays(inputs.orders(spark, folder), ["key", "epoch"], 5)
    return sequences.to_elements(arrays, ["key", "epoch"])


@query(
    "training_windows",
    "with " + ORDERS + """,
    d as (select *, coalesce(epoch - lag(epoch) over (partition by seq_id order by pos), 0) as dt from oel),
    lens as (select seq_id, count(*) as n from oel group by 1),
    starts as (select seq_id, unnest(generate_series(0, greatest(n - 3, 0))) as start from lens),
    w as (select s.seq_id, s.start, i, coalesce(d.key, '#Pad') as key, coalesce(d.dt, 0) as dt
          from starts s cross join (values (0), (1), (2), (3)) t(i) left join d on d.seq_id = s.seq_id and d.pos = s.start + i)
    select seq_id, start, string_agg(key, ' ' order by i) filter (i < 3) as context, string_agg(cast(dt as varchar), ' ' order by i) filter (i < 3) as durations,
           max(key) filter (i = 3) as next_key, cast(count(distinct key) filter (i < 3) as bigint) as kinds
    from w group by 1, 2""",
)
def training_windows(spark, folder):
    """Windows of three keys with the seconds since the key before, the number of distinct keys, and the key that follows."""
    ordered = inputs.orders(spark, folder)
    spaced = over_neighbours(ordered, ["seq_id"], "pos", 1, 0, {"_before": lambda w: F.lag("epoch").over(w)})
    spaced = spaced.withColumn("dt", F.coalesce(F.col("epoch") - F.col("_before"), F.lit(0)).cast("long")).drop("_before")
    made = sequences.training_windows(spaced, 3, F.lit(sequences.PAD_TEXT), "dt", F.lit(0).cast("long"))
    return made.select(
        "seq_id", "start", F.array_join("context", " ").alias("context"), F.array_join("values", " ").alias("durations"), "next_key",
        F.size(F.array_distinct("context")).cast("long").alias("kinds"),
    )
