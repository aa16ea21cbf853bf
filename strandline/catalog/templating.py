"""Queries on log scanning, masking, template mining and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog import inputs
from strandline.catalog.registry import EVENT_LINES, WINDOWS, Registry
from strandline.functions import text
from strandline.operators import overlaps, segments, templates
from strandline.plans.lookup import lookup_join
from strandline.session import written
from strandline.sources import logs, tables

registry = Registry()
query = registry.query

# The event log as text, written independently in SQL.
EVENT_TEXT = r"""
raw as (
  select event_id + 1 as line_no, event_type, user_id, regexp_extract(props, '"k": ([0-9]+)', 1) as k,
         cast(cast(value as decimal(18, 2)) as varchar) as v, strftime(ts, '%Y-%m-%d %H:%M:%S') as stamp from events),
texts as (
  select line_no, stamp, case when event_type = 'error' then 'ERROR' else 'INFO' end as level, event_type as component,
         case event_type when 'error' then 'request ' || k || ' for user_' || user_id || ' failed with code ' || k
              when 'purchase' then 'user_' || user_id || ' paid ' || v || ' for item ' || k
              when 'view' then 'page /shop/item/' || k || ' viewed by user_' || user_id
              else event_type || ' from user_' || user_id || ' took ' || v || ' ms' end as content from raw),
masked as (
  select line_no, content, component, level,
         regexp_replace(regexp_replace(regexp_replace(content, '(0x)[0-9a-fA-F]+', '<*>', 'g'), '\d+.\d+.\d+.\d+', '<*>', 'g'), '\d+', '<*>', 'g') as message
  from texts)"""


def structured(spark, folder):
    """Structured event log with dense line ids. Lazy: the lines are rendered and parsed in the scan that uses them."""
    made = logs.structure_table(tables.event_text(spark, folder), tables.EVENT_TEXT_FORMAT, "line_no")
    return made.withColumnRenamed("LineId", "line_id")


def masked(spark, folder):
    made = structured(spark, folder)
    return made.withColumn("message", text.mask(F.col("Content"), text.MASKS["supercomputer"]))


@query(
    "scan_header_regex",
    "with " + EVENT_TEXT + r"""
    select row_number() over (order by line_no) as "LineId", split_part(stamp, ' ', 1) as "Date", split_part(stamp, ' ', 2) as "Time",
           component as "Component", content as "Content" from texts where level = 'INFO'""",
)
def scan_header_regex(spark, folder):
    """Only lines of one level match this format; the others are dropped before numbering."""
    lines = tables.event_text(spark, folder)
    return logs.structure_table(lines, "<Date> <Time> INFO <Component>: <Content>", "line_no")


@query(
    "fold_non_ascii",
    """with ln as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
    select doc_id, cast(count(*) as bigint) as lines, cast(sum(length(f)) as bigint) as chars, cast(count(*) filter (f <> line) as bigint) as folded
    from (select doc_id, line, regexp_replace(line, '[^\\x00-\\x7F]+', '<NASCII>', 'g') as f from ln) group by 1""".replace("\\\\", "\\"),
)
def fold_non_ascii(spark, folder):
    lines = tables.document_lines(spark, folder).withColumn("f", text.fold_non_ascii(F.col("line")))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("f")).alias("chars"), F.count(F.when(F.col("f") != F.col("line"), 1)).alias("folded")
    )


@query(
    "head_sample",
    "with " + EVENT_LINES + """ select cast(count(*) as bigint) as lines, round(avg(el_label), 6) as abnormal_rate from event_lines
    where line_id <= 2000""",
)
def head_sample(spark, folder):
    _, rate = logs.head_sample(tables.event_lines(spark, folder), 2000)
    return rate.select("lines", F.round("abnormal_rate", 6).alias("abnormal_rate"))


@query(
    "mask_tokens",
    "with " + EVENT_TEXT + r"""
    select line_no as line_id, message, cast(len(string_split_regex(message, '\s+')) as bigint) as tokens from masked""",
)
def mask_tokens(spark, folder):
    return masked(spark, folder).select("line_id", "message", F.size(text.tokens(F.col("message"))).cast("long").alias("tokens"))


@query(
    "mask_paths_and_ids",
    "with " + EVENT_TEXT + r"""
    select line_no as line_id, regexp_replace(regexp_replace(content, '(user_)[-\d]+', '\1<*>', 'g'), '(/[-\w]+)+', '<*>', 'g') as message from texts""",
)
def mask_paths_and_ids(spark, folder):
    """Look-behind rule for ids and the path rule."""
    rules = [r"(?<=user_)[-\d]+", text.MASKS["block_store"][2]]
    return structured(spark, folder).select("line_id", text.mask(F.col("Content"), rules).alias("message"))


@query(
    "phrase_tokens",
    r"""with ln as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
    ps as (select doc_id, unnest(string_split_regex(line, '[-!"#$%&''()+,./:;=?@\[\\\]^_`{|}~]')) as p from ln)
    select doc_id, cast(count(*) as bigint) as phrases, cast(sum(length(p)) as bigint) as chars from ps where trim(p, ' ') <> '' group by 1""",
)
def phrase_tokens(spark, folder):
    pieces = tables.document_lines(spark, folder).select("doc_id", F.explode(text.phrases(F.col("line"))).alias("p"))
    return pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("phrases"), F.sum(F.length("p")).alias("chars"))


@query(
    "template_counts",
    "with " + EVENT_TEXT + """
    select substr(md5(message), 1, 8) as "EventId", message as "EventTemplate", cast(count(*) as bigint) as "Occurrences" from masked group by 2""",
)
def template_counts(spark, folder):
    made = masked(spark, folder).withColumnRenamed("message", "EventTemplate")
    return templates.template_table(made.withColumn("EventId", text.event_id(F.col("EventTemplate"))))


@query(
    "template_numbers",
    "with " + EVENT_TEXT + """,
    t as (select substr(md5(message), 1, 8) as id, count(*) as n from masked group by message)
    select id as "EventId", row_number() over (order by n desc, id) as number from t""",
)
def template_numbers(spark, folder):
    return templates.numbered_templates(written(template_counts(spark, folder))).select("EventId", "number")


MERGED = EVENT_TEXT + r""",
tk as (select line_no, component, string_split_regex(content, '\s+') as toks from texts),
ps as (select component, len(toks) as n, unnest(toks) as t, unnest(generate_series(1, len(toks))) as p from tk),
ag as (select component, n, p, case when min(t) = max(t) then min(t) else '<*>' end as t from ps group by 1, 2, 3),
tm as (select component, n, string_agg(t, ' ' order by p) as template, list(t order by p) as tt from ag group by 1, 2)"""


def merged_templates(spark, folder):
    """Templates from agreement by position over the raw messages of a component and length. The messages are written, as
    merging and assigning both read them."""
    made = structured(spark, folder).select("line_id", "Component", text.tokens(F.col("Content")).alias("tokens"))
    made = written(made.withColumn("n", F.size("tokens")))
    return made, templates.merge_by_position(made, ["Component", "n"], "tokens")


@query("template_merge", "with " + MERGED + " select component, cast(n as bigint) as n, template from tm")
def template_merge(spark, folder):
    _, found = merged_templates(spark, folder)
    return found.select(F.col("Component").alias("component"), F.col("n").cast("long").alias("n"), F.array_join("template", " ").alias("template"))


@query(
    "template_assign",
    "with " + MERGED + """,
    ut as (select distinct tt, n, template from tm),
    fit as (select k.line_no, ut.template, ut.n, list_sum(list_transform(generate_series(1, ut.n), lambda i: case when tt[i] = '<*>' then 0 when tt[i] = toks[i] then 1 else -1000000 end)) as eq,
                   len(list_filter(tt, lambda x: x = '<*>')) as wild from tk k join ut on ut.n = len(k.toks))
    select line_no as line_id, arg_max(template, eq * 1000 + wild) as template, round(max(eq) / max(n), 6) as similarity from fit where eq >= 0 group by 1""",
)
def template_assign(spark, folder):
    messages, found = merged_templates(spark, folder)
    assigned = templates.assign_known(messages, found, "tokens")
    return assigned.select(
        "line_id", F.array_join("template", " ").alias("template"), F.round(F.col("equal") / F.size("template"), 6).alias("similarity")
    )


@query(
    "params_positional",
    "with " + MERGED + """
    select line_no as line_id, array_to_string(list_filter(list_transform(generate_series(1, tm.n), lambda i: case when tt[i] = '<*>' then toks[i] end), lambda x: x is not null), ',') as parameters
    from tk join tm on tm.component = tk.component and tm.n = len(toks)""",
)
def params_positional(spark, folder):
    messages, found = merged_templates(spark, folder)
    joined = lookup_join(messages, found, ["Component", "n"], "inner", F.col("line_id"))
    return joined.select("line_id", F.array_join(text.positional_parameters(F.col("tokens"), F.col("template")), ",").alias("parameters"))


@query(
    "params_pattern",
    "with " + EVENT_TEXT + r"""
    select line_no as line_id, array_to_string(regexp_extract_all(content, '\d+'), ',') as parameters from texts where component <> 'purchase' and component not in ('click', 'signup')
    union all select line_no, regexp_extract(content, '^user_(.*?) ', 1) || ',' || case when message like '%paid <*> for%' then regexp_extract(content, ' paid (.*?) for ', 1)
        else regexp_replace(regexp_extract(content, ' paid (.*?) for ', 1), '[.]', ',') end || ',' || regexp_extract(content, ' item (.*?)$', 1) from masked where component = 'purchase'
    union all select line_no, regexp_extract(content, ' from user_(.*?) took ', 1) || ',' || case when message like '%took <*> ms' then regexp_extract(content, ' took (.*?) ms', 1)
        else regexp_replace(regexp_extract(content, ' took (.*?) ms', 1), '[.]', ',') end from masked where component in ('click', 'signup')""",
)
def params_pattern(spark, folder):
    """The masked message is the template; its wildcards read as a pattern give the parameters of the raw message."""
    return masked(spark, folder).select(
        "line_id", F.array_join(text.pattern_parameters(F.col("Content"), F.col("message")), ",").alias("parameters")
    )


@query(
    "number_tests",
    "with " + EVENT_TEXT + r""",
    tk as (select unnest(string_split_regex(content, '\s+')) as t from texts), d as (select t, count(*) as n from tk group by 1)
    select cast(sum(n) filter (try_cast(t as double) is not null) as bigint) as numbers,
           cast(sum(n) filter (try_cast(t as double) = floor(try_cast(t as double))) as bigint) as whole,
           cast(sum(n) filter (regexp_matches(t, '[0-9]')) as bigint) as with_digit from d""",
)
def number_tests(spark, folder):
    opened = structured(spark, folder).select(F.explode(text.tokens(F.col("Content"))).alias("t"))
    counted = opened.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    number, whole = text.parse_number(F.col("t"))
    return counted.agg(
        F.sum(F.when(number, F.col("n"))).alias("numbers"), F.sum(F.when(whole, F.col("n"))).alias("whole"),
        F.sum(F.when(text.has_digit(F.col("t")), F.col("n"))).alias("with_digit"),
    )


@query(
    "template_decode",
    "with " + EVENT_TEXT + """ select line_no as line_id, message as "EventTemplate" from masked""",
)
def template_decode(spark, folder):
    """Element ids back to template text through the template dictionary."""
    made = masked(spark, folder).withColumn("EventId", text.event_id(F.col("message")))
    dictionary = written(template_counts(spark, folder))
    elements = made.select("line_id", "EventId", F.col("line_id").alias("pos"))
    return templates.decode_templates(elements, dictionary).select("line_id", "EventTemplate")


@query(
    "raw_decode",
    "with " + WINDOWS + ", " + EVENT_TEXT + " select seq_id, pos, content from wel join texts on texts.line_no = wel.line_id",
)
def raw_decode(spark, folder):
    """Line ids of window elements back to raw content."""
    elements = inputs.windows(spark, folder).elements().select("seq_id", "pos", "line_id")
    contents = structured(spark, folder).select("line_id", F.col("Content").alias("content"))
    return templates.decode_lines(elements, contents).select("seq_id", "pos", "content")


@query(
    "positional_join",
    "with " + EVENT_TEXT + """, l as (select event_id + 1 as line_no, cast(floor(epoch(ts)) as bigint) as epoch, case when event_type = 'error' then 1 else 0 end as label from events)
    select line_no as line_id, epoch, cast(label as int) as label, content from texts join l using (line_no)""",
)
def positional_join(spark, folder):
    """Log content and a parallel table of times and labels, aligned by row number."""
    side = tables.event_lines(spark, folder).select(
        "line_id", "epoch", F.when(F.col("key").startswith("error"), 1).otherwise(0).alias("label")
    )
    contents = structured(spark, folder).select("line_id", F.col("Content").alias("content"))
    return side.join(contents, "line_id").select("line_id", "epoch", "label", "content")


@query(
    "time_parse",
    "with " + EVENT_TEXT + r"""
    select line_no as line_id, cast(floor(epoch(date_trunc('second', ts))) as bigint) as epoch
    from texts join events on event_id + 1 = line_no""",
)
def time_parse(spark, folder):
    """Time texts in the three log formats parse to the same second."""
    made = structured(spark, folder).withColumn("_t", F.regexp_replace("Time", ":", "."))
    first = text.epoch_seconds(F.concat_ws("-", "Date", F.concat("_t", F.lit(".000000"))), "supercomputer")
    second = text.epoch_seconds(F.concat_ws(" ", F.replace("Date", F.lit("-"), F.lit(".")), "Time"), "cluster")
    third = text.epoch_seconds(F.concat_ws(".", "Date", "Time"), "table")
    return made.select("line_id", F.when((first == second) & (second == third), first).alias("epoch"))


# The distinct masked messages are folded in order of their first line; state: clusters with their templates.
FOLD = EVENT_TEXT + r"""
, d as (select string_split_regex(trim(message), '\s+') as t, min(line_no) as first, count(*) as lines from masked group by 1),
o as (select *, row_number() over (order by first) as k from d),
fold as (
  select cast(0 as bigint) as k, cast([] as struct(c bigint, t varchar[])[]) as s, cast(0 as bigint) as hit, cast([] as varchar[]) as t
  union all
  select k, case when hit = k then list_append(s, {'c': k, 't': t})
                 else list_transform(s, lambda x: case when x.c = hit then {'c': x.c, 't': list_transform(list_zip(x.t, t), lambda z: case when z[1] = z[2] then z[1] else '<*>' end)} else x end) end,
         hit, t
  from (select k, s, t, case when best is null or -best.q < 0.3 * len(t) then k else best.c end as hit
        from (select o.k, f.s, o.t,
                     list_sort(list_transform(list_filter(f.s, lambda x: len(x.t) = len(o.t)), lambda x: {
                       'q': -len(list_filter(list_zip(x.t, o.t), lambda z: z[1] = z[2] and z[1] <> '<*>')),
                       'w': -len(list_filter(x.t, lambda w: w = '<*>')), 'c': x.c}))[1] as best
              from fold f join o on o.k = f.k + 1))),
final as (select unnest(s, recursive := true) from fold where k = (select max(k) from fold))"""


@query(
    "template_mine_fixed_depth",
    "with recursive " + FOLD.lstrip() + """
    select left(md5(array_to_string(final.t, ' ')), 8) as "EventId", array_to_string(final.t, ' ') as "EventTemplate", cast(sum(lines) as bigint) as "Occurrences"
    from fold join final on final.c = fold.hit join o on o.k = fold.k group by 1, 2""",
)
def template_mine_fixed_depth(spark, folder):
    lines = structured(spark, folder).select("line_id", "Content")
    mined = templates.mine_fixed_depth(lines, "Content", text.MASKS["supercomputer"], depth=3, similarity=0.3)
    return templates.template_table(mined)


@query("template_mine_fixed_depth_routed")
def template_mine_fixed_depth_routed(spark, folder):
    """Two leading tokens route and only paths are masked, so numbers are left to the miner."""
    lines = structured(spark, folder).select("line_id", "Content")
    mined = templates.mine_fixed_depth(lines, "Content", text.MASKS["block_store"], depth=5, similarity=0.5)
    return templates.template_table(mined)


@query("template_mine_lcs")
def template_mine_lcs(spark, folder):
    lines = structured(spark, folder).select("line_id", "Content")
    mined = templates.mine_common_subsequence(lines, "Content", text.MASKS["supercomputer"], tau=0.55)
    return templates.template_table(mined)


# Families of raw messages that the fast miners must find: two components differ in their first word only.
FAMILIES = EVENT_TEXT + r""",
tk as (select line_no, case when component in ('click', 'signup') then 'from' else component end as family, string_split_regex(content, '\s+') as toks from texts),
ps as (select family, unnest(toks) as t, unnest(generate_series(1, len(toks))) as p from tk),
ag as (select family, p, case when min(t) = max(t) then min(t) else '<*>' end as t from ps group by 1, 2),
tm as (select family, string_agg(t, ' ' order by p) as template from ag group by 1)
select line_no as line_id, template as "EventTemplate", substr(md5(template), 1, 8) as "EventId" from tk join tm using (family)"""


@query("template_mine_segments", "with " + FAMILIES)
def template_mine_segments(spark, folder):
    """Fast mining of the raw messages by the segment join; nothing is masked, so nearly every message is distinct."""
    made = segments.mine_segments(structured(spark, folder), "Content", [], 0.45)
    return made.select("line_id", "EventTemplate", "EventId")


@query("template_mine_subsequences", "with " + FAMILIES)
def template_mine_subsequences(spark, folder):
    """Fast mining of the raw messages by common subsequences."""
    made = overlaps.mine_subsequences(structured(spark, folder), text.tokens(F.col("Content")), 0.5)
    return made.select("line_id", "EventTemplate", "EventId")


@query(
    "overlap_alignments",
    "with " + EVENT_TEXT + r""",
    m as (select distinct content, string_split_regex(content, '\s+') as a from texts),
    l as (select min(content) as leader from texts group by component, length(content)),
    lt as (select distinct leader, string_split_regex(leader, '\s+') as b from l),
    pairs as (select content, leader, a, b from m join lt on len(list_intersect(a, b)) >= greatest(ceil(0.5 * len(a)), 1)),
    lcs as (
      select content, leader, len(b) as size,
             list_reduce(a, lambda row, y: list_reduce(range(1, len(b) + 1), lambda acc, i: list_append(acc, case when b[i] = y then row[i] + 1 else greatest(acc[i], row[i + 1]) end), [0]),
                         list_transform(range(0, len(b) + 1), lambda z: 0))[-1] as length
      from pairs),
    ranked as (select *, count(*) over (partition by content) as leaders, row_number() over (partition by content order by length desc, size, leader) as r from lcs)
    select content as message, cast(leaders as bigint) as leaders, leader, cast(length as int) as length from ranked where r = 1""",
)
def overlap_alignments(spark, folder):
    """Every distinct message with the representatives that share half of its constants, and the longest common subsequence."""
    made = structured(spark, folder).select("Component", F.col("Content").alias("message"))
    split = lambda df: written(df.distinct().withColumn("tokens", text.tokens(F.col("message"))))
    messages = split(made.select("message"))
    leaders = split(made.groupBy("Component", F.length("message")).agg(F.min("message").alias("message")).select("message"))
    found = overlaps.aligned(overlaps.overlapping(messages, leaders))
    sized = found.join(F.broadcast(leaders.select(F.col("message").alias("leader"), F.size("tokens").alias("size"))), "leader")
    best = sized.groupBy("message").agg(
        F.count(F.lit(1)).alias("leaders"), F.min(F.struct((-F.col("length")).alias("less"), "size", "leader")).alias("_b")
    )
    return best.select("message", "leaders", "_b.leader", (-F.col("_b.less")).alias("length"))
