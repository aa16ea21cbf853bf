"""Queries on vocabularies, splits and the instability sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog import inputs
from strandline.catalog.registry import EVENT_LINES, ORDERS, SESSIONS, SPLIT, Registry
from strandline.operators import sequences, sketches, splits, vocabulary
from strandline.plans.running import line_block
from strandline.session import written
from strandline.sources import tables

registry = Registry()
query = registry.query

SWEEP_STEPS = 5

VOCAB = SPLIT + """,
vocab as (
  select key, row_number() over (order by freq desc, key) + 4 as idx, freq
  from (select key, count(*) as freq from el join parts using (seq_id) where part = 'train' group by 1)
  union all select * from (values ('<pad>', 0, 0), ('<unk>', 1, 0), ('<eos>', 2, 0), ('<sos>', 3, 0), ('<mask>', 4, 0)) s(key, idx, freq))"""


def train_vocabulary(spark, folder):
    """Vocabulary of the training sessions; built from the sparse counts."""
    counts = inputs.counts_by_part(spark, folder).filter(F.col("part") == "train")
    return written(vocabulary.build_from_counts(written(counts.groupBy("key").agg(F.sum("cnt").alias("freq")))))


@query("vocab_build", "with " + VOCAB + " select key, cast(idx as bigint) as idx, cast(freq as bigint) as freq from vocab")
def vocab_build(spark, folder):
    return train_vocabulary(spark, folder)


@query(
    "vocab_build_limited",
    "with " + EVENT_LINES + """
    select key, cast(row_number() over (order by freq desc, key) + 4 as bigint) as idx, cast(freq as bigint) as freq
    from (select key, count(*) as freq from event_lines group by 1 having count(*) >= 15)
    qualify idx <= 304
    union all select * from (values ('<pad>', 0, 0), ('<unk>', 1, 0), ('<eos>', 2, 0), ('<sos>', 3, 0), ('<mask>', 4, 0)) s(key, idx, freq)""",
)
def vocab_build_limited(spark, folder):
    return vocabulary.build_vocabulary(tables.event_lines(spark, folder), min_freq=15, max_size=300)


@query(
    "vocab_encode",
    "with " + VOCAB + """
    select e.seq_id, e.pos, coalesce(cast(v.idx as bigint), 1) as idx from el e left join vocab v using (key)""",
)
def vocab_encode(spark, folder):
    encoded = vocabulary.encode(inputs.sessions(spark, folder), train_vocabulary(spark, folder))
    return encoded.select("seq_id", "pos", "idx")


@query(
    "vocab_encode_framed",
    "with " + VOCAB + """,
    enc as (select e.seq_id, e.pos, coalesce(cast(v.idx as bigint), 1) as idx from el e left join vocab v using (key)),
    lens as (select seq_id, count(*) as len from enc group by 1)
    select l.seq_id, cast(l.len + 2 as bigint) as n,
           string_agg(cast(case when i = 0 then 3 when i <= l.len then e.idx when i = l.len + 1 then 2 else 0 end as varchar), ' ' order by i) as ids
    from lens l, (select unnest(generate_series(0, 63)) as i) t
    left join enc e on e.seq_id = l.seq_id and e.pos = i - 1 group by 1, 2""",
)
def vocab_encode_framed(spark, folder):
    encoded = vocabulary.encode(inputs.sessions(spark, folder), train_vocabulary(spark, folder))
    framed = vocabulary.frame_sequences(encoded, 64, with_sos=True, with_eos=True)
    return framed.select("seq_id", "n", F.array_join("ids", " ").alias("ids"))


@query(
    "vocab_decode",
    "with " + VOCAB + """,
    enc as (select e.seq_id, e.pos, coalesce(cast(v.idx as bigint), 1) + case when pos % 50 = 49 then 100000 else 0 end as idx
            from el e left join vocab v using (key))
    select seq_id, pos, coalesce(v.key, '<' || cast(enc.idx as varchar) || '>') as key from enc left join vocab v using (idx)""",
)
def vocab_decode(spark, folder):
    vocab = train_vocabulary(spark, folder)
    encoded = vocabulary.encode(inputs.sessions(spark, folder), vocab).select(
        "seq_id", "pos", (F.col("idx") + F.when(F.col("pos") % 50 == 49, 100000).otherwise(0)).alias("idx")
    )
    return vocabulary.decode(encoded, vocab).select("seq_id", "pos", "key")


@query(
    "vocab_extend",
    "with " + VOCAB + """,
    fresh as (select key, count(*) as freq from el where key not in (select key from vocab) group by 1)
    select key, cast(idx as bigint) as idx, cast(freq as bigint) as freq from vocab union all
    select key, cast(row_number() over (order by freq desc, key) + (select max(idx) from vocab) as bigint), cast(freq as bigint) from fresh""",
)
def vocab_extend(spark, folder):
    lines = tables.event_lines(spark, folder)
    return vocabulary.extend_vocabulary(train_vocabulary(spark, folder), lines)


@query(
    "vocab_first_seen",
    "with " + EVENT_LINES + """
    select key, cast(row_number() over (order by min(line_id), key) + 1 as bigint) as idx from event_lines group by key
    union all select * from (values ('#OOV', 0), ('#Pad', 1)) s(key, idx)""",
)
def vocab_first_seen(spark, folder):
    seen = vocabulary.first_seen_vocabulary(tables.event_lines(spark, folder), "line_id", 2)
    return seen.unionByName(spark.createDataFrame(list(vocabulary.LABEL_SPECIALS.items()), "key string, idx bigint"))


@query(
    "oov_count",
    "with " + VOCAB + """
    select cast(count(*) as bigint) as elements, cast(count(case when v.key is null then 1 end) as bigint) as unknown
    from el e left join vocab v using (key)""",
)
def oov_count(spark, folder):
    return vocabulary.unknown_count(tables.event_lines(spark, folder), train_vocabulary(spark, folder))


@query("split_hash", "with " + SPLIT + " select seq_id, label, part from parts")
def split_hash(spark, folder):
    return inputs.session_parts(spark, folder)


@query(
    "split_holdout",
    "with " + SPLIT + """
    select seq_id, n, case when rn <= floor(tot * 0.1::double) then 'valid' else 'train' end as part
    from (select seq_id, n, count(*) over () as tot, row_number() over (order by md5('1234|' || seq_id), seq_id) as rn
          from seqs join parts using (seq_id) where part = 'train')""",
)
def split_holdout(spark, folder):
    train = inputs.session_parts(spark, folder).filter(F.col("part") == "train").select("seq_id")
    lengths = inputs.session_summary(spark, folder).join(train, "seq_id").select("seq_id", "n")
    return splits.holdout(lengths, 0.1, 1234, "valid", "train")


@query(
    "split_length_order",
    "with " + SESSIONS + """
    select seq_id, n, row_number() over (order by n desc, md5(seq_id), seq_id) as place from seqs""",
)
def split_length_order(spark, folder):
    return splits.by_length(inputs.session_summary(spark, folder).select("seq_id", "n"))


@query(
    "split_class_uniform",
    "with " + SESSIONS + """,
    f as (select seq_id, min(line_id) as first_line from el group by 1)
    select seq_id, label, case when rn <= floor(tot * 0.5::double) then 'train' else 'test' end as part
    from (select seq_id, label, count(*) over (partition by label) as tot,
                 row_number() over (partition by label order by first_line) as rn from seqs join f using (seq_id))""",
)
def split_class_uniform(spark, folder):
    return splits.class_uniform_split(_first_lines(spark, folder), 0.5, "first_line", line_block("first_line")).select(
        "seq_id", "label", "part"
    )


def _first_lines(spark, folder):
    return tables.event_lines(spark, folder).groupBy(F.col("session").alias("seq_id")).agg(
        F.min("line_id").alias("first_line"), F.max("el_label").cast("long").alias("label")
    )


@query(
    "split_sequential",
    "with " + SESSIONS + """,
    f as (select seq_id, min(line_id) as first_line from el group by 1)
    select seq_id, label, case when rn <= floor(tot * 0.5::double) then 'train' else 'test' end as part
    from (select seq_id, label, count(*) over () as tot, row_number() over (order by first_line) as rn
          from seqs join f using (seq_id))""",
)
def split_sequential(spark, folder):
    return splits.sequential_split(_first_lines(spark, folder), 0.5, "first_line", line_block("first_line")).select(
        "seq_id", "label", "part"
    )


@query(
    "split_supervised",
    "with " + SPLIT + """,
    sz as (select least(count(*) filter (part = 'train') // 2, cast(floor(count(*) filter (part = 'test_abnormal') * 0.4::double) as bigint)) as moved from parts),
    ab as (select seq_id, label, part, row_number() over (order by md5('88|' || seq_id), seq_id) as rn from parts where part = 'test_abnormal')
    select seq_id, label, part, case when rn <= moved then 'train' else 'test' end as split from ab, sz
    union all select seq_id, label, part, case when part = 'train' then 'train' else 'test' end from parts
    where part in ('train', 'test_normal')""",
)
def split_supervised(spark, folder):
    return splits.supervised_split(inputs.session_parts(spark, folder), 88)


@query(
    "sample_count",
    "with " + SESSIONS + " select seq_id, n from seqs qualify row_number() over (order by md5('7|' || seq_id), seq_id) <= 100",
)
def sample_count(spark, folder):
    return splits.sample_count(inputs.session_summary(spark, folder).select("seq_id", "n"), 100, 7)


@query(
    "labelled_load",
    "with " + ORDERS + """,
    s as (select seq_id, count(*) as n, case when o_orderstatus = 'F' then 1 else 0 end as label
          from oel join orders on o_orderkey = seq_id group by seq_id, o_orderstatus),
    p as (select seq_id, n, label, count(*) over (partition by label) as tot,
                 row_number() over (partition by label order by seq_id) as rn from s)
    select case when rn <= floor(tot * 0.5::double) then 'train' else 'test' end as part, cast(label as bigint) as label,
           cast(count(*) as bigint) as sessions, cast(sum(n) as bigint) as elements,
           cast(sum(greatest(n - 3, 0) + 1) as bigint) as windows
    from p group by 1, 2""",
)
def labelled_load(spark, folder):
    """Sessions, labels, class-uniform split and window slicing in one go."""
    elements = inputs.orders(spark, folder).select("seq_id", "pos", "key")
    labels = tables.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("seq_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("long").alias("label")
    )
    summary = elements.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")).join(labels, "seq_id")
    parts = splits.class_uniform_split(summary, 0.5, "seq_id", line_block("seq_id"))
    windows = sequences.next_event_windows(elements, 3, F.lit(sequences.PAD_TEXT)).groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("windows")
    )
    return parts.join(windows, "seq_id").groupBy("part", "label").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("elements"), F.sum("windows").alias("windows")
    )


STATS_SQL = """
    vk as (select {by} key, max(case when part = 'train' then 1 else 0 end) as tr, max(case when part = 'test_normal' then 1 else 0 end) as tn,
                  max(case when part = 'test_abnormal' then 1 else 0 end) as ta from {src} where part <> 'valid_abnormal' group by {by} key),
    v as (select {by} 1 - sum(tr * tn) / sum(tn) as a, 1 - sum(tr * ta) / sum(ta) as b,
                 1 - sum(tr * greatest(tn, ta)) / sum(greatest(tn, ta)) as c, sum(tr) as d, sum(tn) as e, sum(ta) as f, count(*) as g
          from vk {group}),
    ps as (select {by} seq_id, part, sum(cnt) as n, max(1 - tr) as un from {src} join vk using ({by} key)
           where part <> 'valid_abnormal' group by {by} seq_id, part),
    q as (select {by} count(*) filter (part = 'train') as h, count(*) filter (part = 'test_normal') as i, count(*) filter (part = 'test_abnormal') as j,
                 count(*) filter (part = 'test_normal' and un = 1) as k, count(*) filter (part = 'test_abnormal' and un = 1) as l, avg(n) as m
          from ps {group})
    select {cast} round(a, 6) as ratio_unseen_normal, round(b, 6) as ratio_unseen_abnormal, round(c, 6) as ratio_unseen_total,
           cast(h as bigint) as train_size, cast(i as bigint) as test_normal_size, cast(j as bigint) as test_abnormal_size,
           cast(d as bigint) as train_vocab, cast(e as bigint) as test_normal_vocab, cast(f as bigint) as test_abnormal_vocab,
           cast(g as bigint) as total_vocab, round(k / i, 6) as ratio_unseen_normal_sequences,
           round(l / j, 6) as ratio_unseen_abnormal_sequences, round((k + l) / (i + j), 6) as ratio_unseen_total_sequences,
           round(m, 6) as mean_seq_length
    from v {join} q {using}"""


def _rounded(stats):
    return stats.select(*[
        F.round(c, 6).alias(c) if c.startswith("ratio") or c.startswith("mean") else F.col(c) for c in stats.columns
    ])


@query(
    "unseen_stats",
    "with " + SPLIT + "," + STATS_SQL.format(by="", src="cnts", group="", cast="", join=",", using=""),
)
def unseen_stats(spark, folder):
    return _rounded(splits.unseen_statistics(inputs.counts_by_part(spark, folder)))


SWEEP = SPLIT + f""",
pool as (select seq_id, part from parts where part in ('train', 'test_normal')),
tk as (select c.key, count(*) as df from cnts c join pool using (seq_id) where c.key in (select key from known) group by 1),
kr as (select key, row_number() over (order by df, key) as kr from tk),
mk as (select c.seq_id, c.part, min(kr) as first_key from cnts c join pool using (seq_id) join kr using (key) group by 1, 2),
ro as (select seq_id, row_number() over (order by first_key, case when part = 'train' then 0 else 1 end, md5(seq_id), seq_id) as leaves_at from mk),
sz as (select count(*) filter (part = 'train') as tr, count(*) filter (part = 'test_normal') as su from pool),
st as (select unnest(generate_series(1, {SWEEP_STEPS})) as step),
stp as (select step, p.seq_id, tr, coalesce(leaves_at <= ceil(step * su / {SWEEP_STEPS}.0), false) as gone
        from st, sz, pool p left join ro using (seq_id)),
rk as (select step, seq_id, tr, gone, row_number() over (partition by step, gone order by md5('42|' || seq_id), seq_id) as rn from stp),
sweep as (
  select cast(step as int) as step, seq_id, case when gone or rn > tr then 'test_normal' else 'train' end as part from rk
  union all select 0, seq_id, part from pool
  union all select cast(s as int), seq_id, part from parts, (select unnest(generate_series(0, {SWEEP_STEPS})) as s) where part = 'test_abnormal')"""


def sweep_parts(spark, folder):
    counts, parts = inputs.split_counts(spark, folder)
    return counts, splits.instability_sweep(parts, counts.join(parts, "seq_id"), SWEEP_STEPS)


@query("instability_sweep", "with " + SWEEP + " select step, seq_id, part from sweep")
def instability_sweep(spark, folder):
    return sweep_parts(spark, folder)[1]


@query(
    "instability_sweep_stats",
    "with " + SWEEP + ", sc as (select s.step, c.seq_id, c.key, c.cnt, s.part from sweep s join cnts c using (seq_id)),"
    + STATS_SQL.format(by="step,", src="sc", group="group by step", cast="cast(step as int) as step,", join="join", using="using (step)"),
)
def instability_sweep_stats(spark, folder):
    counts, stepped = sweep_parts(spark, folder)
    return _rounded(splits.unseen_statistics(written(counts.join(written(stepped), "seq_id")), ("step",)))


@query(
    "covering_prefix",
    "with " + SESSIONS + """,
    f as (select seq_id, min(line_id) as first_line from el group by 1),
    k as (select key, min(first_line) as first_line from el join f using (seq_id) group by 1),
    n as (select f.seq_id, f.first_line, count(k.key) as fresh from f left join k using (first_line) group by 1, 2)
    select seq_id, first_line from (select *, sum(fresh) over (order by first_line) - fresh as before from n) where before < 400""",
)
def covering_prefix(spark, folder):
    firsts = _first_lines(spark, folder).select("seq_id", "first_line")
    placed = inputs.session_counts(spark, folder).join(firsts, "seq_id")
    return splits.covering_prefix(placed, 400, "first_line", line_block("first_line"))


@query(
    "vocabulary_overlap",
    "with " + SPLIT + """,
    b as (select distinct key from cnts where part in ('test_normal', 'test_abnormal'))
    select 'both' as side, key from known where key in (select key from b)
    union all select 'train_only', key from known where key not in (select key from b)
    union all select 'test_only', key from b where key not in (select key from known)""",
)
def vocabulary_overlap(spark, folder):
    counts = inputs.counts_by_part(spark, folder)
    return splits.vocabulary_overlap(counts)




@query(
    "instability_sweep_sketched",
    "with " + SWEEP + """, sc as (select s.step, c.key, s.part from sweep s join cnts c using (seq_id)),
    vk as (select step, key, max(case when part = 'train' then 1 else 0 end) as tr, max(case when part = 'test_normal' then 1 else 0 end) as tn,
                  max(case when part = 'test_abnormal' then 1 else 0 end) as ta from sc group by step, key)
    select step, cast(sum(tr) as bigint) as train_vocab, cast(sum(tn) as bigint) as test_normal_vocab, cast(sum(ta) as bigint) as test_abnormal_vocab, cast(count(*) as bigint) as total_vocab,
           round(1 - sum(tr * tn) / sum(tn), 6) as ratio_unseen_normal, round(1 - sum(tr * ta) / sum(ta), 6) as ratio_unseen_abnormal,
           round(1 - sum(tr * greatest(tn, ta)) / sum(greatest(tn, ta)), 6) as ratio_unseen_total
    from vk group by step""",
)
def instability_sweep_sketched(spark, folder):
    """Key statistics of all steps of the sweep from set sketches, in one aggregation; exact up to 16 384 keys a part."""
    counts, stepped = sweep_parts(spark, folder)
    pairs = counts.select("seq_id", "key").join(written(stepped), "seq_id")
    return _rounded(sketches.unseen_key_statistics(pairs, ["step"]))


@query(
    "daily_value_quantiles",
    """with d as (select strftime(ts, '%Y-%m-%d') as day, value from events)
    select day, share, cast(count(*) as bigint) as n, true as within from d, (values (0.5::double), (0.95::double), (0.99::double)) q(share) group by 1, 2
    union all select 'all' as day, share, cast(count(*) as bigint), true from d, (values (0.5::double), (0.95::double), (0.99::double)) q(share) group by 2""",
)
def daily_value_quantiles(spark, folder):
    """Quantiles of each day and of all days from merged sketches; ``within``: the value's true rank is inside the stated error."""
    values = tables.table(spark, folder, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    daily = written(sketches.quantile_sketches(values, "value", ["day"]))
    whole = sketches.merged(daily).select(F.lit("all").alias("day"), "sketch")
    found = written(sketches.quantiles(daily.select("day", "sketch").unionByName(whole), [0.5, 0.95, 0.99]))
    both = values.unionByName(values.withColumn("day", F.lit("all")))
    ranked = both.join(F.broadcast(found.select("day", "share", F.col("value").alias("estimate"))), "day").groupBy("day", "share").agg(
        F.count(F.when(F.col("value") < F.col("estimate"), 1)).alias("below"), F.count(F.when(F.col("value") <= F.col("estimate"), 1)).alias("upto"), F.count("value").alias("n")
    )
    # The ranks of equal values are a range; one row is the least step.
    error = F.lit(sketches.rank_error(1024)) * F.col("n") + 1
    at = F.col("share") * F.col("n")
    return ranked.select("day", "share", "n", ((F.col("below") <= at + error) & (F.col("upto") >= at - error)).alias("within"))
