"""Queries on count-based detection and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog import inputs
from strandline.catalog.registry import SPLIT, WINDOWS, Registry
from strandline.catalog.splitting import SWEEP, sweep_parts
from strandline.operators import count_detectors as detect
from strandline.operators import evaluate, sequences, splits
from strandline.plans.lookup import lookup_join
from strandline.session import written

registry = Registry()
query = registry.query

TOP_RANK, TOP_NEXT, NEXT_WIDTH = 15, 9, 3
TESTED = ("test_normal", "test_abnormal")

UNSEEN = SPLIT + """,
unseen as (
  select c.seq_id, c.part, c.label, sum(case when k.key is null then cnt else 0 end) / sum(cnt) as score
  from cnts c left join known k using (key) where part in ('test_normal', 'test_abnormal') group by 1, 2, 3)"""


def unseen_table(spark, folder):
    """Unseen-key score of every test session."""
    counts, parts = inputs.split_counts(spark, folder)
    parted = counts.join(parts, "seq_id")
    known = parted.filter(F.col("part") == "train").select("key").distinct()
    tested = parts.filter(F.col("part").isin(*TESTED))
    scores = detect.unseen_scores(counts.join(tested, "seq_id", "left_semi"), known)
    return written(scores.join(tested, "seq_id"))


@query("unseen_heuristic", "with " + UNSEEN + " select seq_id, part, label, round(score, 6) as score from unseen")
def unseen_heuristic(spark, folder):
    return unseen_table(spark, folder).select("seq_id", "part", "label", F.round("score", 6).alias("score"))


GRID = """,
grid as (select i, i * {step}::double as thr from (select unnest(generate_series(0, {count} - 1)) as i)),
gc as (select {by} i, thr, count(*) filter (label = 1 and score >= thr) as tp, count(*) filter (label = 0 and score >= thr) as fp,
              count(*) filter (label = 0 and score < thr) as tn, count(*) filter (label = 1 and score < thr) as fn
       from {src}, grid group by {by} i, thr),
gm as (select *, case when tp + fp > 0 then 100.0 * tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then 100.0 * tp / (tp + fn) else 0 end as r,
              case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) <> 0
                   then 100 * (tp * tn - fp * fn) / sqrt(cast((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) as double)) else 0 end as mcc from gc),
best as (select {by} arg_max(i, mcc * 1e9 - i) as i from gm group by all)"""

RATED = """round(thr, 6) as thr, cast(tp as bigint) as "TP", cast(tn as bigint) as "TN", cast(fp as bigint) as "FP", cast(fn as bigint) as "FN",
    round(p, 6) as "P", round(r, 6) as "R", round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as "F1", round(mcc, 6) as "MCC" """


def _rounded(df):
    return df.select(*[
        F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if c in {"TP", "FP", "TN", "FN"} else F.col(c)
        for c, t in df.dtypes
    ])


@query("best_mcc", "with " + UNSEEN + GRID.format(step="0.001", count=1000, by="", src="unseen") + f" select {RATED} from gm join best using (i)")
def best_mcc(spark, folder):
    return _rounded(evaluate.best_threshold(unseen_table(spark, folder)))


@query(
    "threshold_grid",
    "with " + UNSEEN + GRID.format(step="0.001", count=1000, by="", src="unseen")
    + ' select i, round(thr, 6) as thr, tp as "TP", fp as "FP", tn as "TN", fn as "FN" from gm',
)
def threshold_grid(spark, folder):
    return _rounded(evaluate.grid_counts(unseen_table(spark, folder), 0.001, 1000))


AREA = """,
pn as (select {by} count(*) filter (label = 1) as np, count(*) filter (label = 0) as nn from {src} group by all),
sc as (select {by} score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from {src} group by all),
cu as (select *, sum(pos) over (partition by {pby} order by score desc) as tp, sum(neg) over (partition by {pby} order by score desc) as fp from sc),
pr as (select *, tp / (tp + fp) as prec, coalesce(lag(tp / (tp + fp)) over (partition by {pby} order by score desc), 1.0) as prev from cu),
ar as (select {by} sum(pos * (prec + prev) / 2) as a from pr group by all),
mw as (select {by} sum(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end * a.pos * b.neg) as u
       from sc a join sc b {using} group by all)"""


@query("auroc", "with " + UNSEEN + AREA.format(by="", pby="1", src="unseen", using="on true") + ' select round(u / (np * nn), 6) as "AUROC" from mw, pn')
def auroc(spark, folder):
    return _rounded(evaluate.areas(unseen_table(spark, folder)).select("AUROC"))


@query("auprc", "with " + UNSEEN + AREA.format(by="", pby="1", src="unseen", using="on true") + ' select round(a / np, 6) as "AUPRC" from ar, pn')
def auprc(spark, folder):
    return _rounded(evaluate.areas(unseen_table(spark, folder)).select("AUPRC"))


@query(
    "result_row",
    "with " + UNSEEN + GRID.format(step="0.001", count=1000, by="", src="unseen") + AREA.format(by="", pby="1", src="unseen", using="on true")
    + f""" select {RATED}, round(u / (pn.np * pn.nn), 6) as "AUROC", round(a / pn.np, 6) as "AUPRC", cast(pn.np + pn.nn as bigint) as samples
    from gm join best using (i), pn, ar, mw""",
)
def result_row(spark, folder):
    return _result(unseen_table(spark, folder))


def _result(scored):
    keyed = scored.withColumn("_all", F.lit(1))
    best = evaluate.best_threshold(keyed, by=["_all"])
    return _rounded(evaluate.result_rows(keyed, best, ["_all"]).drop("_all"))


@query(
    "window_unseen_result",
    "with " + WINDOWS + """,
    wl as (select distinct seq_id, label from wel),
    wp as (select seq_id, label, case when label = 0 then case when rn <= floor(tot * 0.4::double) then 'train' else 'test_normal' end
                  else case when rn <= floor(tot * 0.5::double) then 'test_abnormal' else 'valid_abnormal' end end as part
           from (select seq_id, label, count(*) over (partition by label) as tot,
                        row_number() over (partition by label order by md5(case when label = 0 then '42' else '12' end || '|' || cast(seq_id as varchar)), seq_id) as rn from wl)),
    wk as (select distinct key from wel join wp using (seq_id) where part = 'train'),
    unseen as (select wel.seq_id, wp.label, count(*) filter (wk.key is null) / count(*) as score
               from wel join wp using (seq_id) left join wk using (key) where part in ('test_normal', 'test_abnormal') group by 1, 2)"""
    + GRID.format(step="0.001", count=1000, by="", src="unseen") + AREA.format(by="", pby="1", src="unseen", using="on true")
    + f""" select {RATED}, round(u / (pn.np * pn.nn), 6) as "AUROC", round(a / pn.np, 6) as "AUPRC", cast(pn.np + pn.nn as bigint) as samples
    from gm join best using (i), pn, ar, mw""",
)
def window_unseen_result(spark, folder):
    counts = written(inputs.windows(spark, folder).elements().groupBy("seq_id", "key", "label").agg(F.count(F.lit(1)).alias("cnt")))
    labels = counts.groupBy("seq_id").agg(F.max("label").alias("label"))
    parts = written(splits.normal_split(labels, 0.4, inputs.SPLIT_SEED))
    parted = counts.drop("label").join(parts, "seq_id")
    known = parted.filter(F.col("part") == "train").select("key").distinct()
    tested = parts.filter(F.col("part").isin(*TESTED))
    scores = detect.unseen_scores(counts.join(tested, "seq_id", "left_semi"), known)
    return _result(written(scores.join(tested, "seq_id")))


RANKS = SPLIT + """,
ctx as (select e.*, p.part, p.label, coalesce(lag(key) over w, '<sos>') as l, coalesce(lead(key) over w, '<eos>') as r
        from el e join parts p using (seq_id) window w as (partition by seq_id order by pos)),
t3 as (select l, r, key, count(*) as c3 from ctx where part = 'train' group by all),
t2 as (select l, key, count(*) as c2 from ctx where part = 'train' group by all),
t1 as (select key, count(*) as c1 from ctx where part = 'train' group by all),
lr as (select distinct l, r from ctx where part in ('test_normal', 'test_abnormal')),
cand as (select lr.l, lr.r, t1.key, row_number() over (partition by lr.l, lr.r
           order by coalesce(c3, 0) desc, coalesce(c2, 0) desc, c1 desc, t1.key) - 1 as rank
         from lr cross join t1 left join t2 on t2.l = lr.l and t2.key = t1.key
         left join t3 on t3.l = lr.l and t3.r = lr.r and t3.key = t1.key),
ranked as (select c.seq_id, c.pos, c.key, c.part, c.label, c.el_label, coalesce(cand.rank, (select count(*) from t1)) as rank
           from ctx c left join cand on cand.l = c.l and cand.r = c.r and cand.key = c.key
           where part in ('test_normal', 'test_abnormal'))"""


def ranked_elements(spark, folder):
    """Rank of every test element, each masked on its own."""
    elements = written(inputs.elements_by_part(spark, folder).select("seq_id", "pos", "key", "el_label", "part", "label"))
    model = detect.ContextRankModel(elements.filter(F.col("part") == "train"))
    return model.score(elements.filter(F.col("part").isin(*TESTED)))


@query("masked_rank", "with " + RANKS + " select seq_id, pos, key, rank from ranked")
def masked_rank(spark, folder):
    return ranked_elements(spark, folder).select("seq_id", "pos", "key", "rank")


@query(
    "masked_rank_sequences",
    "with " + RANKS + f""" select seq_id, cast(count(*) filter (rank >= {TOP_RANK}) as bigint) as undetected_tokens,
    cast(count(*) as bigint) as masked_tokens, round(avg(rank), 6) as element_anomaly_score from ranked group by 1""",
)
def masked_rank_sequences(spark, folder):
    elements = written(inputs.elements_by_part(spark, folder).select("seq_id", "pos", "key", "part"))
    model = detect.ContextRankModel(elements.filter(F.col("part") == "train"))
    scored = model.score_sequences(elements.filter(F.col("part").isin(*TESTED)), TOP_RANK)
    return _rounded(scored)


@query(
    "rollup_elements",
    "with " + RANKS + f""" select seq_id, 0.0::double as num_error, cast(count(*) filter (rank >= {TOP_RANK}) as bigint) as undetected_tokens,
    cast(count(*) as bigint) as masked_tokens, cast(max(pos) + 2 as bigint) as total_logkey, cast(0 as bigint) as sphere_flag,
    round(avg(rank), 6) as element_anomaly_score from ranked group by 1""",
)
def rollup_elements(spark, folder):
    records = ranked_elements(spark, folder).select(
        "seq_id", "pos", F.lit(0.0).alias("num_error"), (F.col("rank") >= TOP_RANK).cast("long").alias("undetected_tokens"),
        F.lit(1).cast("long").alias("masked_tokens"), (F.col("pos") + 2).alias("total_logkey"),
        F.lit(0).cast("long").alias("sphere_flag"), F.col("rank").cast("double").alias("element_anomaly_score"),
    )
    return _rounded(detect.roll_up_elements(records))


LEVEL_SOURCES = RANKS + f""",
sq as (select seq_id, max(label) as label, count(*) filter (rank >= {TOP_RANK}) / count(*) as score from ranked group by 1),
els as (select 'element' as level, el_label as label, cast(rank as double) as score from ranked
        union all select 'element_abnormal_only', el_label, cast(rank as double) from ranked where part = 'test_abnormal')"""

RESULT_COLUMNS = RATED + ', round(u / (pn.np * pn.nn), 6) as "AUROC", round(a / pn.np, 6) as "AUPRC", cast(pn.np + pn.nn as bigint) as samples'


@query(
    "levels",
    "with " + LEVEL_SOURCES
    + GRID.format(step="1.0", count=200, by="level,", src="els") + AREA.format(by="level,", pby="level", src="els", using="using (level)")
    + f" select level, {RESULT_COLUMNS} from gm join best using (level, i) join pn using (level) join ar using (level) join mw using (level)"
    + " union all select 'sequence' as level, * from (with "
    + "x as (select 1)" + GRID.format(step="0.001", count=1000, by="", src="sq") + AREA.format(by="", pby="1", src="sq", using="on true")
    + f" select {RESULT_COLUMNS} from gm join best using (i), pn, ar, mw)",
)
def levels(spark, folder):
    ranked = written(ranked_elements(spark, folder))
    # A rank is a threshold at most up to the size of the training vocabulary.
    known = inputs.counts_by_part(spark, folder).filter(F.col("part") == "train").select("key").distinct().count()
    element = ranked.select(F.lit("element").alias("level"), F.col("el_label").alias("label"), F.col("rank").cast("double").alias("score"))
    within = ranked.filter(F.col("part") == "test_abnormal").select(
        F.lit("element_abnormal_only").alias("level"), F.col("el_label").alias("label"), F.col("rank").cast("double").alias("score")
    )
    by_element = written(element.unionByName(within))
    by_sequence = written(ranked.groupBy("seq_id").agg(
        F.max("label").alias("label"),
        detect.undetected_ratio(F.count(F.when(F.col("rank") >= TOP_RANK, 1)), F.count(F.lit(1))).alias("score"),
    ).select(F.lit("sequence").alias("level"), "label", "score"))
    parts = [
        evaluate.result_rows(scored, evaluate.best_threshold(scored, step, count, ["level"]), ["level"])
        for scored, step, count in ((by_element, 1.0, min(known, 200)), (by_sequence, 0.001, 1000))
    ]
    return _rounded(parts[0].unionByName(parts[1]))


NEXT = SPLIT + f""",
lens as (select seq_id, part, label, count(*) as n from el join parts using (seq_id) group by 1, 2, 3),
st as (select seq_id, part, label, n, unnest(generate_series(0, greatest(n - {NEXT_WIDTH}, 0))) as start from lens),
w as (select st.seq_id, st.part, st.label, st.start,
             coalesce(a.key, '#Pad') as k1, coalesce(b.key, '#Pad') as k2, coalesce(c.key, '#Pad') as k3, coalesce(d.key, '#Pad') as next_key
      from st left join el a on a.seq_id = st.seq_id and a.pos = st.start left join el b on b.seq_id = st.seq_id and b.pos = st.start + 1
      left join el c on c.seq_id = st.seq_id and c.pos = st.start + 2 left join el d on d.seq_id = st.seq_id and d.pos = st.start + 3),
sf as (select *, h, case h when 3 then k1 || ' ' || k2 || ' ' || k3 when 2 then k2 || ' ' || k3 when 1 then k3 else '' end as s
       from w, (values (0), (1), (2), (3)) hh(h)),
top as (select h, s, next_key, row_number() over (partition by h, s order by count(*) desc, next_key) as place
        from sf where part = 'train' group by h, s, next_key qualify place <= {TOP_NEXT}),
lv as (select sf.seq_id, sf.part, sf.label, sf.start, max(h) as h from sf
       where part in ('test_normal', 'test_abnormal') and (h, s) in (select h, s from top) group by 1, 2, 3, 4),
fl as (select lv.seq_id, lv.part, lv.label, lv.start, cast(case when t.next_key is null then 1 else 0 end as bigint) as flag,
              cast(case when t.place = 1 then 1 else 0 end as bigint) as first
       from lv join sf using (seq_id, start, h) left join top t on t.h = lv.h and t.s = sf.s and t.next_key = sf.next_key)"""


def flagged_windows(spark, folder):
    """Next-event verdict of every window of the test sessions."""
    parts = inputs.session_parts(spark, folder)
    windows = written(
        sequences.next_event_windows(inputs.sessions(spark, folder), NEXT_WIDTH, F.lit(sequences.PAD_TEXT)).join(parts.hint("merge"), "seq_id")
    )
    model = detect.NextEventModel(windows.filter(F.col("part") == "train"), NEXT_WIDTH, TOP_NEXT)
    return model.flag(windows.filter(F.col("part").isin(*TESTED)))


@query("ngram_topg", "with " + NEXT + " select seq_id, start, flag, first from fl")
def ngram_topg(spark, folder):
    return flagged_windows(spark, folder).select("seq_id", "start", "flag", "first")


@query(
    "rollup_windows",
    "with " + NEXT + """ select seq_id, cast(sum(flag) as bigint) as flags, cast(count(*) as bigint) as predicted,
    cast(max(flag) as bigint) as any_flag from fl group by 1""",
)
def rollup_windows(spark, folder):
    return detect.flag_totals(flagged_windows(spark, folder))


@query(
    "window_session_metrics",
    "with " + NEXT + """,
    s as (select seq_id, max(label) as y, max(flag) as p from fl group by 1),
    c as (select count(*) filter (p = 1 and y = 1) as tp, count(*) filter (p = 1 and y = 0) as fp, count(*) filter (p = 0 and y = 1) as fn,
                 count(*) filter (p = 0 and y = 0) as tn from s)
    select round((select avg(first) from fl), 6) as window_acc, round((tp + tn) / (tp + fp + tn + fn), 6) as session_acc,
           round(case when tp > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall,
           round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision from c""",
)
def window_session_metrics(spark, folder):
    return _rounded(evaluate.window_and_session_metrics(flagged_windows(spark, folder)))


@query(
    "decision_by_flags",
    "with " + NEXT + """,
    s as (select seq_id, sum(flag) as flags, count(*) as predicted from fl group by 1)
    select seq_id, cast(case when flags > 40 then 1 else 0 end as bigint) as by_count,
           cast(case when flags > 0.8::double * predicted then 1 else 0 end as bigint) as by_share from s""",
)
def decision_by_flags(spark, folder):
    totals = detect.flag_totals(flagged_windows(spark, folder))
    counted = detect.decide_by_flags(totals, 40).withColumnRenamed("pred", "by_count")
    return detect.decide_by_flags(counted, 0.8).select("seq_id", "by_count", F.col("pred").alias("by_share"))


@query(
    "best_f1",
    "with " + NEXT + """,
    s as (select seq_id, max(label) as label, sum(flag) as flags from fl group by 1),
    g as (select th, count(*) filter (label = 1 and flags > th) as tp, count(*) filter (label = 0 and flags > th) as fp,
                 count(*) filter (label = 0 and flags <= th) as tn, count(*) filter (label = 1 and flags <= th) as fn
          from s, (select unnest(generate_series(0, 9)) as th) group by 1),
    m as (select *, 100.0 * tp / (tp + fp) as p, 100.0 * tp / (tp + fn) as r from g where tp > 0)
    select cast(th as double) as thr, cast(tp as bigint) as "TP", cast(fp as bigint) as "FP", cast(tn as bigint) as "TN", cast(fn as bigint) as "FN",
           round(p, 6) as "P", round(r, 6) as "R", round(2 * p * r / (p + r), 6) as "F1" from m order by round(2 * p * r / (p + r), 12) desc, th limit 1""",
)
def best_f1(spark, folder):
    """Thresholds 0..9 on the number of flagged windows of a session."""
    flagged = flagged_windows(spark, folder)
    totals = flagged.groupBy("seq_id").agg(F.sum("flag").alias("flags"), F.max("label").alias("label"))
    scored = totals.select("label", F.col("flags").cast("double").alias("score"))
    return _rounded(evaluate.best_f1_threshold(scored))


@query(
    "confusion",
    "with " + UNSEEN + """,
    c as (select count(*) filter (score >= 0.02::double and label = 1) as tp, count(*) filter (score >= 0.02::double and label = 0) as fp,
                 count(*) filter (score < 0.02::double and label = 1) as fn, count(*) filter (score < 0.02::double and label = 0) as tn from unseen),
    m as (select *, tp / (tp + fp + 1e-8::double) as p, tp / (tp + fn + 1e-8::double) as r from c)
    select cast(tp as bigint) as "TP", cast(fp as bigint) as "FP", cast(fn as bigint) as "FN", cast(tn as bigint) as "TN",
           round(p * 100, 4) as "P", round(r * 100, 4) as "R", round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end * 100, 4) as "F1" from m""",
)
def confusion(spark, folder):
    decided = detect.decide_by_score(unseen_table(spark, folder), F.lit(0.02))
    return evaluate.confusion(decided)


VALID = SPLIT + """,
vp as (select seq_id, label, case when part = 'train' and rn <= floor(tot * 0.1::double) then 'valid_normal' when part = 'train' then 'fit' else part end as part
       from (select *, count(*) over (partition by part) as tot, row_number() over (partition by part order by md5('1234|' || seq_id), seq_id) as rn from parts)),
fk as (select distinct c.key from cnts c join vp on vp.seq_id = c.seq_id where vp.part = 'fit'),
us as (select c.seq_id, vp.label, case when vp.part like 'valid%' then 'valid' else 'test' end as phase,
              sum(case when fk.key is null then cnt else 0 end) / sum(cnt) as score
       from cnts c join vp on vp.seq_id = c.seq_id left join fk on fk.key = c.key where vp.part <> 'fit' group by 1, 2, 3),
unseen as (select * from us where phase = 'valid')"""


@query(
    "valid_then_test",
    "with " + VALID + GRID.format(step="0.001", count=1000, by="", src="unseen") + """,
    th as (select thr from gm join best using (i)),
    c as (select thr, count(*) filter (label = 1 and score >= thr) as tp, count(*) filter (label = 0 and score >= thr) as fp,
                 count(*) filter (label = 0 and score < thr) as tn, count(*) filter (label = 1 and score < thr) as fn
          from us, th where phase = 'test' group by 1)
    select round(thr, 6) as thr, cast(tp as bigint) as "TP", cast(fp as bigint) as "FP", cast(tn as bigint) as "TN", cast(fn as bigint) as "FN",
           round(case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) <> 0
             then 100 * (tp * tn - fp * fn) / sqrt(cast((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) as double)) else 0 end, 6) as "MCC" from c""",
)
def valid_then_test(spark, folder):
    counts, parts = inputs.split_counts(spark, folder)
    train = splits.holdout(parts.filter(F.col("part") == "train").drop("part"), 0.1, 1234, "valid_normal", "fit")
    phases = written(train.unionByName(parts.filter(F.col("part") != "train")))
    fitted = counts.join(phases.filter(F.col("part") == "fit"), "seq_id", "left_semi").select("key").distinct()
    others = phases.filter(F.col("part") != "fit").withColumn(
        "phase", F.when(F.col("part").startswith("valid"), "valid").otherwise("test")
    )
    scores = detect.unseen_scores(counts.join(others, "seq_id", "left_semi"), fitted).join(others, "seq_id")
    scored = written(scores)
    best = evaluate.best_threshold(scored.filter(F.col("phase") == "valid"))
    tested = evaluate.at_threshold(scored.filter(F.col("phase") == "test"), best)
    return _rounded(tested.select("thr", "TP", "FP", "TN", "FN", "MCC"))


@query(
    "sweep_results",
    "with " + SWEEP + """,
    kn as (select distinct step, key from sweep join cnts using (seq_id) where sweep.part = 'train'),
    us as (select s.step, s.seq_id, case when s.part = 'test_abnormal' then 1 else 0 end as label,
                  sum(case when kn.key is null then cnt else 0 end) / sum(cnt) as score
           from sweep s join cnts c using (seq_id) left join kn on kn.step = s.step and kn.key = c.key where s.part <> 'train' group by 1, 2, 3)"""
    + GRID.format(step="0.001", count=1000, by="step,", src="us") + AREA.format(by="step,", pby="step", src="us", using="using (step)")
    + f""" select step, {RATED}, round(u / (pn.np * pn.nn), 6) as "AUROC", round(a / pn.np, 6) as "AUPRC", cast(pn.np + pn.nn as bigint) as samples
    from gm join best using (step, i) join pn using (step) join ar using (step) join mw using (step)""",
)
def sweep_results(spark, folder):
    """Unseen-key detection at every step of the instability sweep, all steps in one job."""
    counts, stepped = sweep_parts(spark, folder)
    stepped = written(stepped)
    parted = counts.join(stepped, "seq_id")
    known = parted.filter(F.col("part") == "train").select("step", "key").distinct().withColumn("_known", F.lit(1))
    tested = parted.filter(F.col("part").isin(*TESTED))
    flagged = lookup_join(tested, known, ["step", "key"], "left", F.col("seq_id"))
    scored = written(flagged.groupBy("step", "seq_id", "part").agg(
        (F.sum(F.when(F.col("_known").isNull(), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("score")
    ).withColumn("label", (F.col("part") == "test_abnormal").cast("long")))
    best = evaluate.best_threshold(scored, by=["step"])
    return _rounded(evaluate.result_rows(scored, best, ["step"]))

