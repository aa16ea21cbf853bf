"""Queries on models that learn structure: variable contexts, subspaces, margins, learned key vectors, and decisions that join them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog import inputs
from strandline.catalog.detecting import AREA, GRID, NEXT, NEXT_WIDTH, RANKS, RATED, TESTED, TOP_NEXT, TOP_RANK, _result, _rounded, ranked_elements
from strandline.catalog.registry import SESSIONS, SPLIT, Registry
from strandline.catalog.vectors import DIMS, FITTED, HASHED, REACH, _train_and_test, key_vectors
from strandline.operators import count_detectors as detect
from strandline.operators import evaluate, features, margins, ml_detectors, sequences, splits, subspaces
from strandline.operators import key_vectors as learned
from strandline.operators import vector_detectors as vd
from strandline.operators.context_tree import ContextTree
from strandline.session import written

registry = Registry()
query = registry.query

LEAST, WORTH = 2, 2.0

# The tree of contexts: counts by order and suffix, what a suffix says beyond the one shorter, and what is kept.
TREE = NEXT + f""",
tt as (select h, s, next_key, count(*) as c from sf where part = 'train' group by 1, 2, 3),
tot as (select h, s, sum(c) as n, regexp_replace(s, '^[^ ]* ?', '') as par from tt group by h, s),
gain as (
  select t.h, t.s, any_value(o.par) as par, any_value(o.n) as n, sum(t.c * ln(t.c / o.n / (p.c / q.n))) as gain
  from tt t join tot o on o.h = t.h and o.s = t.s join tot q on q.h = t.h - 1 and q.s = o.par
  join tt p on p.h = t.h - 1 and p.s = o.par and p.next_key = t.next_key where t.h > 0 and o.n >= {LEAST} group by t.h, t.s),
kept3 as (select * from gain where h = 3 and gain >= {WORTH}::double),
kept2 as (select * from gain where h = 2 and (gain >= {WORTH}::double or s in (select par from kept3))),
kept1 as (select * from gain where h = 1 and (gain >= {WORTH}::double or s in (select par from kept2))),
kept as (select h, s, n, gain from kept3 union all select h, s, n, gain from kept2 union all select h, s, n, gain from kept1
         union all select h, s, n, 0 from tot where h = 0),
ktop as (select h, s, next_key, row_number() over (partition by h, s order by c desc, next_key) as place from tt join kept using (h, s) qualify place <= {TOP_NEXT}),
klv as (select sf.seq_id, sf.start, max(h) as h from sf where part in ('test_normal', 'test_abnormal') and (h, s) in (select h, s from kept) group by 1, 2),
kfl as (select klv.seq_id, klv.start, cast(case when t.next_key is null then 1 else 0 end as bigint) as flag, cast(case when t.place = 1 then 1 else 0 end as bigint) as first
        from klv join sf using (seq_id, start, h) left join ktop t on t.h = klv.h and t.s = sf.s and t.next_key = sf.next_key)"""


def _tree(spark, folder):
    parts = inputs.session_parts(spark, folder)
    windows = written(sequences.next_event_windows(inputs.sessions(spark, folder), NEXT_WIDTH, F.lit(sequences.PAD_TEXT)).join(parts.hint("merge"), "seq_id"))
    return windows, ContextTree(windows.filter(F.col("part") == "train"), NEXT_WIDTH, TOP_NEXT, LEAST, WORTH)


@query("context_tree_nodes", "with " + TREE + " select cast(h as int) as \"order\", s as suffix, cast(n as bigint) as total, round(gain, 4) as gain from kept")
def context_tree_nodes(spark, folder):
    """Contexts of variable depth that the training windows are worth."""
    _, tree = _tree(spark, folder)
    return tree.nodes.select("order", "suffix", "total", F.round("gain", 4).alias("gain"))


@query("context_tree_next", "with " + TREE + " select seq_id, start, flag, first from kfl")
def context_tree_next(spark, folder):
    """Next-event verdicts of the test windows by their longest kept context."""
    windows, tree = _tree(spark, folder)
    return tree.flag(windows.filter(F.col("part").isin(*TESTED))).select("seq_id", "start", "flag", "first")


def _cells(spark, folder):
    return tuple(c.withColumnRenamed("cnt", "value") for c in _train_and_test(spark, folder))


@query("pca_residual_split")
def pca_residual_split(spark, folder):
    """Residuals of the test sessions on all keys of the split, against eight components of the training sessions."""
    train, test = _cells(spark, folder)
    return subspaces.RangeModel(train, 8).predict(test).select("seq_id", F.round("residual", 4).alias("residual"), "pred")


@query("fourier_one_class")
def fourier_one_class(spark, folder):
    """One-class verdicts on the test sessions for the Gaussian kernel."""
    train, test = _cells(spark, folder)
    model = margins.FourierMargin(train, nu=0.5, features=128, passes=6)
    return model.predict(test).select("seq_id", F.round("score", 6).alias("score"), "pred")


def _labelled(spark, folder):
    """Training cells and labels, and test cells, of the split that trains with some abnormal sessions."""
    counts, parts = inputs.split_counts(spark, folder)
    split = written(splits.supervised_split(parts, 88))
    cells = counts.withColumnRenamed("cnt", "value").join(split.select("seq_id", "split"), "seq_id")
    train = written(cells.filter(F.col("split") == "train").drop("split"))
    return train, split.filter(F.col("split") == "train").select("seq_id", "label"), cells.filter(F.col("split") == "test").drop("split")


@query("sparse_margin_split")
def sparse_margin_split(spark, folder):
    """Margins of the test sessions by the L1 machine."""
    train, labels, tested = _labelled(spark, folder)
    return margins.SparseMargin(train, labels, c=0.1, tol=1e-4).predict(tested).select("seq_id", F.round("margin", 4).alias("margin"), "pred")


def _classified(spark, folder, estimator):
    train, labels, tested = _labelled(spark, folder)
    return ml_detectors.Classifier(estimator(labels.count()), train, labels).predict(tested)


@query("logistic_regression_split")
def logistic_regression_split(spark, folder):
    return _classified(spark, folder, ml_detectors.logistic_regression).select("seq_id", "pred", F.round("probability", 4).alias("probability"))


@query("supervised_low_probability_split")
def supervised_low_probability_split(spark, folder):
    scored = ml_detectors.low_probability(_classified(spark, folder, ml_detectors.logistic_regression))
    return scored.select("seq_id", "pred", F.round("probability", 4).alias("probability"))


@query("decision_tree_split")
def decision_tree_split(spark, folder):
    scored = _classified(spark, folder, lambda n: ml_detectors.decision_tree())
    return scored.select("seq_id", "pred", F.round("probability", 4).alias("probability"))


@query("linear_svm_split")
def linear_svm_split(spark, folder):
    return _classified(spark, folder, ml_detectors.linear_svm).select("seq_id", "pred")


@query("isolation_forest_split")
def isolation_forest_split(spark, folder):
    """Scores of the test sessions by a forest of the training sessions."""
    train, test = _cells(spark, folder)
    return ml_detectors.IsolationForest(train).predict(test).select("seq_id", F.round("score", 6).alias("score"), "pred")


@query("vocab_free_mse_learned")
def vocab_free_mse_learned(spark, folder):
    """Vocabulary-free error of the test elements on hashed and learned vectors; keys unseen in training have hashed ones only."""
    elements = written(inputs.elements_by_part(spark, folder).select("seq_id", "pos", "key", "part"))
    rank = 8
    vectors = learned.learned_vectors(elements.filter(F.col("part") == "train"), REACH, rank)
    both = features.dense_vectors(learned.beside(key_vectors(spark, folder), vectors, DIMS), DIMS + rank)
    tested = elements.filter(F.col("part").isin(*TESTED)).select("seq_id", "pos", "key")
    scored = vd.neighbour_error(tested, both, DIMS + rank, REACH)
    return scored.select("seq_id", "pos", F.round("error", 4).alias("error"))


# Vocabulary-free errors of the test elements, the sphere's verdict on their sessions, and both in one record a session.
RECORDS = RANKS + HASHED[len(SESSIONS):] + FITTED[len(SPLIT):] + """,
fulld as (select k.key, g.d, coalesce(hv.value, 0) as v from ks k cross join (select unnest(generate_series(0, 15)) as d) g
          left join hv on hv.key = k.key and hv.dim = g.d),
vpairs as (select a.seq_id, a.pos, b.key as k2 from el a join el b on a.seq_id = b.seq_id and b.pos between a.pos - 2 and a.pos + 2 and a.pos <> b.pos),
vpm as (select p.seq_id, p.pos, f.d, avg(f.v) as m from vpairs p join fulld f on f.key = p.k2 group by 1, 2, 3),
verr as (select e.seq_id, e.pos, avg((coalesce(vpm.m, 0) - t.v) * (coalesce(vpm.m, 0) - t.v)) as error
         from el e join fulld t on t.key = e.key left join vpm on vpm.seq_id = e.seq_id and vpm.pos = e.pos and vpm.d = t.d group by 1, 2),
sph as (select key, sum(cnt) / max(n)::double as c from tr, nn group by 1),
srows as (select seq_id, key, cnt from tr union all select seq_id, key, cnt from te),
sd as (select s.seq_id, sqrt(sum((coalesce(a.cnt, 0) - coalesce(sph.c, 0)) * (coalesce(a.cnt, 0) - coalesce(sph.c, 0)))) as distance
       from (select distinct seq_id from srows) s cross join (select key from sph union select key from srows) k
       left join srows a on a.seq_id = s.seq_id and a.key = k.key left join sph on sph.key = k.key group by 1),
sr as (select quantile_cont(distance, 0.75) as radius from sd where seq_id in (select seq_id from tr)),
record as (
  select r.seq_id, max(r.label) as label, avg(verr.error) as num_error, count(*) filter (rank >= {top}) as undetected_tokens, count(*) as masked_tokens,
         max(r.pos) + 2 as total_logkey, max(case when sd.distance > sr.radius then 1 else 0 end) as sphere_flag, avg(rank) as element_anomaly_score
  from ranked r join verr on verr.seq_id = r.seq_id and verr.pos = r.pos join sd on sd.seq_id = r.seq_id, sr group by r.seq_id),
vf as (select seq_id, label, num_error as score, sphere_flag from record)""".replace("{top}", str(TOP_RANK))


def session_records(spark, folder):
    """One record a test session: vocabulary-free error and rank of its elements rolled up, with the sphere's flag, and its label."""
    ranked = ranked_elements(spark, folder)
    vectors = features.dense_vectors(key_vectors(spark, folder), DIMS)
    elements = written(ranked.select("seq_id", "pos", "key", "rank", "label"))
    errors = vd.neighbour_error(elements, vectors, DIMS, REACH)
    train, test = _cells(spark, folder)
    flags = vd.CountSphere(train, 0.25).predict(test).select("seq_id", F.col("pred").alias("sphere_flag"))
    records = errors.join(flags.hint("merge"), "seq_id").select(
        "seq_id", "pos", F.col("error").alias("num_error"), (F.col("rank") >= TOP_RANK).cast("long").alias("undetected_tokens"),
        F.lit(1).cast("long").alias("masked_tokens"), (F.col("pos") + 2).alias("total_logkey"), "sphere_flag", F.col("rank").cast("double").alias("element_anomaly_score"), "label",
    )
    labels = records.groupBy("seq_id").agg(F.max("label").alias("label"))
    return detect.roll_up_elements(records).join(labels.hint("merge"), "seq_id")


@query(
    "rollup_records",
    "with " + RECORDS + """ select seq_id, round(num_error, 6) as num_error, cast(undetected_tokens as bigint) as undetected_tokens, cast(masked_tokens as bigint) as masked_tokens,
    cast(total_logkey as bigint) as total_logkey, cast(sphere_flag as bigint) as sphere_flag, round(element_anomaly_score, 6) as element_anomaly_score, label from record""",
)
def rollup_records(spark, folder):
    return _rounded(session_records(spark, folder))


def _vocab_free(spark, folder):
    return written(detect.masked_only(session_records(spark, folder)).select("seq_id", "label", F.col("num_error").alias("score"), "sphere_flag"))


@query(
    "vocab_free_result",
    "with " + RECORDS + GRID.format(step="0.001", count=2000, by="", src="vf") + AREA.format(by="", pby="1", src="vf", using="on true")
    + f""" select {RATED}, round(u / (pn.np * pn.nn), 6) as "AUROC", round(a / pn.np, 6) as "AUPRC", cast(pn.np + pn.nn as bigint) as samples
    from gm join best using (i), pn, ar, mw""",
)
def vocab_free_result(spark, folder):
    """Best level of the vocabulary-free error between 0 and 2."""
    keyed = _vocab_free(spark, folder).withColumn("_all", F.lit(1))
    best = evaluate.best_threshold(keyed, 0.001, 2000, by=["_all"])
    return _rounded(evaluate.result_rows(keyed, best, ["_all"]).drop("_all"))


@query(
    "decision_with_sphere",
    "with " + RECORDS + GRID.format(step="0.001", count=2000, by="", src="vf") + """,
    th as (select thr from gm join best using (i))
    select seq_id, round(score, 6) as score, cast(sphere_flag as bigint) as sphere_flag, cast(case when score >= thr then 1 else 0 end as bigint) as by_score,
           cast(case when score >= thr or sphere_flag = 1 then 1 else 0 end as bigint) as pred from vf, th""",
)
def decision_with_sphere(spark, folder):
    """Sessions over the best level of the error, or outside the sphere."""
    scored = _vocab_free(spark, folder)
    thr = evaluate.best_threshold(scored, 0.001, 2000).first()["thr"]
    by_score = detect.decide_by_score(scored, F.lit(thr)).withColumnRenamed("pred", "by_score")
    both = detect.decide_by_score(by_score, F.lit(thr), use_sphere=True)
    return both.select("seq_id", F.round("score", 6).alias("score"), "sphere_flag", "by_score", "pred")
