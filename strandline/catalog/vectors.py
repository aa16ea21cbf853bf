"""Queries on features, vector detectors and Spark ML detectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandline.catalog import inputs
from strandline.catalog.registry import EVENT_LINES, ORDERS, SESSIONS, SPLIT, Registry
from strandline.operators import features, ml_detectors, sequences, splits
from strandline.operators import vector_detectors as vd
from strandline.session import written
from strandline.sources import tables

registry = Registry()
query = registry.query

DIMS, REACH = 16, 2


@query("count_matrix", "with " + SESSIONS + " select seq_id, key, cast(count(*) as bigint) as cnt from el group by 1, 2")
def count_matrix(spark, folder):
    return inputs.session_counts(spark, folder).drop("el_label")


def _train_and_test(spark, folder):
    counts, parts = inputs.split_counts(spark, folder)
    train = counts.join(parts.filter(F.col("part") == "train"), "seq_id", "left_semi")
    test = counts.join(parts.filter(F.col("part").isin("test_normal", "test_abnormal")), "seq_id", "left_semi")
    return written(train), written(test)


FITTED = SPLIT + """,
tr as (select seq_id, key, cnt from cnts where part = 'train'),
te as (select seq_id, key, cnt from cnts where part in ('test_normal', 'test_abnormal')),
nn as (select count(distinct seq_id) as n from tr),
fit as (select key, count(*) as df, ln(n / (count(*) + 1e-8::double)) as idf from tr, nn group by key, n)"""


@query("tfidf", "with " + FITTED + " select seq_id, key, round(cnt * idf, 6) as value from te join fit using (key)")
def tfidf(spark, folder):
    train, test = _train_and_test(spark, folder)
    cells = features.CountFeatures(train, idf=True).transform(test)
    return cells.select("seq_id", "key", F.round("value", 6).alias("value"))


@query(
    "zero_mean",
    "with " + FITTED + """,
    m as (select key, sum(cnt * idf) / max(n) as mean from tr join fit using (key), nn group by 1)
    select seq_id, key, round(cnt * idf - mean, 6) as value from te join fit using (key) join m using (key)
    union all select '<absent>', key, round(-mean, 6) from m""",
)
def zero_mean(spark, folder):
    train, test = _train_and_test(spark, folder)
    model = features.CountFeatures(train, idf=True)
    means = written(model.means(model.transform(train, fitted=True)))
    stored = features.centred(model.transform(test), means)
    absent = features.absent_cells(means).select(F.lit("<absent>").alias("seq_id"), "key", "value")
    return stored.unionByName(absent).select("seq_id", "key", F.round("value", 6).alias("value"))


@query("sigmoid_cells", "with " + FITTED + " select seq_id, key, round(1 / (1 + exp(-cnt::double)), 6) as value from te join fit using (key)")
def sigmoid_cells(spark, folder):
    train, test = _train_and_test(spark, folder)
    cells = features.sigmoid(features.CountFeatures(train).transform(test))
    return cells.select("seq_id", "key", F.round("value", 6).alias("value"))


@query(
    "oov_feature",
    "with " + FITTED + """,
    kept as (select key from fit where df >= 5)
    select 'train' as part, seq_id, cast(count(*) as double) as value from tr where key not in (select key from kept) group by 2
    union all select 'test', seq_id, cast(count(*) as double) from te where key not in (select key from kept) group by 2""",
)
def oov_feature(spark, folder):
    train, test = _train_and_test(spark, folder)
    model = features.CountFeatures(train, min_count=5, oov=True)
    made = [
        model.transform(counts, fitted).filter(F.col("key") == model.OOV_KEY).select(F.lit(part).alias("part"), "seq_id", "value")
        for counts, fitted, part in ((train, True, "train"), (test, False, "test"))
    ]
    return made[0].unionByName(made[1])


@query(
    "minmax_durations",
    "with " + EVENT_LINES + """,
    d as (select line_id, cast(coalesce(epoch - lag(epoch) over (order by line_id), 0) as double) as dt from event_lines)
    select line_id, round((dt - (select min(dt) from d)) / ((select max(dt) from d) - (select min(dt) from d)), 6) as scaled from d""",
)
def minmax_durations(spark, folder):
    lines = written(sequences.with_delta(tables.event_lines(spark, folder)).select("line_id", "delta_t"))
    return features.min_max(lines, "delta_t").select("line_id", F.round("delta_t", 6).alias("scaled"))


@query(
    "window_counts",
    "with " + ORDERS + """,
    lens as (select seq_id, count(*) as n from oel group by 1),
    starts as (select seq_id, unnest(generate_series(0, greatest(n - 3, 0))) as start from lens)
    select s.seq_id, s.start, coalesce(o.key, '<pad>') as key, cast(count(*) as bigint) as cnt
    from starts s cross join (values (0), (1), (2)) t(i) left join oel o on o.seq_id = s.seq_id and o.pos = s.start + i group by 1, 2, 3""",
)
def window_counts(spark, folder):
    return features.window_counts(sequences.next_event_windows(inputs.orders(spark, folder), 3, F.lit("<pad>")))


HASHED = SESSIONS + """,
ks as (select distinct key from el),
tk as (select key, token, count(*) as tf from (select key, unnest(string_split(key, '_')) as token from ks) group by 1, 2),
ti as (select token, 1 + ln((select count(*) from ks)::double / count(*)) as idf from tk group by 1),
hv as (select key, cast(strpos('0123456789abcdef', substr(md5(token), 1, 1)) - 1 as bigint) as dim,
              sum(tf * idf * case when strpos('0123456789abcdef', substr(md5(token), 2, 1)) - 1 < 8 then 1.0 else -1.0 end) as value
       from tk join ti using (token) group by 1, 2)"""


def key_vectors(spark, folder):
    return features.hashed_vectors(tables.event_lines(spark, folder), F.split("key", "_"))


@query("embed_hash", "with " + HASHED + " select key, dim, round(value, 6) as value from hv")
def embed_hash(spark, folder):
    return key_vectors(spark, folder).select("key", "dim", F.round("value", 6).alias("value"))


@query(
    "vocab_free_mse",
    "with " + HASHED + """,
    fulld as (select k.key, g.d, coalesce(hv.value, 0) as v from ks k cross join (select unnest(generate_series(0, 15)) as d) g
              left join hv on hv.key = k.key and hv.dim = g.d),
    pairs as (select a.seq_id, a.pos, a.key as k1, b.key as k2 from el a join el b on a.seq_id = b.seq_id and b.pos between a.pos - 2 and a.pos + 2 and a.pos <> b.pos),
    pm as (select p.seq_id, p.pos, f.d, avg(f.v) as m from pairs p join fulld f on f.key = p.k2 group by 1, 2, 3)
    select e.seq_id, e.pos, round(avg((coalesce(pm.m, 0) - t.v) * (coalesce(pm.m, 0) - t.v)), 6) as error
    from el e join fulld t on t.key = e.key left join pm on pm.seq_id = e.seq_id and pm.pos = e.pos and pm.d = t.d group by 1, 2""",
)
def vocab_free_mse(spark, folder):
    vectors = features.dense_vectors(key_vectors(spark, folder), DIMS)
    scored = vd.neighbour_error(inputs.sessions(spark, folder).select("seq_id", "pos", "key"), vectors, DIMS, REACH)
    return scored.select("seq_id", "pos", F.round("error", 6).alias("error"))


@query(
    "hypersphere",
    """with c as (select i, avg(embedding[i]::double) as m from embeddings, (select unnest(generate_series(1, 64)) as i) where label <> 0 group by i),
    d as (select vec_id, label, sqrt(sum((embedding[i]::double - m) * (embedding[i]::double - m))) as distance from embeddings, c group by 1, 2),
    r as (select quantile_cont(distance, 0.75) as radius from d where label <> 0)
    select vec_id, round(distance, 6) as distance, cast(case when distance > radius then 1 else 0 end as bigint) as pred from d, r""",
)
def hypersphere(spark, folder):
    rows = tables.table(spark, folder, "embeddings")
    model = vd.Hypersphere(rows.filter(F.col("label") != 0), "embedding", 0.25)
    return model.predict(rows).select("vec_id", F.round("distance", 6).alias("distance"), "pred")


@query(
    "one_class_counts",
    "with " + FITTED + """,
    c as (select key, sum(cnt) / max(n)::double as c from tr, nn group by 1),
    allrows as (select seq_id, key, cnt from tr union all select seq_id, key, cnt from te),
    d as (select s.seq_id, sqrt(sum((coalesce(a.cnt, 0) - coalesce(c.c, 0)) * (coalesce(a.cnt, 0) - coalesce(c.c, 0)))) as distance
          from (select distinct seq_id from allrows) s cross join (select key from c union select key from allrows) k
          left join allrows a on a.seq_id = s.seq_id and a.key = k.key left join c on c.key = k.key group by 1),
    r as (select quantile_cont(distance, 0.5) as radius from d where seq_id in (select seq_id from tr))
    select seq_id, round(distance, 6) as distance, cast(case when distance > radius then 1 else 0 end as bigint) as pred from d, r
    where seq_id in (select seq_id from te)""",
)
def one_class_counts(spark, folder):
    train, test = (c.withColumnRenamed("cnt", "value") for c in _train_and_test(spark, folder))
    scored = vd.CountSphere(train, 0.5).predict(test)
    return scored.select("seq_id", F.round("distance", 6).alias("distance"), "pred")


def order_cells(spark, folder):
    """Counts per order and key; needs no positions."""
    return splits.sequence_key_counts(tables.order_lines(spark, folder)).withColumnRenamed("cnt", "value")


@query(
    "gramian",
    "with " + ORDERS + """,
    c as (select seq_id, key, count(*) as cnt from oel group by 1, 2)
    select a.key as key_a, b.key as key_b, cast(sum(a.cnt * b.cnt) as double) as value
    from c a join c b on a.seq_id = b.seq_id and a.key <= b.key group by 1, 2""",
)
def gramian(spark, folder):
    cells = written(order_cells(spark, folder))
    matrix = vd.CountMatrix(cells)
    made = vd.gramian(matrix.rows(cells), matrix.size)
    names = matrix.keys
    return made.join(names.toDF("key_a", "i"), "i").join(names.toDF("key_b", "j"), "j").select("key_a", "key_b", "value")


INVARIANT_PAIRS = ORDERS + """,
c as (select seq_id, key, count(*) as cnt from oel group by 1, 2),
n as (select count(distinct seq_id) as n from c),
g as (select key, sum(cnt * cnt) as s from c group by 1),
x as (select a.key as ka, b.key as kb, sum(a.cnt * b.cnt) as s from c a join c b on a.seq_id = b.seq_id and a.key < b.key group by 1, 2),
p as (select a.key as ka, b.key as kb, a.s as aa, b.s as bb, coalesce(x.s, 0) as ab
      from g a join g b on a.key < b.key left join x on x.ka = a.key and x.kb = b.key)"""


@query(
    "invariants_pairs",
    "with " + INVARIANT_PAIRS + """,
    e as (select *, case when ab = 0 then null else ((aa + bb) - sqrt((aa - bb)::double * (aa - bb) + 4.0 * ab * ab)) / 2 end as lam from p where ab > 0),
    v as (select ka, kb, ab::double as va, (lam - aa) as vb from e),
    w as (select ka, kb, case when abs(va) <= abs(vb) then 1 else round(va / vb) end as wa,
                 case when abs(va) <= abs(vb) then round(vb / va) else 1 end as wb from v),
    b as (select w.ka, w.kb, w.wa, w.wb, (select n from n) - count(distinct case when coalesce(m.a, 0) * wa + coalesce(m.b, 0) * wb <> 0 then m.seq_id end) as holds
          from w join (select w2.ka, w2.kb, c.seq_id, max(case when c.key = w2.ka then cnt end) as a, max(case when c.key = w2.kb then cnt end) as b
                       from w w2 join c on c.key in (w2.ka, w2.kb) group by 1, 2, 3) m on m.ka = w.ka and m.kb = w.kb
          where wa <> 0 and wb <> 0 group by 1, 2, 3, 4)
    select ka as key_a, kb as key_b, cast(wa as bigint) as weight_a, cast(wb as bigint) as weight_b, cast(holds as bigint) as holds from b""",
)
def invariants_pairs(spark, folder):
    """First integer relation of every pair of keys that meet in an order, with the number of orders it holds in."""
    cells = written(order_cells(spark, folder))
    return vd.pair_relations(cells)


ORDER_FLAGS = """
fl as (select l_orderkey as seq_id, unnest(['line', 'flag_' || l_returnflag, 'status_' || l_linestatus]) as key from lineitem),
c as (select seq_id, key, count(*) as cnt from fl group by 1, 2)"""


def flag_cells(spark, folder):
    """Every order line raises three events - the line, its flag, its status - so their counts are tied."""
    opened = tables.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("seq_id"),
        F.explode(F.array(
            F.lit("line"), F.concat(F.lit("flag_"), "l_returnflag"), F.concat(F.lit("status_"), "l_linestatus")
        )).alias("key"),
    )
    return splits.sequence_key_counts(opened).withColumnRenamed("cnt", "value")


@query("invariants_mined", """
    with """ + ORDER_FLAGS + """,
    w as (select seq_id, coalesce(max(cnt) filter (key = 'line'), 0) as l, coalesce(max(cnt) filter (key = 'status_F'), 0) as f,
                 coalesce(max(cnt) filter (key = 'status_O'), 0) as o from c group by 1)
    select 'line status_F status_O' as keys, '1 -1 -1' as weights from w having count(*) filter (l - f - o = 0) >= 0.98 * count(*)""")
def invariants_mined(spark, folder):
    cells = written(flag_cells(spark, folder))
    found = vd.Invariants(cells, longest=3).relations()
    return spark.createDataFrame(found, "keys string, weights string")


# With two keys the components have a closed form; one is kept, and the statistic of one remaining variance is a multiple of it.
@query(
    "pca_residual",
    "with " + ORDER_FLAGS + """,
    x as (select seq_id, coalesce(max(cnt) filter (key = 'status_F'), 0)::double as f, coalesce(max(cnt) filter (key = 'status_O'), 0)::double as o
          from c group by 1),
    m as (select sum(f * f) / count(*) as a, sum(f * o) / count(*) as b, sum(o * o) / count(*) as d from x where seq_id % 5 < 4),
    v as (select b, a, ((a + d) - sqrt((a - d) * (a - d) + 4 * b * b)) / 2 as lam from m),
    r as (select seq_id, (f * b + o * (lam - a)) * (f * b + o * (lam - a)) / (b * b + (lam - a) * (lam - a)) as residual, lam from x, v where seq_id % 5 = 4)
    select seq_id, round(residual, 4) as residual,
           cast(case when residual > lam * pow(3.2905::double * sqrt(2::double) / 3 + 1 - 2.0::double / 9, 3) then 1 else 0 end as bigint) as pred from r""",
)
def pca_residual(spark, folder):
    """Orders by their two status counts, against the first component of four fifths of them."""
    cells = flag_cells(spark, folder).filter(F.col("key").startswith("status_"))
    model = vd.ResidualModel(cells.filter(F.col("seq_id") % 5 < 4), variance=1)
    return model.predict(cells.filter(F.col("seq_id") % 5 == 4)).select("seq_id", F.round("residual", 4).alias("residual"), "pred")


RULES = [("r1", "line", 1.0), ("r1", "status_F", -1.0), ("r1", "status_O", -1.0), ("r2", "flag_A", 2.0), ("r2", "flag_N", -1.0)]


@query(
    "invariants_predict",
    "with " + ORDER_FLAGS + """,
    r as (select * from (values ('r1', 'line', 1), ('r1', 'status_F', -1), ('r1', 'status_O', -1), ('r2', 'flag_A', 2), ('r2', 'flag_N', -1)) v(rule, key, weight)),
    s as (select c.seq_id, r.rule, sum(cnt * coalesce(weight, 0)) as t from c left join r using (key) group by 1, 2)
    select seq_id, cast(max(case when abs(t) > 1e-6::double then 1 else 0 end) as bigint) as pred from s group by 1""",
)
def invariants_predict(spark, folder):
    rules = spark.createDataFrame(RULES, "rule string, key string, weight double")
    return vd.broken_invariants(flag_cells(spark, folder), rules)


@query(
    "cluster_assign",
    """with c as (select label, i, avg(embedding[i]::double) as m from embeddings, (select unnest(generate_series(1, 64)) as i) group by 1, 2),
    cn as (select label, sqrt(sum(m * m)) as norm from c group by 1),
    d as (select e.vec_id, c.label as cluster, sum(e.embedding[c.i]::double * c.m) as dot, sqrt(sum(e.embedding[c.i]::double * e.embedding[c.i]::double)) as nx
          from embeddings e, c group by 1, 2),
    f as (select vec_id, cluster, 1 - dot / (nx * norm + 1e-8::double) as raw from d join cn on cn.label = d.cluster),
    g as (select vec_id, cluster, case when raw < 1e-8::double then 0 else raw end as distance from f)
    select vec_id, cast(arg_min(cluster, distance) as bigint) as cluster, round(min(distance), 6) as distance,
           cast(case when min(distance) > 0.3::double then 1 else 0 end as bigint) as pred from g group by 1""",
)
def cluster_assign(spark, folder):
    rows = tables.table(spark, folder, "embeddings")
    means = vd.group_means(rows, "label", "embedding")
    placed = vd.nearest_point(rows.select("vec_id", "embedding"), "embedding", np.vstack([m for _, m in means]))
    labels = F.create_map(*[x for i, (label, _) in enumerate(means) for x in (F.lit(i).cast("long"), F.lit(label).cast("long"))])
    return placed.select(
        "vec_id", labels[F.col("cluster")].alias("cluster"), F.round("distance", 6).alias("distance"),
        (F.col("distance") > 0.3).cast("long").alias("pred"),
    )


@query(
    "cluster_fit",
    """with w as (select l_orderkey as seq_id, l_orderkey % 3 as p, count(*)::double as a, (count(*) filter (l_quantity >= 45))::double as b from lineitem group by 1),
    m as (select p, avg(a) as ma, avg(b) as mb from w group by 1),
    d as (select p, 1 - (a * ma + b * mb) / (sqrt(a * a + b * b) * sqrt(ma * ma + mb * mb) + 1e-8::double) as raw from w join m using (p))
    select cast(count(*) as bigint) as members, round(max(case when raw < 1e-8::double then 0 else raw end), 4) as widest, cast(0 as bigint) as anomalies
    from d group by p""",
)
def cluster_fit(spark, folder):
    """Orders of three kinds, each with events of its own - its lines and its large lines - clustered by event counts."""
    kind = F.concat(F.lit("kind"), (F.col("l_orderkey") % 3).cast("string"))
    opened = tables.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("seq_id"),
        F.explode(F.array_compact(F.array(F.concat(kind, F.lit("_line")), F.when(F.col("l_quantity") >= 45, F.concat(kind, F.lit("_large")))))).alias("key"),
    )
    cells = written(splits.sequence_key_counts(opened).withColumnRenamed("cnt", "value"))
    matrix = vd.CountMatrix(cells)
    rows = written(vd.dense_arrays(matrix.rows(cells), matrix.size))
    placed = vd.Clusters(rows, "counts", max_distance=0.3).predict(rows)
    return placed.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"), F.round(F.max("distance"), 4).alias("widest"), F.sum("pred").alias("anomalies")
    ).drop("cluster")


@query("isolation_forest", "select l_orderkey as seq_id, cast(case when l_orderkey % 40 = 0 then 1 else 0 end as bigint) as pred from lineitem group by 1")
def isolation_forest(spark, folder):
    """Orders by event counts; every fortieth is given counts far from all others and is to be found."""
    far = F.col("seq_id") % 40 == 0
    cells = written(flag_cells(spark, folder).withColumn("value", F.when(far, F.lit(1000)).otherwise(F.col("value")).cast("double")))
    share = cells.select("seq_id", far.cast("int").alias("far")).distinct().agg(F.avg("far")).first()[0]
    return ml_detectors.IsolationForest(cells, contamination=share or 0.0).predict(cells).select("seq_id", "pred")


RETURNED = "with l as (select l_orderkey as seq_id, cast(max(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as pred from lineitem group by 1) "


def _supervised(spark, folder, estimator):
    """Orders by the counts of their line events; label: the order has a returned line, which the counts decide. Four
    fifths of the orders are learned from, the rest is judged."""
    cells = written(flag_cells(spark, folder).withColumn("learned", F.col("seq_id") % 5 < 4))
    train = cells.filter("learned")
    labels = train.groupBy("seq_id").agg(F.max((F.col("key") == "flag_R").cast("int")).alias("label"))
    model = ml_detectors.Classifier(estimator(labels.count()), train.select("seq_id", "key", "value"), labels)
    return model.predict(cells.filter("not learned").select("seq_id", "key", "value"))


@query("logistic_regression", RETURNED + "select seq_id, pred, pred = 1 as likely from l where seq_id % 5 = 4")
def logistic_regression(spark, folder):
    scored = _supervised(spark, folder, ml_detectors.logistic_regression)
    return scored.select("seq_id", "pred", (F.col("probability") > 0.9).alias("likely"))


@query("supervised_low_probability", RETURNED + "select seq_id, pred from l where seq_id % 5 = 4")
def supervised_low_probability(spark, folder):
    scored = _supervised(spark, folder, ml_detectors.logistic_regression)
    return ml_detectors.low_probability(scored).select("seq_id", "pred")


@query("decision_tree", RETURNED + "select seq_id, pred from l where seq_id % 5 = 4")
def decision_tree(spark, folder):
    return _supervised(spark, folder, lambda n: ml_detectors.decision_tree()).select("seq_id", "pred")


@query("linear_svm", RETURNED + "select seq_id, pred from l where seq_id % 5 = 4")
def linear_svm(spark, folder):
    return _supervised(spark, folder, ml_detectors.linear_svm).select("seq_id", "pred")
