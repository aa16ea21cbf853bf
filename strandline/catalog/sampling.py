"""Queries on training samples and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog import inputs
from strandline.catalog.detecting import RANKS, TOP_RANK, ranked_elements
from strandline.catalog.registry import ORDERS, SESSIONS, Registry
from strandline.catalog.splitting import STATS_SQL, SWEEP, VOCAB, instability_sweep_stats, train_vocabulary
from strandline.operators import count_detectors, evaluate, reports, samples, sequences, vocabulary
from strandline.plans.lookup import lookup_join
from strandline.session import written
from strandline.sources import tables

registry = Registry()
query = registry.query

RATIO, SEED = 0.5, 11


def unit(expr: str, word: int = 0) -> str:
    """SQL for a number in [0, 1) from one 32-bit word of an md5."""
    digits = " + ".join(
        f"(strpos('0123456789abcdef', substr(h, {8 * word + i + 1}, 1)) - 1) * {16 ** (7 - i)}::bigint" for i in range(8)
    )
    return f"(select ({digits})::double / 4294967296 from (select md5({expr}) as h))"


ENCODED = VOCAB + f""",
enc as (select e.seq_id, e.pos, e.key, coalesce(cast(v.idx as bigint), 1) as idx, l.value from el e left join vocab v using (key) join event_lines l using (line_id)),
dr as (select *, {unit(f"'{SEED}|' || seq_id || '|' || pos")} as u, {unit(f"'{SEED}|' || seq_id || '|' || pos", 1)} as u2 from enc),
vs as (select count(*) as v from vocab)"""


def encoded_sessions(spark, folder):
    vocab = train_vocabulary(spark, folder)
    lines = inputs.sessions(spark, folder)
    return vocab, vocab.count(), vocabulary.encode(lines, vocab)


@query(
    "mask_ratio",
    "with " + ENCODED + f"""
    select seq_id, pos + 1 as pos, case when u < {RATIO} then case when u / {RATIO} < 0.8 then 4 when u / {RATIO} < 0.9 then cast(floor(u2 * v) as bigint) else idx end else idx end as input_id,
           case when u < {RATIO} then idx else 0 end as label_id, case when u < {RATIO} then 0.0::double else value end as input_time,
           case when u < {RATIO} then value else 0.0::double end as label_time from dr, vs
    union all select distinct seq_id, cast(0 as bigint), cast(3 as bigint), cast(0 as bigint), 0.0::double, 0.0::double from enc""",
)
def mask_ratio(spark, folder):
    _, size, encoded = encoded_sessions(spark, folder)
    return samples.mask_elements(encoded, RATIO, size, SEED, duration="value")


@query(
    "mask_ratio_predict",
    "with " + ENCODED + f"""
    select seq_id, pos + 1 as pos, case when u < {RATIO} then 4 else idx end as input_id, case when u < {RATIO} then idx else 0 end as label_id from dr
    union all select distinct seq_id, cast(0 as bigint), cast(3 as bigint), cast(0 as bigint) from enc""",
)
def mask_ratio_predict(spark, folder):
    _, size, encoded = encoded_sessions(spark, folder)
    return samples.mask_elements(encoded, RATIO, size, SEED, predict=True)


@query(
    "mask_keys",
    "with " + ENCODED + f"""
    select seq_id, pos + 1 as pos, case when u < {RATIO} and u / {RATIO} < 0.8 then '<mask>' when u < {RATIO} and u / {RATIO} < 0.9 then w.key else dr.key end as input_key,
           case when u < {RATIO} then dr.key else '<pad>' end as label_key
    from dr cross join vs left join vocab w on w.idx = cast(floor(u2 * v) as bigint)""",
)
def mask_keys(spark, folder):
    vocab = train_vocabulary(spark, folder)
    return samples.mask_keys(inputs.sessions(spark, folder), vocab, RATIO, vocab.count(), SEED)


@query(
    "mask_per_element",
    "with " + SESSIONS + """
    select seq_id, pos, coalesce(lag(key) over w, '<sos>') as left_key, coalesce(lead(key) over w, '<eos>') as right_key, key as label_key
    from el window w as (partition by seq_id order by pos)""",
)
def mask_per_element(spark, folder):
    return samples.mask_each_position(inputs.sessions(spark, folder).select("seq_id", "pos", "key"))


SPARSE_RATIO = 0.03


@query(
    "masked_rank_ratio",
    "with " + RANKS + f""",
    dr as (select *, {unit(f"'{SEED}|' || seq_id || '|' || pos")} as u from ranked),
    s as (select seq_id, cast(count(*) filter (u < {SPARSE_RATIO}) as bigint) as masked_tokens,
                 cast(count(*) filter (u < {SPARSE_RATIO} and rank >= {TOP_RANK}) as bigint) as undetected_tokens from dr group by 1)
    select seq_id, masked_tokens, undetected_tokens, round(undetected_tokens / masked_tokens, 6) as score,
           cast(case when undetected_tokens / masked_tokens >= 0.5 then 1 else 0 end as bigint) as pred from s where masked_tokens > 0""",
)
def masked_rank_ratio(spark, folder):
    """Decision on sequences of which only a share is masked; those without a masked element are skipped."""
    chosen = samples.uniform(SEED, F.col("seq_id"), F.col("pos")) < SPARSE_RATIO
    totals = ranked_elements(spark, folder).groupBy("seq_id").agg(
        F.count(F.when(chosen, 1)).alias("masked_tokens"),
        F.count(F.when(chosen & (F.col("rank") >= TOP_RANK), 1)).alias("undetected_tokens"),
    )
    scored = count_detectors.masked_only(totals).withColumn(
        "score", count_detectors.undetected_ratio(F.col("undetected_tokens"), F.col("masked_tokens"))
    )
    return rounded(count_detectors.decide_by_score(scored, F.lit(0.5)))


PAIR_LEN, PAIR_SEED = 8, 5

ORDER_VOCAB = ORDERS + """,
ov as (select key, row_number() over (order by count(*) desc, key) + 4 as idx from oel group by key),
oe as (select seq_id, pos, idx from oel join ov using (key)),
vs as (select count(*) + 5 as v from ov)"""


def encoded_orders(spark, folder):
    elements = written(inputs.orders(spark, folder).select("seq_id", "pos", "key"))
    vocab = written(vocabulary.build_vocabulary(elements))
    return vocab.count(), written(vocabulary.encode(elements, vocab).select("seq_id", "pos", "idx"))


@query(
    "segment_pairs",
    "with " + ORDER_VOCAB + f""",
    ln as (select seq_id, count(*) as n, row_number() over (order by md5('5|' || seq_id), seq_id) as rank, count(*) over () as total from oe group by 1),
    ch as (select *, {unit(f"'{PAIR_SEED}|' || seq_id")} > 0.5 as own, cast(floor({unit(f"'{PAIR_SEED}|' || seq_id", 1)} * total) as bigint) + 1 as other from ln),
    pr as (select a.seq_id, case when own then 1 else 0 end as is_next, a.n // 2 as n1, b.seq_id as second_id, b.n - b.n // 2 as n2, b.n // 2 as from2
           from ch a join ln b on b.rank = case when own then a.rank else other end),
    wd as (select p.seq_id, is_next, e.pos + 1 as place, 1 as segment, idx from pr p join oe e on e.seq_id = p.seq_id where e.pos < n1
           union all select p.seq_id, is_next, n1 + 2 + e.pos - from2, 2, idx from pr p join oe e on e.seq_id = p.second_id where e.pos >= from2),
    dr as (select *, {unit(f"'{PAIR_SEED}|' || seq_id || '|' || place", 2)} as u, {unit(f"'{PAIR_SEED}|' || seq_id || '|' || place", 3)} as u2 from wd),
    al as (select seq_id, is_next, place, segment,
                  case when u < 0.15::double and u / 0.15::double < 0.8 then 4 when u < 0.15::double and u / 0.15::double < 0.9::double then floor(u2 * v) else idx end as input_id,
                  case when u < 0.15::double then idx else 0 end as label_id from dr, vs
           union all select seq_id, is_next, 0, 1, 3, 0 from pr union all select seq_id, is_next, n1 + 1, 1, 2, 0 from pr
           union all select seq_id, is_next, n1 + 2 + n2, 2, 2, 0 from pr)
    select seq_id, cast(is_next as bigint) as is_next, cast(place as bigint) as place, cast(segment as bigint) as segment, cast(input_id as bigint) as input_id,
           cast(label_id as bigint) as label_id from al where place < {PAIR_LEN}""",
)
def segment_pairs(spark, folder):
    size, encoded = encoded_orders(spark, folder)
    return samples.segment_pairs(encoded, PAIR_LEN, size, PAIR_SEED)


@query(
    "pad_batches",
    "with " + ORDER_VOCAB + """,
    ln as (select seq_id, count(*) + 1 as n from oe group by 1),
    pl as (select *, (row_number() over (order by n desc, md5(cast(seq_id as varchar)), seq_id) - 1) // 32 as batch from ln),
    wd as (select batch, least(max(n), 10) as width from pl group by 1)
    select pl.seq_id, cast(batch as bigint) as batch, cast(width as bigint) as width,
           string_agg(cast(case when i = 0 then 3 else coalesce(idx, 0) end as varchar), ' ' order by i) as ids
    from pl join wd using (batch) cross join (select unnest(generate_series(0, 9)) as i) t left join oe on oe.seq_id = pl.seq_id and oe.pos = i - 1
    where i < width group by 1, 2, 3""",
)
def pad_batches(spark, folder):
    _, encoded = encoded_orders(spark, folder)
    framed = vocabulary.frame_sequences(encoded, 10, with_sos=True)
    made = samples.padded_batches(framed, 32, 10)
    return made.select("seq_id", "batch", "width", F.array_join("ids", " ").alias("ids"))


@query(
    "premade_sessions",
    "with " + ORDER_VOCAB + """,
    ln as (select seq_id from oe group by 1)
    select ln.seq_id, cast(i as bigint) as pos, cast(coalesce(oe.idx, 0) as bigint) as idx, cast(case when oe.idx is null then -1 else (oe.idx - 1) * 10 end as double) as vector
    from ln cross join (select unnest(generate_series(0, 5)) as i) t left join oe on oe.seq_id = ln.seq_id and oe.pos = i""",
)
def premade_sessions(spark, folder):
    """Sequences stored as numbers in text, cut or padded to 6, with a vector per number and -1 for the padding."""
    _, encoded = encoded_orders(spark, folder)
    packed = sequences.to_arrays(encoded, ["idx"], 6).select("seq_id", F.array_join("idx", " ").alias("text"))
    numbers = F.split("text", " ").cast("array<bigint>")
    fitted = packed.select("seq_id", F.posexplode(sequences.truncate_or_pad(numbers, 6, F.lit(0).cast("long"))).alias("pos", "idx"))
    vectors = encoded.select("idx").distinct().select("idx", ((F.col("idx") - 1) * 10.0).alias("vector"))
    found = fitted.join(vectors, "idx", "left")
    return found.select("seq_id", F.col("pos").cast("long").alias("pos"), "idx", F.coalesce("vector", F.lit(-1.0)).alias("vector"))


@query(
    "premade_sessions_vectors",
    "with " + ORDER_VOCAB + """,
    ln as (select seq_id from oe group by 1),
    f as (select ln.seq_id, i, coalesce(oe.idx, 0) as idx from ln cross join (select unnest(generate_series(0, 9)) as i) t left join oe on oe.seq_id = ln.seq_id and oe.pos = i),
    c as (select seq_id, idx, count(*) as times from f group by 1, 2)
    select f.seq_id, cast(f.i as bigint) as pos, cast(f.idx as bigint) as idx, cast(c.times as bigint) as times,
           case when f.idx = 0 then -1 else e.embedding[1] end as first_value, case when f.idx = 0 then -1 else e.embedding[len(e.embedding)] end as last_value
    from f join c using (seq_id, idx) left join embeddings e on e.vec_id = f.idx - 1""",
)
def premade_sessions_vectors(spark, folder):
    """Sequences of ten numbers, each with its count in the sequence and its vector of the vector table; -1 for the padding."""
    _, encoded = encoded_orders(spark, folder)
    packed = sequences.to_arrays(encoded, ["idx"], 10).select("seq_id", F.array_join("idx", " ").alias("text"))
    numbers = sequences.truncate_or_pad(F.split("text", " ").cast("array<bigint>"), 10, F.lit(0).cast("long"))
    fitted = packed.select("seq_id", numbers.alias("_n"))
    opened = fitted.select("seq_id", "_n", F.posexplode("_n").alias("pos", "idx"))
    counted = opened.withColumn("times", F.size(F.filter("_n", lambda x: x == F.col("idx"))).cast("long")).drop("_n")
    # Only what is shown of a vector is shuffled.
    ends = [F.try_element_at("embedding", F.lit(i)).alias(name) for i, name in ((1, "first_value"), (-1, "last_value"))]
    vectors = tables.table(spark, folder, "embeddings").select((F.col("vec_id") + 1).alias("idx"), *ends)
    found = lookup_join(counted, vectors, ["idx"], "left", F.col("seq_id"))
    value = lambda x: F.when(F.col("idx") == 0, F.lit(-1.0).cast("float")).otherwise(x)
    return found.select(
        "seq_id", F.col("pos").cast("long").alias("pos"), "idx", "times", value(F.col("first_value")).alias("first_value"), value(F.col("last_value")).alias("last_value")
    )


@query(
    "decode_without_pads",
    "with " + ORDER_VOCAB + """, f as (select * from oe where pos < 5) select seq_id, pos, key from f join (select seq_id, pos, key from oel) k using (seq_id, pos)""",
)
def decode_without_pads(spark, folder):
    """Padded numbers back to keys; the padding is skipped."""
    _, encoded = encoded_orders(spark, folder)
    vocab = written(vocabulary.build_vocabulary(inputs.orders(spark, folder).select("seq_id", "pos", "key")))
    framed = vocabulary.frame_sequences(encoded, 5).select("seq_id", F.posexplode("ids").alias("pos", "idx"))
    decoded = vocabulary.decode(framed.withColumn("pos", F.col("pos").cast("long")), vocab, skip_pad=True)
    return decoded.select("seq_id", "pos", "key")


RESULTS = """
base as (select l_orderkey, l_linestatus as dataset, (year(l_shipdate) - 1992) / 100.0::double as ratio, case when l_orderkey % 2 = 0 then 'valid' else 'test' end as phase,
                case when l_returnflag = 'R' then 1 else 0 end as label, case when l_discount >= 0.05 then 1 else 0 end as p1, case when l_quantity >= 25 then 1 else 0 end as p2 from lineitem),
long as (select *, 'discount' as method, p1 as pred from base union all select *, 'quantity' as method, p2 as pred from base),
lv as (select method, dataset, ratio, phase, 'element' as level, label, pred from long
       union all select method, dataset, ratio, phase, 'sequence', max(label), max(pred) from long group by method, dataset, ratio, phase, l_orderkey),
cc as (select method, dataset, ratio, phase, level, count(*) filter (label = 1 and pred = 1) as tp, count(*) filter (label = 0 and pred = 1) as fp,
              count(*) filter (label = 1 and pred = 0) as fn, count(*) filter (label = 0 and pred = 0) as tn from lv group by all),
pr as (select *, case when tp + fp > 0 then 100.0::double * tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then 100.0::double * tp / (tp + fn) else 0 end as r,
              case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) <> 0 then 100 * (tp * tn - fp * fn) / sqrt(cast((tp + fp) as double) * (tp + fn) * (tn + fp) * (tn + fn)) else 0 end as mcc from cc),
res as (select method, dataset, ratio, phase, level, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1, mcc from pr)"""


def result_table(spark, folder):
    """Result rows of two rules that predict returned lines, per ship year, line status, pass and level."""
    lines = tables.table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linestatus").alias("dataset"), ((F.year("l_shipdate") - 1992) / 100.0).alias("ratio"),
        F.when(F.col("l_orderkey") % 2 == 0, "valid").otherwise("test").alias("phase"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_discount") >= 0.05).cast("int").alias("discount"), (F.col("l_quantity") >= 25).cast("int").alias("quantity"),
    )
    keys, methods = ["dataset", "ratio", "phase"], ["discount", "quantity"]
    cells = [("TP", 1, 1), ("FP", 0, 1), ("FN", 1, 0), ("TN", 0, 0)]

    def hits(m, y, p):
        return F.count(F.when((F.col("label") == y) & (F.col(m) == p), 1))

    # Both rules and both levels from one pass: a row per order and group holds its counts, a row per group all of them.
    by_order = lines.groupBy(*keys, "l_orderkey").agg(
        F.max("label").alias("label"), *[F.max(m).alias(m) for m in methods],
        *[hits(m, y, p).alias(f"{m}_{name}") for m in methods for name, y, p in cells],
    )
    wide = by_order.groupBy(*keys).agg(
        *[F.sum(f"{m}_{name}").alias(f"{m}_element_{name}") for m in methods for name, _, _ in cells],
        *[hits(m, y, p).alias(f"{m}_sequence_{name}") for m in methods for name, y, p in cells],
    )
    counts = wide.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.lit(level).alias("level"), *[F.col(f"{m}_{level}_{name}").alias(name) for name, _, _ in cells])
        for m in methods for level in ("element", "sequence")
    ])).alias("c")).select(*keys, "c.*")
    measures = evaluate.rates(F.col("TP"), F.col("FP"), F.col("TN"), F.col("FN"))
    return counts.select("method", *keys, "level", measures["F1"].alias("f1"), measures["MCC"].alias("mcc"))


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("results_test_phase", "with " + RESULTS + " select method, dataset, round(ratio, 6) as ratio, level, round(f1, 6) as f1, round(mcc, 6) as mcc from res where phase = 'test'")
def results_test_phase(spark, folder):
    return rounded(result_table(spark, folder).filter(F.col("phase") == "test").drop("phase"))


_SIDES = ", ".join(
    f"round(max({agg}) filter (level = '{lv}'), 6) as {lv}_{m}_{k}"
    for lv in ("element", "sequence") for m in ("f1", "mcc")
    for k, agg in (("min", f"{m}_min"), ("max", f"{m}_max"), ("mean", f"{m}_mean"))
)


@query(
    "perf_table",
    "with " + RESULTS + """,
    a as (select method, dataset, level, arg_min(f1, ratio) as f1_min, arg_max(f1, ratio) as f1_max, avg(f1) as f1_mean,
                 arg_min(mcc, ratio) as mcc_min, arg_max(mcc, ratio) as mcc_max, avg(mcc) as mcc_mean from res where phase = 'test' group by all)
    select method, dataset, """ + _SIDES + " from a group by 1, 2",
)
def perf_table(spark, folder):
    tested = result_table(spark, folder).filter(F.col("phase") == "test")
    return rounded(reports.performance_table(tested, ["f1", "mcc"], ["element", "sequence"]))


@query("mean_table", "with " + RESULTS + " select method, level, round(avg(f1), 6) as f1, round(avg(mcc), 6) as mcc from res where phase = 'test' group by 1, 2")
def mean_table(spark, folder):
    tested = result_table(spark, folder).filter(F.col("phase") == "test")
    return rounded(reports.mean_table(tested, ["f1", "mcc"], ["method", "level"]))


@query(
    "config_compare",
    "with " + RESULTS + """,
    t as (select * from res where phase = 'test' and level = 'element')
    select a.dataset, round(a.ratio, 6) as ratio, round(a.f1, 6) as f1_a, round(a.mcc, 6) as mcc_a, round(b.f1, 6) as f1_b, round(b.mcc, 6) as mcc_b,
           round(b.f1 - a.f1, 6) as f1_diff, round(b.mcc - a.mcc, 6) as mcc_diff
    from t a join t b on a.dataset = b.dataset and a.ratio = b.ratio and a.method = 'discount' and b.method = 'quantity'""",
)
def config_compare(spark, folder):
    tested = written(result_table(spark, folder).filter((F.col("phase") == "test") & (F.col("level") == "element")))
    made = reports.compare(
        tested.filter(F.col("method") == "discount"), tested.filter(F.col("method") == "quantity"), ["dataset", "ratio"], ["f1", "mcc"]
    )
    return rounded(made)


@query("percent_columns", "with " + RESULTS + " select method, dataset, phase, level, round(ratio * 100, 2) as ratio, round(f1, 6) as f1, round(mcc, 6) as mcc from res")
def percent_columns(spark, folder):
    return rounded(reports.as_percent(result_table(spark, folder), ["ratio"]))


@query(
    "resume_pending",
    "with " + RESULTS + """,
    d as (select ratio from res where method = 'discount' and level = 'element' and mcc > 0 group by 1 having count(*) >= 2)
    select distinct round(ratio, 6) as ratio from res where ratio not in (select ratio from d)""",
)
def resume_pending(spark, folder):
    results = written(result_table(spark, folder))
    done = results.filter((F.col("method") == "discount") & (F.col("level") == "element") & (F.col("mcc") > 0))
    return rounded(reports.pending(results.select("ratio").distinct(), done))


PARTS = {
    "train": ("train_size", "train_vocab"),
    "normal": ("test_normal_size", "test_normal_vocab"),
    "anomalous": ("test_abnormal_size", "test_abnormal_vocab"),
}


@query(
    "stats_table",
    "with " + SWEEP + ", sc as (select s.step, c.seq_id, c.key, c.cnt, s.part from sweep s join cnts c using (seq_id)), st0 as (with x as (select 1),"
    + STATS_SQL.format(by="step,", src="sc", group="group by step", cast="cast(step as int) as step,", join="join", using="using (step)")
    + """),
    mm as (select 'min' as extreme, ratio_unseen_normal as ratio, * from st0 where ratio_unseen_normal = (select min(ratio_unseen_normal) from st0)
           union all select 'max', ratio_unseen_normal, * from st0 where ratio_unseen_normal = (select max(ratio_unseen_normal) from st0))
    select extreme, ratio, 'train' as part, train_size as sequences, train_vocab as vocabulary from mm
    union all select extreme, ratio, 'normal', test_normal_size, test_normal_vocab from mm
    union all select extreme, ratio, 'anomalous', test_abnormal_size, test_abnormal_vocab from mm""",
)
def stats_table(spark, folder):
    stats = written(instability_sweep_stats(spark, folder))
    return reports.split_extremes(stats, "ratio_unseen_normal", PARTS)


