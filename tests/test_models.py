"""Splits, evaluation, detectors and features against fixtures and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import count_detectors as detect
from strandline.operators import evaluate, features, ml_detectors, splits, vocabulary
from strandline.operators import vector_detectors as vd

SEQS = {0: "aab", 1: "ac", 2: "ab", 3: "abd", 4: "ace", 5: "ab", 6: "az", 7: "yz"}
PART = {**{i: "train" for i in range(4)}, 4: "test_normal", 5: "test_normal", 6: "test_abnormal", 7: "test_abnormal"}


@pytest.fixture(scope="module")
def elements(spark):
    rows = [(s, p, k, PART[s]) for s, keys in SEQS.items() for p, k in enumerate(keys)]
    return spark.createDataFrame(rows, "seq_id long, pos long, key string, part string").cache()


@pytest.fixture(scope="module")
def counts(elements):
    return elements.groupBy("seq_id", "key", "part").agg(F.count(F.lit(1)).alias("cnt")).cache()


def test_vocabulary_fixture(elements):
    vocab = vocabulary.build_vocabulary(elements.filter("part = 'train'"))
    got = {r.key: (r.idx, r.freq) for r in vocab.collect()}
    assert {k: v[0] for k, v in got.items() if k in "abcd"} == {"a": 5, "b": 6, "c": 7, "d": 8} and got["a"][1] == 5
    assert got["<pad>"][0] == 0 and got["<mask>"][0] == 4


def test_split_statistics_fixture(counts):
    r = splits.unseen_statistics(counts).first()
    assert r.ratio_unseen_normal == 0.25 and round(r.ratio_unseen_abnormal, 6) == 0.666667 and r.ratio_unseen_total == 0.5
    assert (r.ratio_unseen_normal_sequences, r.ratio_unseen_abnormal_sequences, r.ratio_unseen_total_sequences) == (0.5, 1.0, 0.75)
    assert r.mean_seq_length == 2.375 and (r.train_vocab, r.test_normal_vocab, r.test_abnormal_vocab, r.total_vocab) == (4, 4, 3, 7)


def test_sweep_order_and_sizes(counts, elements):
    order = {r.seq_id: r.leaves_at for r in splits.removal_order(counts).collect()}
    assert order[3] == 1 and {s for s, p in order.items() if p <= 3} == {1, 3, 4} and sorted(order.values()) == list(range(1, 7))
    parts = elements.select("seq_id", "part").distinct()
    made = splits.instability_sweep(parts, counts, 2).collect()
    for step in (1, 2):
        chosen = [r for r in made if r.step == step]
        assert sum(r.part == "train" for r in chosen) == 4 and len(chosen) == 8
        removed = {s for s, p in order.items() if p <= step}
        assert all(r.part == "test_normal" for r in chosen if r.seq_id in removed)


def test_unseen_score_fixture(counts):
    known = counts.filter("part = 'train'").select("key").distinct()
    got = {r.seq_id: round(r.score, 6) for r in detect.unseen_scores(counts, known).collect()}
    assert (got[4], got[5], got[6], got[7]) == (0.333333, 0, 0.5, 1)


def test_threshold_and_areas_fixture(spark):
    rows = [(s, 0) for s in (0.0, 0.0, 0.25, 0.5)] + [(s, 1) for s in (0.25, 0.5, 1.0)]
    scored = spark.createDataFrame(rows, "score double, label int")
    b = evaluate.best_threshold(scored).first()
    assert (b.thr, b.TP, b.FP, b.TN, b.FN, round(b.MCC, 6)) == (0.001, 3, 2, 2, 0, 54.772256)
    a = evaluate.areas(scored).first()
    assert round(a.AUROC, 6) == 0.833333 and round(a.AUPRC, 6) == 0.822222


def test_areas_of_one_class(spark):
    """An area over a class without rows is NaN, as in the SQL; other groups keep theirs."""
    rows = [("a", 0.5, 1), ("a", 1.0, 1), ("n", 0.0, 0), ("n", 0.5, 0), ("both", 0.0, 0), ("both", 1.0, 1)]
    scored = spark.createDataFrame(rows, "g string, score double, label int")
    got = {r.g: (r.AUROC, r.AUPRC) for r in evaluate.areas(scored, ["g"]).collect()}
    assert math.isnan(got["a"][0]) and got["a"][1] == 1.0 and all(math.isnan(x) for x in got["n"]) and got["both"] == (1.0, 1.0)
    abnormal = scored.filter("g = 'a'").drop("g")
    alone = evaluate.areas(abnormal).first()
    assert math.isnan(alone.AUROC) and alone.AUPRC == 1.0
    keyed = abnormal.withColumn("_all", F.lit(1))
    r = evaluate.result_rows(keyed, evaluate.best_threshold(keyed, by=["_all"]), ["_all"]).first()
    assert (r.thr, r.TP, r.FP, r.TN, r.FN, r.MCC, r.AUPRC, r.samples) == (0.0, 2, 0, 0, 0, 0.0, 1.0, 2) and math.isnan(r.AUROC)
    empty = evaluate.areas(scored.filter("g = 'none'")).first()
    assert empty.AUROC is None and empty.AUPRC is None


def test_confusion_fixture(spark):
    df = spark.createDataFrame(list(zip([1, 1, 1, 0, 0, 0], [1, 0, 1, 1, 0, 0])), "pred int, label int")
    r = evaluate.confusion(df).first()
    assert (r.TP, r.FP, r.FN, r.TN, r.P, r.R, r.F1) == (2, 1, 1, 2, 66.6667, 66.6667, 66.6667)


def test_areas_and_grid_on_random_scores(spark):
    rng = random.Random(4)
    rows = [(round(rng.random() * (1 + 0.3 * y), 2), y) for y in [rng.randrange(2) for _ in range(300)]]
    scored = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    mann_whitney = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert math.isclose(evaluate.areas(scored).first().AUROC, mann_whitney, abs_tol=1e-12)
    for r in evaluate.grid_counts(scored, 0.001, 1000).filter("i % 97 = 0").collect():
        assert r.TP == sum(p >= r.i * 0.001 for p in pos) and r.FP == sum(n >= r.i * 0.001 for n in neg)


def test_exact_quantile(spark):
    values = list(np.random.default_rng(1).normal(size=101).round(2))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for q in (0.0, 0.37, 0.75, 1.0):
        assert math.isclose(evaluate.exact_quantile(df, "v", q).first()["quantile"], np.quantile(values, q), abs_tol=1e-9)


def test_element_roll_up_fixture(spark):
    rows = [(0, i, 0.0, u, 1, 4, 0, float(s)) for i, (s, u) in enumerate([(0, 0), (4, 1), (2, 0)])]
    df = spark.createDataFrame(
        rows, "seq_id long, pos long, num_error double, undetected_tokens long, masked_tokens long, total_logkey long, sphere_flag long, element_anomaly_score double"
    )
    r = detect.roll_up_elements(df).first()
    assert (r.element_anomaly_score, r.undetected_tokens, r.masked_tokens, r.total_logkey) == (2.0, 1, 3, 4)


def test_context_ranks_equal_brute_force(spark):
    rng = random.Random(8)
    seqs = {s: [rng.choice("aaabbcd") for _ in range(12)] for s in range(8)}
    tests = {100: list("abcz"), 101: list("ddaab")}
    frame = lambda d: spark.createDataFrame([(s, p, k) for s, ks in d.items() for p, k in enumerate(ks)], "seq_id long, pos long, key string")
    got = {(r.seq_id, r.pos): r["rank"] for r in detect.ContextRankModel(frame(seqs)).score(frame(tests)).collect()}
    around = lambda ks: [(ks[i - 1] if i else "<sos>", ks[i + 1] if i + 1 < len(ks) else "<eos>", k) for i, k in enumerate(ks)]
    seen = [t for ks in seqs.values() for t in around(ks)]
    keys = sorted({k for _, _, k in seen})
    for s, ks in tests.items():
        for p, (left, right, key) in enumerate(around(ks)):
            place = lambda x: (
                -sum(t == (left, right, x) for t in seen), -sum(t[0] == left and t[2] == x for t in seen), -sum(t[2] == x for t in seen), x,
            )
            ranked = sorted(keys, key=place)
            assert got[(s, p)] == (ranked.index(key) if key in ranked else len(keys))


def cells_of(spark, x):
    rows = [(i, f"k{j:02d}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v]
    return spark.createDataFrame(rows, "seq_id long, key string, value double").repartition(3)


def test_gramian_fixture(spark):
    cells = spark.createDataFrame([(0, "a", 2.0), (0, "b", 1.0), (1, "a", 3.0), (1, "c", 1.0)], "seq_id long, key string, value double")
    m = vd.CountMatrix(cells)
    names = m.key_names
    got = {(names[r.i], names[r.j]): r.value for r in vd.gramian(m.rows(cells), m.size).collect()}
    assert got == {("a", "a"): 13, ("a", "b"): 2, ("a", "c"): 3, ("b", "b"): 1, ("c", "c"): 1}


def test_residual_model_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(2, size=(60, 5)).astype(float)
    x[:, 4] = x[:, 0] + 1
    cells = cells_of(spark, x)
    u, sigma, _ = np.linalg.svd(x.T @ x / len(x))
    k = int(np.argmax(np.cumsum(sigma) / sigma.sum() >= 0.95) + 1)
    residual = ((x - x @ u[:, :k] @ u[:, :k].T) ** 2).sum(axis=1)
    got = {r.seq_id: r.residual for r in vd.ResidualModel(cells).predict(cells).collect()}
    assert np.allclose([got[i] for i in range(60)], residual)


def test_count_sphere_equals_dense(spark):
    x = np.random.default_rng(2).poisson(1.5, size=(40, 6)).astype(float) + np.eye(40, 6)
    x[:, 0] += 1
    distance = np.linalg.norm(x - x.mean(axis=0), axis=1)
    model = vd.CountSphere(cells_of(spark, x), nu=0.25)
    assert math.isclose(model.radius, np.quantile(distance, 0.75), abs_tol=1e-9)
    got = {r.seq_id: r.distance for r in model.predict(cells_of(spark, x)).collect()}
    assert np.allclose([got[i] for i in range(40)], distance)


def test_invariants_found_and_checked(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 6, 80), rng.integers(1, 6, 80)
    x = np.stack([a, 2 * a, b, a + b], axis=1).astype(float)
    model = vd.Invariants(cells_of(spark, x), longest=3)
    assert ("k00 k01", "2 -1") in model.relations()
    rules = spark.createDataFrame([("r", "k00", 2.0), ("r", "k01", -1.0)], "rule string, key string, weight double")
    x[5, 1] += 1
    broken = {r.seq_id for r in vd.broken_invariants(cells_of(spark, x), rules).filter("pred = 1").collect()}
    assert broken == {5}


def test_clusters_separate_directions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (np.eye(3)[i % 3] * 5 + rng.random(3) * 0.3).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "seq_id long, v array<double>")
    placed = vd.Clusters(df, "v", max_distance=0.3, sample=20).predict(df).collect()
    groups = {}
    for r in placed:
        groups.setdefault(r.cluster, set()).add(r.seq_id % 3)
    assert len(placed) == 90 and all(len(g) == 1 for g in groups.values()) and all(r.pred == 0 for r in placed)


def test_isolation_forest_prefers_outliers(spark):
    x = np.random.default_rng(6).poisson(3, size=(120, 4)).astype(float)
    x[0] = [40, 0, 40, 0]
    scores = {r.seq_id: r.score for r in ml_detectors.IsolationForest(cells_of(spark, x), trees=25).predict(cells_of(spark, x)).collect()}
    assert max(scores, key=scores.get) == 0


def test_tfidf_fixture(spark):
    df = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (1, "a", 1), (1, "c", 1)], "seq_id long, key string, cnt long")
    got = {(r.seq_id, r.key): round(r.value, 6) + 0.0 for r in features.CountFeatures(df, idf=True).transform(df).collect()}
    assert got[(0, "b")] == got[(1, "c")] == 0.693147 and abs(got[(0, "a")]) == 0


def test_gramian_of_many_keys_is_summed_by_pair(spark, monkeypatch):
    rng = random.Random(11)
    cells = [(s, f"k{k:02d}", float(rng.randrange(1, 4))) for s in range(60) for k in rng.sample(range(30), 6)]
    df = spark.createDataFrame(cells, "seq_id long, key string, value double").repartition(3)
    matrix = vd.CountMatrix(df)
    rows = matrix.rows(df)
    dense = {(r.i, r.j): r.value for r in vd.gramian(rows, matrix.size).collect()}
    monkeypatch.setattr(vd, "DENSE_KEYS", 4)
    monkeypatch.setattr(vd, "PAIRS", 100)
    assert {(r.i, r.j): r.value for r in vd.gramian(rows, matrix.size).collect()} == dense
