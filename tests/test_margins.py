"""The sparse machine against a plain solver, and the Fourier machine on shapes a sphere cannot tell."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators.margins import FourierMargin, SparseMargin
from strandline.operators.vector_detectors import CountSphere


def cells_of(spark, x):
    rows = [(i, f"k{j:03d}", float(x[i, j])) for i in range(len(x)) for j in range(x.shape[1]) if x[i, j]]
    return spark.createDataFrame(rows, "seq_id long, key string, value double").repartition(4)


def labels_of(spark, y):
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "seq_id long, label long")


def objective(x, y, w, b, c):
    slack = np.maximum(1 - y * (x @ w + b), 0)
    return np.abs(w).sum() + abs(b) + c * (slack @ slack)


def plain(x, y, c, rounds=60_000):
    """Accelerated proximal gradient with a fixed step."""
    z = np.hstack([x, np.ones((len(x), 1))])
    step = 1 / (2 * c * np.linalg.norm(z, 2) ** 2)
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(rounds):
        g = -2 * c * z.T @ (y * np.maximum(1 - y * (z @ v), 0))
        to = v - step * g
        fresh = np.sign(to) * np.maximum(np.abs(to) - step, 0)
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = fresh + (t - 1) / s * (fresh - w), fresh, s
    return w


@pytest.mark.parametrize("c,working", [(1.0, 512), (0.05, 512), (1.0, 8)])
def test_sparse_margin_reaches_the_optimum(spark, c, working):
    rng = np.random.default_rng(3)
    x = rng.poisson(1.0, (120, 15)).astype(float)
    y = np.where(x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=120) > 0, 1.0, -1.0)
    model = SparseMargin(cells_of(spark, x), labels_of(spark, y > 0), c=c, working=working)
    best = plain(x, y, c)
    reached = objective(x, y, model.weights[:-1], model.weights[-1], c)
    assert reached == pytest.approx(model.objective, rel=1e-9)
    assert reached <= objective(x, y, best[:-1], best[-1], c) * (1 + 1e-4)
    table = {r.key: r.weight for r in model.weight_table().collect()}
    assert len(table) == 15 and (c == 1.0 or any(v == 0 for v in table.values()))
    got = {r.seq_id: (r.margin, r.pred) for r in model.predict(cells_of(spark, x)).collect()}
    for i, (margin, pred) in got.items():
        assert margin == pytest.approx(x[i] @ model.weights[:-1] + model.weights[-1], abs=1e-9) and pred == int(margin > 0)


def test_sparse_margin_odd_inputs(spark):
    x = np.array([[1.0, 0], [2.0, 0], [0, 3.0]])
    model = SparseMargin(cells_of(spark, x), labels_of(spark, [1, 1, 1]))
    assert {r.pred for r in model.predict(cells_of(spark, x)).collect()} == {1}
    unknown = spark.createDataFrame([(9, "never", 4.0)], "seq_id long, key string, value double")
    assert model.predict(unknown).first().margin == pytest.approx(model.weights[-1])


def ring(spark, n=300):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        a = rng.random() * 2 * math.pi
        rows += [(i, "x", 5 * math.cos(a) + rng.gauss(0, 0.1)), (i, "y", 5 * math.sin(a) + rng.gauss(0, 0.1))]
    return spark.createDataFrame(rows, "seq_id long, key string, value double").repartition(4)


def test_share_outside_is_nu(spark):
    cells = ring(spark)
    for nu in (0.5, 0.2):
        model = FourierMargin(cells, nu=nu, gamma=0.2, features=128, passes=4)
        assert model.predict(cells).agg(F.avg("pred")).first()[0] == pytest.approx(nu, abs=0.02)


def test_ring_is_told_from_its_centre(spark):
    cells = ring(spark)
    model = FourierMargin(cells, nu=0.1, gamma=0.2, features=512, passes=8)
    inner = [(k, key, 0.3 * k - 0.6) for k in range(5) for key in ("x", "y")]
    inside = spark.createDataFrame(inner, "seq_id long, key string, value double")
    assert {r.pred for r in model.predict(inside).collect()} == {1}
    sphere = CountSphere(cells, nu=0.1)
    assert {r.pred for r in sphere.predict(inside).collect()} == {0}


def test_shorter_mean_at_every_pass(spark):
    cells = ring(spark, 120)
    lengths = [float(np.linalg.norm(FourierMargin(cells, nu=0.5, gamma=0.2, features=64, passes=p).weights)) for p in (0, 2, 6)]
    assert lengths == sorted(lengths, reverse=True)
