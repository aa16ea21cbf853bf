"""The range finder against numpy on low-rank, full and wide tables."""

import numpy as np
import pytest

from strandline.operators.subspaces import RangeModel
from strandline.operators.vector_detectors import ResidualModel


def cells_of(spark, x):
    rows = [(f"s{i}", f"k{j:05d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, "seq_id string, key string, value double").repartition(4)


def residuals(x, fit, k):
    _, _, axes = np.linalg.svd(fit, full_matrices=False)
    left = x - (x @ axes[:k].T) @ axes[:k]
    return {f"s{i}": r for i, r in enumerate((left * left).sum(axis=1)) if x[i].any()}


def test_low_rank_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.poisson(3, (90, 6)).astype(float) @ rng.poisson(1, (6, 70)).astype(float)
    model = RangeModel(cells_of(spark, x), 6, block=8, rounds=2)
    assert len(model.values) == 6 and model.share == pytest.approx(1.0, abs=1e-9)
    noisy = x + (rng.random(x.shape) < 0.05)
    got = {r.seq_id: r.residual for r in model.predict(cells_of(spark, noisy)).collect()}
    expected = residuals(noisy, x, 6)
    assert got.keys() == expected.keys()
    assert all(abs(got[s] - expected[s]) <= 1e-6 * max(1.0, expected[s]) for s in got)


def test_full_block_equals_the_dense_model(spark):
    rng = np.random.default_rng(2)
    x = rng.poisson(1.2, (80, 12)).astype(float) * np.arange(1, 13)
    cells = cells_of(spark, x)
    ours, dense = RangeModel(cells, 0.9), ResidualModel(cells, 0.9)
    assert ours.k == dense.k and ours.threshold == pytest.approx(dense.threshold, rel=1e-6)
    a = {r.seq_id: (r.residual, r.pred) for r in ours.predict(cells).collect()}
    b = {r.seq_id: (r.residual, r.pred) for r in dense.predict(cells).collect()}
    assert a.keys() == b.keys()
    for s in a:
        assert a[s][0] == pytest.approx(b[s][0], abs=1e-6) and a[s][1] == b[s][1]


def test_block_grows_until_the_share_is_reached(spark):
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(60, 40)))
    model = RangeModel(cells_of(spark, x), 0.97, block=4, rounds=2)
    values = np.linalg.svd(x, compute_uv=False) ** 2 / 60
    assert model.k == int(np.searchsorted(np.cumsum(values) / values.sum(), 0.97) + 1)


def test_many_keys_need_no_square_matrix(spark):
    """Twenty thousand keys: rank three, each key with one of three weights."""
    rng = np.random.default_rng(4)
    parts = [[(f"s{i}", f"k{j:05d}", float((i % 3 == j % 3) * (1 + i % 5))) for j in range(i, 20_000, 40)] for i in range(40)]
    rows = [c for part in parts for c in part if c[2]]
    cells = spark.createDataFrame(rows, "seq_id string, key string, value double")
    model = RangeModel(cells, 40, rounds=1)
    assert model.size == len({r[1] for r in rows}) > 6000
    scored = model.predict(cells).collect()
    assert max(r.residual for r in scored) < 1e-6 and len(scored) == len({r[0] for r in rows})
    unknown = spark.createDataFrame([("n", "never", 3.0)], "seq_id string, key string, value double")
    assert [(r.seq_id, r.residual) for r in model.predict(unknown).collect()] == [("n", 0.0)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "seq_id string, key string, value double")
    model = RangeModel(none)
    assert model.k == 0 and model.predict(none).collect() == []
