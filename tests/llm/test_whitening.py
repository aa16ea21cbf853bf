import math
import random

import numpy as np
import pytest

from strandline.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x int, n int"


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in enumerate(vectors)], SCHEMA.replace("float", kind)).repartition(3)


def plain(vectors, k=4):
    """Rows that take part, the fit list and its components, with exact sums and a plain eigenvalue solver."""
    kept = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v):
            kept[i] = tuple(math.floor(256 * float(c)) for c in v)
    fit = sorted(set(kept.values()))
    n, d = len(fit), len(fit[0])
    total = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[(n * x[j] - total[j]) / n for j in range(d)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return kept, n, total, values, values[order], axes[:, order]


def check(got, vectors, close=1e-6):
    kept, n, total, values, e, axes = plain(vectors)
    alive = [c for c in range(len(e)) if e[c] > 1e-12 * e[0]]
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c + 1) for i in kept for c in alive)
    signs = {}
    for r in got:
        x = kept[r.vec_id]
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, total))
        c = r.component - 1
        expected = sum((n * a - s) / n * w for a, s, w in zip(x, total, axes[:, c])) / math.sqrt(e[c])
        if abs(expected) > 1e-3:
            sign = signs.setdefault(c, 1 if expected * r.whitened > 0 else -1)
            assert math.isclose(r.whitened, sign * expected, rel_tol=close, abs_tol=close)
        assert math.isclose(r.explained, e[c] / values.sum(), rel_tol=1e-9)
        assert r.identity_error < 1e-6
    assert len({r.identity_error for r in got}) <= 1


def random_vectors(seed, rows, d, spread):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, d)) * spread
    return [[float(np.float32(c)) for c in row] for row in x]


@pytest.mark.parametrize("seed,d", [(1, 6), (2, 17)])
def test_equals_eigenvectors(spark, seed, d):
    vectors = random_vectors(seed, 150, d, 3.0 ** -np.arange(d))
    check(whitening.report(frame(spark, vectors)).collect(), vectors)


def test_repeated_rows_count_once(spark):
    vectors = random_vectors(5, 40, 5, np.arange(1, 6))
    vectors += [vectors[0]] * 60 + [[c + 1e-7 for c in vectors[1]]]
    check(whitening.report(frame(spark, vectors, "double")).collect(), vectors)


def test_odd_rows_take_no_part(spark):
    vectors = random_vectors(7, 30, 4, np.arange(1, 5))
    vectors += [None, [], [1.0, None, 2.0, 3.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [-0.0, 0.0, -0.001, 0.001]]
    got = whitening.report(frame(spark, vectors)).collect()
    check(got, vectors)
    short = whitening.report(frame(spark, [*vectors, [1.0, 2.0], [3.0]])).collect()
    assert sorted((r.vec_id, r.component, r.deviation) for r in short) == sorted((r.vec_id, r.component, r.deviation) for r in got)


def test_flat_directions_and_large_offsets(spark):
    rng = random.Random(3)
    # Two free directions in six dimensions, around a far centre: the others have no variance and leave.
    vectors = []
    for _ in range(80):
        a, b = rng.randrange(-50, 50), rng.randrange(-9, 9)
        vectors.append([4000.0 + a, 4000.0 - a, 7.0, float(b), float(2 * b), 0.0])
    got = whitening.report(frame(spark, vectors)).collect()
    assert {r.component for r in got} == {1, 2}
    check(got, vectors)


def test_hard_condition(spark):
    """Directions whose variances lie up to twelve orders apart stay orthogonal."""
    rng = np.random.default_rng(9)
    turn, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    x = rng.normal(size=(400, 5)) * np.array([1e5, 1e3, 10.0, 1.0, 0.1])
    vectors = [[float(c) for c in row] for row in x @ turn]
    got = whitening.report(frame(spark, vectors, "double")).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and max(r.identity_error for r in got) < 1e-6
    check(got, vectors, close=1e-4)


def test_empty_and_single(spark):
    assert whitening.report(frame(spark, [])).collect() == []
    assert whitening.report(frame(spark, [None, []])).collect() == []
    assert whitening.report(frame(spark, [[1.0, 2.0]] * 5)).collect() == []
    check(whitening.report(frame(spark, [[1.0], [2.0], [4.0]])).collect(), [[1.0], [2.0], [4.0]])


def test_large_entries(spark):
    vectors = [[1e15, 1.0], [-1e15, 2.0], [3e14, 5.0], [1e19, 0.0]]
    got = whitening.report(frame(spark, vectors, "double")).collect()
    assert {r.vec_id for r in got} == {0, 1, 2}
    assert {r.deviation for r in got} == {None}
