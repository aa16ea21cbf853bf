import math
import random

import pytest
from conftest import rows_of

from strandline.llm import kd_search


def brute_force(rows, k=20, every=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(good):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(good) if m != n and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def sample(seed, n, d=6):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    # Multiples of 1/64 are exact as 32-bit floats, so that both sides read the same numbers.
    vector = lambda: [round((c + rng.gauss(0, 0.3)) * 64) / 64 + rng.choice([0, 1 / 128]) for c in rng.choice(centre)]
    rows = [(i, vector()) for i in range(n)]
    rows += [(n + i, [0.5] * d) for i in range(40)]
    rows += [(20, vector()), (40, [0.5] * d), (None, vector()), (60, None), (80, [float("nan")] * d), (100, [None, *vector()[1:]]), (120, []), (140, [float("inf")] * d)]
    return rows + [(160, [1.0, 2.0]), (161, [0.5, 0.25])]


@pytest.mark.parametrize("seed,n,options", [(1, 300, {}), (2, 600, {"shard": 50, "block": 4}), (3, 15, {"k": 30}), (4, 500, {"shard": 30, "every": 7, "k": 3})])
def test_equals_full_scan(spark, seed, n, options):
    rows = sample(seed, n)
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, label int, row int").repartition(4)
    expected = brute_force(rows, options.get("k", 20), options.get("every", 20))
    assert rows_of(kd_search.top_k(table, **options)) == expected


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**31 + 7 * i), float(-(2**31) + i)]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception):  # noqa: B017  the sums leave 64 bits
        kd_search.top_k(table).collect()
    rows = [(i, [float(2**24 + 7 * i), float(-(2**24) + i)]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert rows_of(kd_search.top_k(table)) == brute_force(rows)


def test_empty_table(spark):
    assert rows_of(kd_search.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))) == []
