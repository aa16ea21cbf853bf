"""Learned key vectors on planted roles, and the information table against a plain loop."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandline.operators import features, key_vectors
from strandline.operators.vector_detectors import neighbour_error


def frame(spark, sequences):
    rows = [(s, p, k) for s, keys in enumerate(sequences) for p, k in enumerate(keys)]
    return spark.createDataFrame(rows, "seq_id long, pos long, key string").repartition(3)


def random_sequences(seed, n=30):
    rng = random.Random(seed)
    return [[rng.choice("abcdefg") for _ in range(rng.randrange(1, 20))] for _ in range(n)]


def plain_counts(sequences, reach):
    out = Counter()
    for keys in sequences:
        for i, a in enumerate(keys):
            for j in range(max(i - reach, 0), min(i + reach + 1, len(keys))):
                if i != j:
                    out[a, keys[j]] += 1
    return out


def test_counts_and_information_equal_plain_loop(spark):
    sequences = random_sequences(1)
    counts = key_vectors.neighbour_counts(frame(spark, sequences), 2)
    expected = plain_counts(sequences, 2)
    assert {(r.key, r.other): r.cnt for r in counts.collect()} == expected
    rows, total = Counter(), sum(expected.values())
    for (a, _), c in expected.items():
        rows[a] += c
    value = {k: math.log(c * total / (rows[k[0]] * rows[k[1]])) for k, c in expected.items()}
    got = {(r.key, r.other): r.value for r in key_vectors.positive_information(counts).collect()}
    assert got.keys() == {k for k, v in value.items() if v > 0}
    assert all(math.isclose(got[k], value[k], rel_tol=1e-9) for k in got)


def planted(seed, n=120):
    """Sessions of three steps; each step is one of four keys that differ in name only."""
    rng = random.Random(seed)
    return [[f"{role}{rng.randrange(4)}" for _ in range(5) for role in ("open", "read", "close")] for _ in range(n)]


def test_keys_of_a_role_lie_together(spark):
    vectors = key_vectors.learned_vectors(frame(spark, planted(2)), 1, rank=6)
    table = {}
    for r in vectors.collect():
        table.setdefault(r.key, np.zeros(6))[r.dim] = r.value
    assert len(table) == 12
    unit = {k: v / np.linalg.norm(v) for k, v in table.items()}
    same = [unit[a] @ unit[b] for a in unit for b in unit if a < b and a[:-1] == b[:-1]]
    other = [unit[a] @ unit[b] for a in unit for b in unit if a < b and a[:-1] != b[:-1]]
    assert min(same) > max(other)


def test_unseen_keys_keep_their_hashed_vector(spark):
    elements = frame(spark, planted(3, 40))
    asked = frame(spark, [["open1", "read2", "fresh9", "close0"]])
    keys = elements.select("key").unionByName(asked.select("key"))
    hashed = features.hashed_vectors(keys, F.split("key", "[0-9]"), 1)
    both = key_vectors.beside(hashed, key_vectors.learned_vectors(elements, 1, rank=4), 16)
    dense = features.dense_vectors(both, 20)
    scored = neighbour_error(asked, dense, 20, 1).collect()
    assert len(scored) == 4 and all(math.isfinite(r.error) for r in scored)
    fresh = dense.where("key = 'fresh9'").first()
    assert [fresh[f"v{i}"] for i in range(16, 20)] == [0.0] * 4 and any(fresh[f"v{i}"] for i in range(16))


def test_no_pairs(spark):
    assert key_vectors.learned_vectors(frame(spark, [["a"], ["b"]]), 2).collect() == []
