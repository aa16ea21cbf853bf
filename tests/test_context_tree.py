"""The tree of contexts against a plain loop, and its size on a chain that needs one key only."""

import math
import random
from collections import Counter

import pytest

from strandline.operators.context_tree import ContextTree
from strandline.operators.count_detectors import NextEventModel

WIDTH = 3


def frame(spark, rows):
    return spark.createDataFrame([(f"s{i % 5}", i, list(c), k) for i, (c, k) in enumerate(rows)], "seq_id string, start long, context array<string>, next_key string").repartition(3)


def plain(rows, least, worth):
    counts = [{} for _ in range(WIDTH + 1)]
    for n in range(WIDTH + 1):
        for context, key in rows:
            if n and context[WIDTH - n + 1 :] not in counts[n - 1]:
                continue
            counts[n].setdefault(context[WIDTH - n :], Counter())[key] += 1
        if n:
            counts[n] = {s: c for s, c in counts[n].items() if sum(c.values()) >= least}
    kept, gains = {(0, ()): 0.0}, {}
    for n in range(WIDTH, 0, -1):
        for s, c in counts[n].items():
            shorter, total = counts[n - 1][s[1:]], sum(c.values())
            gains[n, s] = sum(v * math.log(v / total / (shorter[k] / sum(shorter.values()))) for k, v in c.items())
            held = n < WIDTH and any((n + 1, t) in kept and t[1:] == s for t in counts[n + 1])
            if gains[n, s] >= worth or held:
                kept[n, s] = gains[n, s]
    return kept, counts


def random_rows(seed, n=400):
    rng = random.Random(seed)
    keys = "abcd"
    rows = []
    for _ in range(n):
        c = tuple(rng.choice(keys) for _ in range(WIDTH))
        rows.append((c, c[0] if c[2] == "a" and c[1] == "b" else "d" if c[2] == "c" else rng.choice(keys)))
    return rows


@pytest.mark.parametrize("least,worth", [(2, 2.0), (5, 4.0), (1, 0.5)])
def test_nodes_and_flags_equal_plain_loop(spark, least, worth):
    rows, asked = random_rows(1), random_rows(2, 120) + [(("x", "y", "z"), "a")]
    tree = ContextTree(frame(spark, rows), WIDTH, 2, least, worth)
    kept, counts = plain(rows, least, worth)
    got = {(r.order, tuple(r.suffix.split())): r.gain for r in tree.nodes.collect()}
    assert got.keys() == kept.keys() and all(math.isclose(got[k], kept[k], abs_tol=1e-9) for k in got)
    flags = {r.start: (r.flag, r["first"]) for r in tree.flag(frame(spark, asked)).collect()}
    for i, (context, key) in enumerate(asked):
        n = max(n for n in range(WIDTH + 1) if (n, context[WIDTH - n :]) in kept)
        top = [k for k, _ in sorted(counts[n][context[WIDTH - n :]].items(), key=lambda kv: (-kv[1], kv[0]))[:2]]
        assert flags[i] == (int(key not in top), int(top[0] == key))


def test_smaller_than_the_full_table_at_equal_misses(spark):
    rng = random.Random(4)
    follows = {"a": "bc", "b": "cd", "c": "da", "d": "ab"}

    def chain(n):
        at, out = "a", []
        for _ in range(n + WIDTH):
            out.append(at)
            at = rng.choice(follows[at])
        return [(tuple(out[i : i + WIDTH]), out[i + WIDTH]) for i in range(n)]

    rows, asked = chain(2000), chain(300)
    asked = [(c, k if i % 10 else "never") for i, (c, k) in enumerate(asked)]
    tree, full = ContextTree(frame(spark, rows), WIDTH, 2, 2, 12.0), NextEventModel(frame(spark, rows), WIDTH, 2)
    assert tree.candidates.count() == 5 < full.candidates.count()
    misses = lambda m: {r.start for r in m.flag(frame(spark, asked)).collect() if r.flag}
    assert misses(tree) == misses(full) == set(range(0, 300, 10))
