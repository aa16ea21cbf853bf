import hashlib
import random
import re
import zlib
from itertools import combinations

import pytest
from conftest import rows_of

from strandline.llm import simhash


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


def fingerprint(text):
    """Votes of a text's terms, counted one by one."""
    codes = [zlib.crc32(w.encode()) for w in words(text)]
    votes, n = [0] * simhash.BITS, max(len(codes) - simhash.WORDS, 0) + 1
    for at in range(n):
        for p in range(simhash.PARTS):
            h = sum(c * simhash.factor(p, j) for j, c in enumerate(codes[at : at + simhash.WORDS])) % simhash.PRIME
            g = ((h + simhash.factor(p, -1)) * h % simhash.PRIME) & simhash.PART
            for i in range(simhash.PART_BITS):
                votes[p * simhash.PART_BITS + i] += g >> i & 1
    return sum(1 << i for i, v in enumerate(votes) if 2 * v > n)


def shown(f):
    low = (1 << simhash.HALF) - 1
    return f"{f & low:015x}{f >> simhash.HALF:015x}"


def likeness(a, b):
    return 1.0 - (a ^ b).bit_count() / simhash.BITS


def group(prints, radius):
    """The smallest index of each fingerprint's class, by all pairs."""
    root = list(range(len(prints)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return [top(a) for a in range(len(prints))]


def plain(rows, radius=simhash.RADIUS):
    texts = [(i, t or "") for i, t in rows]
    order = sorted(set(texts), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    prints = [fingerprint(t) for _, t in order]
    tops = group(prints, radius)
    known = {}
    for k, (doc_id, text) in enumerate(order):
        n, after = len(text), order[(k + 1) % len(order)][1]
        edited = text[: n - n // 4] + after[: n // 4]
        e = fingerprint(edited)
        ids = [order[j][0] for j in range(len(order)) if tops[j] == tops[k] and order[j][0] is not None]
        known[doc_id, text] = (
            doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), shown(prints[k]), shown(e), likeness(prints[k], e),
            likeness(prints[k], prints[(k + 1) % len(order)]), min(ids, default=None),
        )
    return sorted([known[r] for r in texts], key=repr)


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta é日本 zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))


def test_equals_counting(spark, documents):
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.choice([0, 1, 4, 5, 6, 30, 80]))) for i in range(40)]
    base = sentence(rng, 300)
    rows += [(100 + i, base.replace(f"{i} ", f"{i}x ", 1)) for i in range(12)]
    rows += [(60, None), (61, ""), (62, " \t\n\x0b\f\r"), (63, "\n a  b c \x1f d"), (None, "no id"), (None, None), (100, base), (100, base), (5, "again")]
    assert rows_of(simhash.report(documents(rows))) == plain(rows)


def test_empty_and_single(spark, documents):
    assert simhash.report(documents([])).collect() == []
    assert rows_of(simhash.report(documents([(3, "just one text of seven words here")]))) == plain([(3, "just one text of seven words here")])


def test_long_text_is_read_whole(spark, documents):
    rng = random.Random(1)
    long = sentence(rng, 6_000)
    rows = [(1, long), (2, long + " tail"), (3, "word " * 20_000)]
    assert rows_of(simhash.report(documents(rows))) == plain(rows)


@pytest.mark.parametrize("radius,blocks", [(3, 4), (5, 7), (1, 4)])
def test_classes_equal_all_pairs(spark, tmp_path, radius, blocks):
    """Dense balls, chains and strangers; joined groups by as many rows as they have members."""
    rng = random.Random(radius)
    prints = {rng.getrandbits(simhash.BITS) for _ in range(60)}
    for _ in range(3):
        centre = rng.getrandbits(simhash.BITS)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(simhash.BITS), rng.randrange(radius + 3))) for _ in range(60)}
        at = centre ^ ((1 << 40) - 1)
        for _ in range(20):
            at ^= sum(1 << b for b in rng.sample(range(simhash.BITS), radius))
            prints.add(at)
    prints = sorted(prints)
    low = (1 << simhash.HALF) - 1
    marks = spark.createDataFrame([(k, f & low, f >> simhash.HALF) for k, f in enumerate(prints)], "id bigint, f0 bigint, f1 bigint").repartition(4)
    got = {r.v: r.root for r in simhash.classes(marks, simhash.Shared(spark), radius, blocks).collect()}
    expected = group(prints, radius)
    sizes = {k: expected.count(t) for k, t in enumerate(expected)}
    assert got == {k: t for k, t in enumerate(expected) if sizes[k] > 1}


def test_dense_ball_makes_few_rows(spark):
    """A ball of 500 fingerprints around one centre: rows of the search stay linear in its members."""
    rng = random.Random(8)
    centre = rng.getrandbits(simhash.BITS)
    prints = sorted({centre} | {centre ^ (1 << a) ^ (1 << b) for a, b in (rng.sample(range(simhash.BITS), 2) for _ in range(500))})
    low = (1 << simhash.HALF) - 1
    marks = spark.createDataFrame([(k, f & low, f >> simhash.HALF) for k, f in enumerate(prints)], "id bigint, f0 bigint, f1 bigint")
    seen = {}

    class Watched(simhash.Shared):
        def write(self, df, name):
            made = super().write(df, name)
            seen[name] = made.count()
            return made

    roots = simhash.classes(marks, Watched(spark), 5, 7).collect()
    assert len(roots) == len(prints) and {r.root for r in roots} == {0}
    assert seen["left"] == 0 and seen["led"] <= 21 * len(prints)


def test_native(spark, documents):
    rows = simhash.report(documents([(1, "a b c d e f g"), (2, "h i j k l m n")]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
