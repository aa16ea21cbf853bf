import hashlib
import random
import zlib
from itertools import groupby

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from strandline.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """Root, and for each node the (before, after) of every level."""
    paths = [[] for _ in nodes]
    level, at = list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for k, a in enumerate(at):
            run = a - a % 3
            paths[k].append(("".join(level[run:a]), "".join(level[a + 1 : run + 3])))
        level = [digest(*level[k : k + 3]) for k in range(0, len(level), 3)]
        at = [a // 3 for a in at]
    return level[0], paths


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf_of(r)))
    groups = [list(g) for _, g in groupby(rows, key=lambda r: r[1])]
    trees = [climb([leaf_of(r) for r in g]) for g in groups]
    root, tops = climb([t[0] for t in trees])
    out = []
    for g, (subroot, paths), top in zip(groups, trees, tops):
        for r, path in zip(g, paths):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            at = leaf_of((*r[:4], r[4].replace("\n", "") if hit and r[4] is not None else r[4]))
            for before, after in path + top:
                at = digest(before, at, after)
            proof = digest("".join(b + a for b, a in path + top))
            out.append((r[0], r[1], leaf_of(r), subroot, root, proof, at, at == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, g int, pos int, h string, path string"


def made(spark, rows):
    return rows_of(merkle.report(spark.createDataFrame([(*r, 1, 2, "h", "p") for r in rows], SCHEMA).repartition(3)))


def texts(rng, n, sources):
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 3]), rng.choice([None, "", "a\nb", "é\n\n日本", "x" * 9, "\n"])) for i in range(n)]


@pytest.mark.parametrize("levels", [7, 2, 1])
def test_equals_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rng = random.Random(levels)
    rows = texts(rng, 60, ["hot"] * 20 + [None, "", "é", "z", "a", "=", "src"])
    rows += [(7, "hot", "en", 3, "again"), (7, "hot", "en", 3, "again"), (None, "hot", None, None, "a\nb"), (None, None, None, None, None)]
    assert made(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", [1, 4, 10, 28])
def test_sizes_of_runs(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = [(i * 3, "s", "en", 1, f"line {i}\nend") for i in range(n)]
    assert made(spark, rows) == plain(rows)
    rows = [(i, f"s{i}", "en", 1, "t") for i in range(n)]
    assert made(spark, rows) == plain(rows)


def test_empty_and_long(spark):
    assert made(spark, []) == []
    rows = [(2, "s", "en", 1, "word\n" * 400_000), (3, "s", None, None, "")]
    assert made(spark, rows) == plain(rows)


def test_only_altered_leaves_fail(spark):
    rows = [(i, f"s{i % 3}", "en", 1, "one\ntwo" if i % 2 else "one two") for i in range(40)]
    got = made(spark, rows)
    for doc_id, *_, verified in got:
        assert verified == (not (zlib.crc32(str(doc_id).encode()) % 2 == 0 and doc_id % 2 == 1))
    assert {r[-1] for r in got} == {True, False}


def test_hot_source_is_dealt_in_blocks(spark, monkeypatch):
    """No window of the leaves holds more rows than a block, and a level adds no exchange."""
    monkeypatch.setattr(merkle, "LEVELS", 3)
    monkeypatch.setattr(merkle, "BLOCK", 27)
    nodes = spark.range(1000).select(F.lit("=hot").alias("g"), F.col("id").alias("pos"), F.lit(1000).cast("long").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    levels = merkle._levels(nodes)
    plan = levels._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1
    sizes = levels.groupBy("block").count().collect()
    assert len(sizes) == 38 and max(r["count"] for r in sizes) == 27
