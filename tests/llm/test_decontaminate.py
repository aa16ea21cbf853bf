import hashlib
import random
import re

import pytest
from conftest import rows_of  # noqa: F401  (pytest puts this folder on the path)

from strandline.llm import decontaminate


def brute_force(docs, items, window=13):
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    split = lambda t: pattern.findall((t or "").encode().translate(lower))
    out = []
    for doc_id, text in docs:
        words, hit, names = split(text), set(), set()
        for item_id, item in items:
            tokens = split(item)
            n = min(window, len(tokens))
            windows = {tuple(tokens[k : k + n]) for k in range(len(tokens) - n + 1)} if n else set()
            for k in range(len(words) - n + 1):
                if n and tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


def sample(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "cé", "d1", "e", "Ff", "ß", "x9"]
    phrase = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, phrase(rng.choice([1, 2, 5, 13, 14, 30]))) for i in range(2, 14)] + [(100, None), (101, "..."), (102, "")]
    docs = [(0, None), (1, ""), (2, "!?"), (None, "a b")]
    for i in range(3, 60):
        parts = [phrase(rng.randrange(1, 200))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(2), (rng.choice(items[:12])[1] or "").upper())
        docs.append((i, " zz ".join(parts)))
    docs += [docs[10], docs[10], (61, phrase(30000) + " " + items[3][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_search(spark, documents, seed):
    docs, items = sample(seed)
    benchmark = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id bigint, text string, n_words int")
    got = rows_of(decontaminate.report(documents(docs), benchmark))
    assert got == brute_force(docs, items)


def test_item_blocks_give_the_same(spark, documents):
    docs, items = sample(3)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows_of(decontaminate.report(documents(docs), benchmark, item_bytes=60)) == brute_force(docs, items)


def test_empty_tables(spark, documents):
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert rows_of(decontaminate.report(documents([]), benchmark)) == []
    docs = [(1, "some words"), (2, None)]
    assert rows_of(decontaminate.report(documents(docs), benchmark)) == brute_force(docs, [])


def test_clean_keeps_columns(spark, documents):
    docs, items = sample(4)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    table = documents(docs)
    left = decontaminate.clean(table, benchmark)
    assert left.columns == table.columns
    bad = {r[0] for r in brute_force(docs, items) if r[5]}
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id is not None) == sorted(d for d in docs if d[0] is not None and d[0] not in bad)
