import math
import random
import zlib

import numpy as np
import pytest

from strandline.llm import language_id

SAMPLES = {"aa": "the and of to in is that it was for", "bb": "der die und das ist nicht ein zu mit", "cc": "ελ και το να με για από"}


def sample(seed, n=160):
    rng = random.Random(seed)
    rows = [(0, None, "aa"), (1, "", "bb"), (2, "12 34 !?", "cc"), (None, "the and", None), (3, "\U0001d538\U0001d539", "aa")]
    for i in range(4, n):
        language = rng.choice(list(SAMPLES))
        rows.append((i, " ".join(rng.choice(SAMPLES[language].split()) for _ in range(rng.randrange(3, 60))), language if rng.random() < 0.9 else None))
    return rows + [(n, SAMPLES["aa"] * 5000, "aa"), rows[10], rows[10]]


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, lang string, score int, carried string").repartition(3)


def grams(text, bits=16):
    fold = [c.lower() if c.isalpha() and len(c.lower()) == 1 else (c if c.isalpha() else " ") for c in text]
    codes = np.array([ord(c) + 1 for c in fold], np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for n in language_id.ORDERS:
            for i in range(len(codes) - n + 1):
                total = np.zeros(1, np.uint64)
                for c in codes[i : i + n]:
                    total = total * np.uint64(0x9E3779B97F4A7C15) + c
                out.append(int(language_id.mixed(total + np.uint64(n))[0] >> np.uint64(64 - bits)))
    return out


def brute_force(rows, size=1 << 16):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts, docs = {}, {}
    for i, text, lang in rows:
        if lang is not None and text is not None and not held(i):
            docs[lang] = docs.get(lang, 0) + 1
            table = counts.setdefault(lang, {})
            for g in grams(text):
                table[g] = table.get(g, 0) + 1
    names, total = sorted(counts), sum(docs.values())
    sums = {l: sum(counts[l].values()) + 0.5 * size for l in names}
    out = []
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            out.append((i, held(i), "und", 0.0))
            continue
        found = grams(text)
        logs = [math.log(docs[l] / total) + sum(math.log((counts[l].get(g, 0) + 0.5) / sums[l]) for g in found) for l in names]
        best = max(range(len(names)), key=lambda k: logs[k])
        out.append((i, held(i), names[best], 1 / sum(math.exp(x - logs[best]) for x in logs)))
    return sorted(out, key=repr)


def test_equals_plain_model(spark):
    rows = [r for r in sample(1, 60) if len(r[1] or "") < 5000]
    got = sorted((tuple(r) for r in language_id.report(table_of(spark, rows)).collect()), key=repr)
    expected = brute_force(rows)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert np.allclose([g[3] for g in got], [e[3] for e in expected], atol=1e-9)


def test_held_out_accuracy(spark):
    rows = sample(2)
    truth = {(r[0], r[1]): r[2] for r in rows}
    got = language_id.report(table_of(spark, rows)).join(table_of(spark, rows).select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(truth) and len(got) > 10 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


@pytest.mark.parametrize("rows", [[], [(1, "no labels", None)]])
def test_nothing_to_learn(spark, rows):
    got = language_id.report(table_of(spark, rows)).collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in got] == [(r[0], "und", 0.0) for r in rows]


def test_accepted_keeps_columns(spark):
    table = table_of(spark, sample(3))
    kept = language_id.accepted(table)
    assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {0, 1, 2} and len(ids) > 100


def test_too_many_languages_are_found_before_counting(spark):
    rows = spark.range(language_id.MAX_LANGUAGES + 1).selectExpr("'text' as text", "concat('l', id) as language")
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(rows)
