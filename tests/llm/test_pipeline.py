"""The pipeline against a plain version of its stages, and each stage's columns."""

import hashlib
import random

import numpy as np
import test_decontaminate
import test_language_id
import test_ngram_join
from conftest import rows_of
from tokenizers import Tokenizer

import corpus_pipeline
from strandline.llm.catalog import vocabulary

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sample(seed):
    rng = random.Random(seed)
    speech = {"en": "the and of to in is that it was for on with".split(), "de": "der die und das ist nicht ein zu mit von für größe".split()}
    phrase = lambda lang, n: " ".join(rng.choice(speech[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n))
    items = [(i, phrase("en", n)) for i, n in ((1, 13), (2, 25), (3, 6))]
    shared = phrase("de", 60)
    rows = [(0, None, "en"), (1, "", "de"), (2, "123 !!", "en"), (3, "the end", None)]
    for i in range(4, 70):
        lang = rng.choice(["en", "de"])
        text = phrase(lang, rng.randrange(20, 120))
        if i % 9 == 0:
            text += " " + shared + " " + phrase(lang, 10)
        if i % 11 == 0:
            text = items[i % 2][1] + " " + text[:300]
        rows.append((i, text, lang))
    for i in range(70, 90):
        words = rows[4 + i % 7][1].split()
        words[rng.randrange(len(words))] = "und"
        rows.append((i, " ".join(words), "de"))
    rows += [rows[10], (90, rows[11][1], "en")]
    rng.shuffle(rows)
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], items


def cut_repeats(docs, length=200):
    """Plain removal of repeated byte strings, at whole characters."""
    texts = [(r[1] or "").encode() for r in docs]
    places = {}
    for i, text in enumerate(texts):
        for p in range(len(text) - length + 1):
            places.setdefault(text[p : p + length], []).append((i, p))
    cover = [bytearray(len(t)) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                cover[i][p : p + length] = b"\x01" * length
    out = []
    for row, marks in zip(docs, cover):
        text, at = "", 0
        for c in row[1] or "":
            size = len(c.encode())
            text += "" if all(marks[at : at + size]) else c
            at += size
        out.append((row[0], None if row[1] is None else text, *row[2:4], None if row[1] is None else len(text)))
    return out


def plain(docs, items):
    judged = test_language_id.brute_force([(r[0], r[1], r[2]) for r in docs])
    good = {r[0] for r in judged if r[2] != "und" and r[3] >= 0.5}
    docs = [r for r in docs if r[0] in good]
    roots = {r[2] for r in test_ngram_join.brute_force([r[:2] for r in docs], 5, 80)}
    docs = sorted({r for r in docs if r[0] in roots})
    docs = cut_repeats(docs)
    bad = {r[0] for r in test_decontaminate.brute_force([r[:2] for r in docs], items) if r[5]}
    library, out = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), []
    for r in docs:
        if r[0] not in bad:
            ids = library.encode(r[1], add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            out.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_equals_plain_stages(spark, tmp_path):
    docs, items = sample(1)
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = plain(docs, items)
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path))) == expected
    assert 20 < len(expected) < len(docs) - 10


def test_stages_keep_the_columns(spark, tmp_path):
    docs, items = sample(2)
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.createDataFrame([(*r, "x") for r in docs], COLUMNS + ", tokens string").repartition(2)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, table, str(tmp_path))
        assert made.schema.simpleString() == table.schema.simpleString()
        assert 0 < made.count() <= table.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0


def test_near_copies_of_other_lengths(spark):
    """Copies with words added at an end or inside or left out, and additions to texts that have many copies."""
    docs, _ = sample(3)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for k, words in enumerate(1 + rng.randrange(15, 80) for _ in range(60)):
        base = [word() for _ in range(words)]
        few = max(1, (words - 4) // 12)
        where = [words, 0, rng.randrange(words)][k % 3]
        texts += [base, base[:where] + [word() for _ in range(few)] + base[where:], base[few // 2 : words - (few + 1) // 2]]
    for words, few in ((44, 5), (64, 6), (104, 14)):
        base = [word() for _ in range(words)]
        texts += [base] * 40 + [base + [word() for _ in range(few)]]
    docs += [(200 + k, t, "en", "s", len(t)) for k, t in enumerate(map(" ".join, texts))]
    roots = {r[2] for r in test_ngram_join.brute_force([r[:2] for r in docs], 5, 80)}
    table = spark.createDataFrame(docs, COLUMNS).repartition(2)
    kept = corpus_pipeline.without_near_copies(spark, table, "")
    assert {r.doc_id for r in kept.collect()} == roots
    assert len(roots) < len(docs) // 2
