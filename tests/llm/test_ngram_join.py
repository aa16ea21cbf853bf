import os
import random
import re
from pathlib import Path

import numpy as np
import pytest
from conftest import rows_of

from strandline.llm import ngram_join


def brute_force(docs, n=4, percent=85):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, text in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lower))
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def sample(seed, families=6, copies=14):
    rng = random.Random(seed)
    word = lambda: rng.choice(["", "X"]) + "".join(rng.choice("abcdeé") for _ in range(3))
    passage = [word() for _ in range(20)]
    docs = [(0, None), (1, ""), (2, " \n "), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, "p q r s"), (7, "P q\tr s")]
    at = 10
    for _ in range(families):
        base = [word() for _ in range(rng.choice([5, 30, 80, 300]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 6])):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text += passage
            docs.append((at, " ".join(text)))
            at += rng.randrange(1, 3)
    rng.shuffle(docs)
    return docs + [docs[3], (1000, "long " * 3 + " ".join(word() for _ in range(20000)))]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"cell": 4, "star_group": 3}), (3, {"star_rounds": 0}), (4, {"star_group": 2})])
def test_equals_all_pairs(spark, documents, seed, options):
    docs = sample(seed)
    assert rows_of(ngram_join.linked(documents(docs), **options)) == brute_force(docs)


def test_empty_table(spark, documents):
    assert rows_of(ngram_join.linked(documents([]))) == []
    assert rows_of(ngram_join.linked(documents([(1, None), (2, "a")]))) == [(1, 0, 1), (2, 1, 2)]


def test_documents_without_id(spark, documents):
    docs = [(5, "a b c d"), (None, "a b c d"), (None, "e f g h")]
    assert rows_of(ngram_join.linked(documents(docs))) == [(5, 1, 5), (None, 1, 5), (None, 1, None)]


def test_one_of_each(spark, documents):
    docs = sample(6)
    table = documents(docs)
    kept = ngram_join.one_of_each(table)
    assert kept.columns == table.columns
    expected = sorted({(d, t or "") for (d, t) in docs if d in {r[2] for r in brute_force(docs)}})
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == expected


def changed_lengths(seed, pairs=40):
    """Pairs of near copies of which one has more words: appended, put in at one place or spread over the text, also few."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = []
    for k in range(pairs):
        for length, extra in ((13, 1), (23, 2), (43, 4), (63, 3)):
            base = [word() for _ in range(length)]
            more = list(base)
            where = [length, rng.randrange(length + 1)][k % 2]
            more[where:where] = [word() for _ in range(extra)]
            docs += [base, more] if k % 3 else [more, base]
    # Copies make the n-grams of a base frequent, so all that is added to it comes first in the order.
    for length, extra in ((43, 5), (63, 6), (103, 14), (403, 40)):
        base = [word() for _ in range(length)]
        docs += [base] * 30 + [base + [word() for _ in range(extra)] for _ in range(3)]
        docs += [[word() for _ in range(extra)] + base]
    return [(i, " ".join(words)) for i, words in enumerate(docs)]


@pytest.mark.parametrize("n,percent,options", [(4, 85, {"star_rounds": 0}), (4, 85, {}), (5, 80, {"star_rounds": 0, "cell": 5})])
def test_copies_with_added_words(spark, documents, n, percent, options):
    docs = changed_lengths(n)
    table = documents(docs, parts=1)
    assert rows_of(ngram_join.linked(table, n=n, percent=percent, **options)) == brute_force(docs, n, percent)


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("universe", [40, 400])
def test_tree_keeps_every_link(percent, universe):
    """All pairs of cells of random ordered sets, against the overlaps of the whole sets."""
    rng = np.random.default_rng(percent + universe)
    order = ngram_join.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for _ in range(60):
        base = rng.permutation(universe)[: rng.integers(4, universe // 2)]
        sets = []
        for _ in range(12):
            kept = base[rng.random(len(base)) > rng.choice([0, 0.05, 0.1])]
            sets.append(np.unique(np.append(kept, rng.integers(0, universe, rng.integers(0, 1 + len(base) // 6)))).astype(np.uint64))
        sets = [s for s in {tuple(s): s for s in sets}.values() if len(s)]
        rows = []
        for v, s in enumerate(sets):
            prefix = s[: len(s) - -(-percent * len(s) // 100) + 1]
            rows += [(int(t), v, len(s), at, prefix[at + 1 : at + 1 + ngram_join.TAIL]) for at, t in enumerate(prefix)]
        rows.sort(key=lambda r: r[:2])
        cell, vertex, size, at = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        tails = [r[4] for r in rows]
        none = np.zeros(len(rows), np.int64)
        cells = ngram_join.Cells(cell, vertex, vertex, size, at, none, none.astype(bool), np.concatenate(tails), np.array([len(t) for t in tails], np.int64))
        found = {tuple(sorted(p)) for q, s in ngram_join.tree_pairs(cells, percent, order) for p in zip(vertex[q].tolist(), vertex[s].tolist())}
        for b, y in enumerate(sets):
            for a, x in enumerate(sets[:b]):
                if len(np.intersect1d(x, y)) >= ngram_join.needed(len(x) + len(y), percent):
                    assert (a, b) in found


def test_words_made_to_collide_are_told_apart(spark, documents):
    """A Thue-Morse word and its complement have equal sums modulo 2^64 for every base."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = documents([(1, f"x y z {word}"), (2, f"x y z {other}"), (3, f"x y z {word}")])
    assert rows_of(ngram_join.linked(docs)) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_sketches_never_tell_more_than_the_difference():
    rng = np.random.default_rng(5)
    for percent in (50, 80, 85, 100):
        for _ in range(60):
            grams, size = rng.integers(0, 1 << 63, size=5000).astype(np.uint64), int(rng.integers(1, 2400))
            shared, other = int(rng.integers(0, size + 1)), int(size * rng.uniform(0.5, 1.1))
            x, y = grams[:size], np.append(grams[:shared], grams[2500 : 2500 + max(1, other - shared)])
            words, lengths = ngram_join.sketches(np.repeat([0, 1], [len(x), len(y)]), np.append(x, y), np.array([len(x), len(y)]), percent)
            told = ngram_join.Sketches(words, lengths).apart(np.array([0, 1]), np.array([1, 0]))
            assert told[0] == told[1] <= len(np.setxor1d(x, y))
    x, y = grams[:2000], grams[2000:4000]
    words, lengths = ngram_join.sketches(np.repeat([0, 1], 2000), np.append(x, y), np.array([2000, 2000]), 85)
    assert ngram_join.Sketches(words, lengths).apart(np.array([0]), np.array([1]))[0] > 4000 - 2 * ngram_join.needed(4000, 85)


def test_a_shared_passage_makes_no_candidates(spark, documents, monkeypatch):
    """Long texts with a passage in common, and little else, are told apart before their sets are sent."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passages = [[word() for _ in range(120)] for _ in range(6)]  # of six texts each: none is frequent
    docs = [(k, " ".join([word() for _ in range(2500)] + passages[k % 6])) for k in range(36)]
    docs += [(100 + k, docs[k][1] + " end") for k in range(5)]
    tried, verified = [], ngram_join.Join.verified

    def counted(self, pairs, classes):
        tried.append(pairs.count())
        return verified(self, pairs, classes)

    monkeypatch.setattr(ngram_join.Join, "verified", counted)
    assert rows_of(ngram_join.linked(documents(docs))) == brute_force(docs)
    assert sum(tried) <= 10


def test_entries_are_shuffled_once_and_only_the_result_stays(spark, documents, monkeypatch):
    plans, made = [], []

    class Watched(ngram_join.Shared):
        def __init__(self, spark):
            super().__init__(spark)
            made.append(self.root.removeprefix("file:"))

        def write(self, df, name):
            if name == "entries":
                df.collect()
                plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
            return super().write(df, name)

    monkeypatch.setattr(ngram_join, "Shared", Watched)
    docs = [(k, f"one two three four five {'six' if k % 2 else 'seven'} {k % 5}") for k in range(20)] + [(30, None)]
    assert rows_of(ngram_join.linked(documents(docs))) == brute_force(docs)
    assert len(plans) == 1 and "ReusedExchange" in plans[0]
    assert [name for root in made if Path(root).is_dir() for name in os.listdir(root)] == ["components"]
