import hashlib
import os
import random
from pathlib import Path

import numpy as np
import pytest
from conftest import rows_of

from strandline.llm import suffix_dedup


def brute_force(docs, length):
    places = {}
    texts = [(t or "").encode() for _, t in docs]
    for i, text in enumerate(texts):
        for p in range(len(text) - length + 1):
            places.setdefault(text[p : p + length], []).append((i, p))
    cover = [bytearray(len(t)) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                cover[i][p : p + length] = b"\x01" * length
    out = []
    for (doc_id, _), text, marks in zip(docs, texts, cover):
        kept = bytes(b for b, m in zip(text, marks) if not m)
        spans = sum(1 for k in range(len(marks)) if marks[k] and (k == 0 or not marks[k - 1]))
        out.append((doc_id, len(text), sum(marks), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def sample(seed, length):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \nxyz") for _ in range(n))
    shared = [text(length + rng.randrange(-2, 60)) for _ in range(4)]
    docs = [(0, None), (1, ""), (2, "short"), (None, shared[0]), (3, "a" * (3 * length)), (4, "ab" * length), (5, shared[1][:length])]
    for i in range(6, 70):
        parts = [text(rng.randrange(0, 300))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            parts += [s[rng.randrange(10) :], text(rng.randrange(0, 40))]
        docs.append((i, "".join(parts)))
    base = text(500)
    for i in range(70, 90):
        at = rng.randrange(400)
        docs.append((i, base[:at] + "#" + base[at + 1 :]))
    return docs + [docs[20], docs[20], (21, "other text"), (91, shared[2] + "\x00" * 300)]


@pytest.mark.parametrize("seed,length,group", [(1, 200, 4000), (2, 60, 4000), (3, 60, 5)])
def test_equals_plain_search(spark, documents, seed, length, group):
    docs = sample(seed, length)
    assert rows_of(suffix_dedup.report(documents(docs), length=length, group=group)) == brute_force(docs, length)


def test_long_documents_come_in_parts(monkeypatch):
    rng = random.Random(5)
    data = bytes(rng.choice(b"abc") for _ in range(5000))
    monkeypatch.setattr(suffix_dedup, "POSITION_BITS", 10)
    offsets = np.array([0, len(data)])
    starts = [s for a, b, begin, end in suffix_dedup._pieces(offsets, 60) for s in range(begin, end - 59)]
    assert starts == list(range(len(data) - 59))


def test_empty_table(spark, documents):
    assert rows_of(suffix_dedup.report(documents([]))) == []
    assert rows_of(suffix_dedup.report(documents([(1, None)]))) == brute_force([(1, None)], 200)


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(60):
        letters = rng.choice([1, 2, 3, 26])
        pieces = [bytes(rng.randrange(letters) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 8))]
        data, ends = b"".join(pieces), np.cumsum([len(p) for p in pieces])
        order = suffix_dedup.suffix_array(data, ends, 10)
        stop = np.repeat(ends, np.diff(np.append(0, ends)))
        cut = [data[i : min(i + 10, stop[i])] for i in order]
        assert sorted(order.tolist()) == list(range(len(data))) and cut == sorted(cut)


def test_whole_characters():
    data = np.frombuffer("aéb€c".encode(), np.uint8)
    first, last = suffix_dedup.whole_characters(data, np.array([2]), np.array([5]))
    assert (first.tolist(), last.tolist()) == ([3], [4])


def test_rows_of_a_hot_key_follow_the_documents(spark, documents, monkeypatch):
    """One passage in ever more documents: its keys get hot, and the rows made stay in proportion, far below one a window."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, seen = text(230), {}

    class Watched(suffix_dedup.Shared):
        def write(self, df, name):
            made = super().write(df, name)
            seen[name] = made.count()
            return made

    monkeypatch.setattr(suffix_dedup, "Shared", Watched)
    rows = {}
    for n in (40, 160):
        docs = [(i, text(250) + passage + text(250)) for i in range(n)]
        seen.clear()
        assert rows_of(suffix_dedup.report(documents(docs), group=20)) == brute_force(docs, 200)
        assert "cuts" in seen
        rows[n] = seen["found"] + seen["finer"]
    assert rows[160] < 6 * rows[40] and rows[160] < 160 * 2 * 168 / 3


def test_texts_are_sent_once_and_only_the_ranges_stay(spark, documents, monkeypatch):
    made, cuts, cut = [], [], suffix_dedup.cut

    class Watched(suffix_dedup.Shared):
        def __init__(self, spark):
            super().__init__(spark)
            made.append(self.root.removeprefix("file:"))

    def watched(*args, **options):
        cuts.append(cut(*args, **options))
        return cuts[-1]

    monkeypatch.setattr(suffix_dedup, "Shared", Watched)
    monkeypatch.setattr(suffix_dedup, "cut", watched)
    text = "".join(chr(97 + k * k % 23) + str(k) for k in range(120))
    docs = [(1, "a" + text), (2, text + "é"), (3, None), (4, "")]
    kept = suffix_dedup.without_repeats(documents(docs)).select("doc_id", "text", "n_chars", "k1")
    assert rows_of(kept) == [(1, "a", 1, 8), (2, "é", 1, 8), (3, None, None, 8), (4, "", 0, 8)]
    sent = cuts[0].schema["carried"].dataType
    assert "text" not in sent["columns"].dataType.names + sent.names
    assert [name for root in made if Path(root).is_dir() for name in os.listdir(root)] == ["ranges"]
