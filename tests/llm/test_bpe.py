import hashlib
import random
import time

import numpy as np
import pytest
from conftest import rows_of
from tokenizers import Tokenizer

from strandline.llm import bpe, token_cache
from strandline.llm.catalog import vocabulary
from strandline.llm.common import Shared

WORDS, BYTES = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


def sample(seed, n=250):
    rng = random.Random(seed)
    pool = [*map(chr, range(0x250)), *"\u2003\u2028’“€ſßΣςἈ漢字🙂", "e\u0301", "<|endoftext|>", "<|startoftext|>", "\x1c", " ", *["ing", "tion", "'s", " THE"] * 10]
    texts = [None, "", " ", "a" * 30000, "ab" * 3000, "'" * 300, "word " * 5000]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(n)]
    texts += ["".join(rng.choice("aeiounstrhl 'M") for _ in range(rng.randrange(150))) for _ in range(n)]
    return list(enumerate(texts)) + [(3, "twice"), (3, "twice"), (None, "no id")]


def test_equals_the_library(spark, documents):
    docs, library = sample(1), Tokenizer.from_file(WORDS)
    expected = []
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert rows_of(bpe.report(documents(docs), WORDS)) == sorted(expected, key=repr)
    made = {(r.doc_id, tuple(r.ids)) for r in bpe.encoded(documents(docs), WORDS).collect()}
    assert made == {(i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in docs}


def test_pairs_are_judged_exactly():
    known, rng = bpe.Vocabulary(WORDS), random.Random(2)
    tokens = rng.sample(sorted(known.guesses.values()), 3000)
    a = np.array([t for t in tokens if not known.names[t].endswith("</w>")][:1200])
    b = np.array(tokens[: len(a)])
    good = known.compatible(a, b)
    symbols = lambda t: known.symbols(known.names[t])
    exact = [known.exact(symbols(x) + symbols(y)) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert good.tolist() == exact and 0 < sum(exact) < len(exact)


def test_both_exact_merges_agree():
    known, rng = bpe.Vocabulary(WORDS), random.Random(3)
    for _ in range(300):
        ids = known.symbols_of_word("".join(rng.choice("aeinst") for _ in range(rng.randrange(1, 60))))
        short = known.exact_short(list(ids))
        bpe.SHORT_WORD, kept = 0, bpe.SHORT_WORD
        try:
            assert known.exact(ids) == short
        finally:
            bpe.SHORT_WORD = kept


def test_empty_tables(spark, documents):
    assert rows_of(bpe.report(documents([]), WORDS)) == []
    assert rows_of(token_cache.report(documents([]), BYTES, Shared(spark).path("c"))) == []


def test_counts_and_cache(spark, documents):
    docs, library = sample(4), Tokenizer.from_file(BYTES)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    expected = sorted(((i, len((t or "").encode()), count(t), count(t) > 512) for i, t in docs), key=repr)
    path = Shared(spark).path("cache")
    assert rows_of(token_cache.report(documents(docs), BYTES, path)) == expected
    first = spark.read.parquet(path).count()
    assert first == len({t or "" for _, t in docs})
    more = docs + [(9000, "new text"), (9001, "new text")]
    assert len(rows_of(token_cache.report(documents(more), BYTES, path))) == len(more)
    assert spark.read.parquet(path).count() == first + 1


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_vocabularies(name):
    import sentencepiece

    texts = ["Some text, with <s> and é.", "", "<|endoftext|> a"]
    got = token_cache.Counter(vocabulary(name)).count(texts)
    if name.endswith(".model"):
        library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        assert got == [len(library.encode(t)) for t in texts]
    else:
        assert got == [len(Tokenizer.from_file(vocabulary(name)).encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("n", [9_999, 10_000, 1_000_000])
def test_long_white_space_is_counted(n):
    texts = [" " * n + "a", "b" + "\n" * n, "c" + " \t" * (n // 2) + "d"]
    counter = token_cache.Counter(BYTES)
    assert counter.count(texts) == [len(counter.library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_word_in_linear_time():
    """A guess reads a word once: ten times the letters take about ten times as long, not a hundred."""
    known, rng = bpe.Vocabulary(WORDS), random.Random(5)
    word = "".join(rng.choice("abcdefghijklmnop") for _ in range(400_000))
    took = []
    for n in (40_000, 400_000):
        begin = time.process_time()
        guess = known.guess(word[:n])
        took.append(time.process_time() - begin)
        assert guess is not None and "".join(known.names[t] for t in guess) == word[:n] + known.end
    assert took[1] < 40 * max(took[0], 0.05)
