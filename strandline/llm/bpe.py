"""Byte-pair encoding and decoding, speculate and verify.

A word's encoding is guessed by taking the longest token again and again. The guess is the exact encoding if every pair of
neighbouring tokens is *compatible*: merging the symbols of the two tokens together never joins across their border. Merges
happen in the order of their ranks and a token's own merges have rising ranks, so the symbols that ever meet at the border
are known: the right edges of the left token's merge tree against the left edges of the right one's. All distinct pairs of
a batch go down these edges together in numpy. Words with a failing pair, and only those, are merged exactly.

Texts are folded and split as the vocabulary file says. Plain texts (settled Latin letters and common punctuation) are split
at white space first, and each distinct chunk is encoded once for a batch; other texts are split by the library.

Defined cases: a null or empty text has no tokens and decodes to the empty text; strings of added tokens inside a text become
that token, as in the library; very long words merge in ``n log n``; repeated rows get the same result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import grouped_ranges
from .token_cache import byte_letters

NEVER = 1 << 40
CACHED_CHUNKS = 400_000
SHORT_WORD = 64
GROUP_BYTES = 1 << 21


class Vocabulary:
    """Tokens, merges and the merge tree of every token. Made once on the driver and broadcast."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            self.made = file.read()
        made = json.loads(self.made)
        model = made["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain BPE vocabularies are supported")
        if made.get("decoder") or made.get("post_processor"):
            raise ValueError("vocabularies with a decoder or post-processor are not supported")
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        missing = [c for c in byte_letters() if c not in self.ids or c + self.end not in self.ids]
        if missing:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        size = max(self.names) + 1
        self.left, self.right, self.rank = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        self.orderly, self.none = True, (NEVER, -1)
        for rank, pair in enumerate(model["merges"]):
            a, b = (self.ids[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            token = self.ids[self.names[a] + self.names[b]]
            self.merge[a, b] = (rank, token)
            self.orderly &= self.rank[token] < 0 and self.rank[a] < rank and self.rank[b] < rank
            self.left[token], self.right[token], self.rank[token] = a, b, rank
        keys = np.array([(a << 32) | b for a, b in self.merge], np.int64)
        ranks = np.array([r for r, _ in self.merge.values()], np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_ranks = keys[order], ranks[order]
        # Only tokens that their own symbols merge to can stand in a guess.
        self.guesses = {t: i for t, i in self.ids.items() if self.exact(self.symbols(t)) == [i]} if self.orderly else {}
        self.reach: dict[str, int] = {}
        for token in self.guesses:
            self.reach[token[:2]] = max(self.reach.get(token[:2], 1), len(token))
        self.longest = max(map(len, self.guesses), default=0)

    @classmethod
    def of_parts(cls, parts: dict) -> Vocabulary:
        made = cls.__new__(cls)
        vars(made).update(parts)
        return made

    def symbols(self, token: str) -> list[int]:
        """First symbols of a word, or of a token as it stands in a word."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [self.ids[c] for c in body[:-1]] + [self.ids[body[-1] + self.end]]
        return [self.ids[c] for c in token] if all(c in self.ids for c in token) else []

    def exact(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until none is left."""
        n = len(ids)
        if n <= SHORT_WORD:
            return self.exact_short(list(ids))
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        merge = self.merge
        heap = [(*merge[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merge]
        heap = [(rank, i, token) for rank, token, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, token = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or merge.get((ids[i], ids[j])) != (rank, token):
                continue
            ids[i], ids[j] = token, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                found = merge.get((token, ids[after[i]]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1]))
            if before[i] >= 0:
                found = merge.get((ids[before[i]], token))
                if found:
                    heapq.heappush(heap, (found[0], before[i], found[1]))
        return [t for t in ids if t >= 0]

    def exact_short(self, ids: list[int]) -> list[int]:
        """The same for a short word: the ranks of its pairs in a list."""
        find, none = self.merge.get, self.none
        found = [find(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i] = best[1]
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = find((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = find((ids[i], ids[i + 1]), none)
        return ids

    def guess(self, word: str) -> list[int] | None:
        """Longest tokens from the left; ``None`` where one is missing."""
        guesses, reach, out, at, n = self.guesses, self.reach, [], 0, len(word)
        whole = self.longest - len(self.end)
        while at < n:
            # The rest is looked up only where it may be a token, so a word of any length is read once.
            found = guesses.get(word[at:] + self.end) if n - at <= whole else None
            if found is not None:
                out.append(found)
                return out
            for stop in range(min(n - 1 if self.end else n, at + reach.get(word[at : at + 2], 1)), at, -1):
                found = guesses.get(word[at:stop])
                if found is not None:
                    break
            else:
                return None
            out.append(found)
            at = stop
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays apart when merged together."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a_end, b_end = np.full(len(a), NEVER), np.full(len(a), NEVER)
        a, b = a.copy(), b.copy()
        while len(live):
            key = (a << 32) | b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank = np.where(self.pairs[at] == key, self.pair_ranks[at], NEVER)
            # At equal rank the leftmost pair merges first: inside the left token, then across, then inside the right one.
            joins = (rank < a_end) & (rank <= b_end) & (rank < NEVER)
            good[live[joins]] = False
            a_rank, b_rank = self.rank[a], self.rank[b]
            on = ~joins & ((a_rank >= 0) | (b_rank >= 0))
            live, a, b, a_end, b_end, a_rank, b_rank = (x[on] for x in (live, a, b, a_end, b_end, a_rank, b_rank))
            down = a_rank > b_rank  # the later merge is undone first; of equals the right one
            a_end, b_end = np.where(down, a_rank, a_end), np.where(down, b_end, b_rank)
            a, b = np.where(down, self.right[a], a), np.where(down, b, self.left[b])
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Exact encodings of words in byte letters."""
        guesses = [self.guess(w) if self.orderly else None for w in words]
        lengths = np.array([len(g) if g else 1 for g in guesses], np.int64)
        flat = np.array([t for g in guesses for t in (g or (0,))], np.int64)
        good = np.array([g is not None for g in guesses], bool)
        if len(flat) > 1:
            inner = np.ones(len(flat), bool)
            inner[np.cumsum(lengths)[:-1]] = False
            inner[0] = False
            second = np.flatnonzero(inner)
            owner = np.repeat(np.arange(len(words)), lengths)[second]
            pairs, index = np.unique((flat[second - 1] << 32) | flat[second], return_inverse=True)
            fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            good[owner[~fits[index]]] = False
        return [g if ok else self.exact(self.symbols_of_word(w)) for g, ok, w in zip(guesses, good, words)]

    def symbols_of_word(self, word: str) -> list[int]:
        ids = self.ids
        return [ids[c] for c in word[:-1]] + [ids[word[-1] + self.end]] if word else []


class Splitter:
    """Texts to words in byte letters, as the file's normaliser and pre-tokeniser give them."""

    KNOWN_NORMALISER = ["NFC", "Replace", "Lowercase"]
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, made: str) -> None:
        from tokenizers import Tokenizer

        file = json.loads(made)
        self.library = Tokenizer.from_str(made)
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("added tokens with matching options are not supported")
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        steps = (file.get("normalizer") or {}).get("normalizers") or []
        parts = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = [s["type"] for s in steps] == self.KNOWN_NORMALISER and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        known = known and len(parts) == 2 and parts[0].get("pattern") == {"Regex": self.WORDS} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
        self.plain_rule = known and parts[1]["type"] == "ByteLevel" and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
        letter_of = {b: c for c, b in byte_letters().items()}
        settled = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20B6)]]
        settled = [c for c in settled if all(x in settled for x in c.lower())]
        # Python's split() knows four separators more than the file's white space.
        self.odd = re.compile("[^" + "".join(re.escape(c) for c in settled if not "\x1c" <= c <= "\x1f") + "]")
        self.bytes_of = {ord(c): "".join(letter_of[b] for b in c.encode()) for c in settled}
        kinds = {k: "".join(re.escape(c) for c in settled if unicodedata.category(c)[0] == k) for k in "LN"}
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^{kinds['L']}{kinds['N']}]+")

    def chunks(self, text: str) -> list[str] | None:
        """White-space separated chunks of a plain text, folded; ``None`` for any other."""
        if not self.plain_rule or self.odd.search(text) or (self.special and self.special.search(text)):
            return None
        return text.lower().split()

    def chunk_words(self, chunk: str) -> list[str]:
        return [w.translate(self.bytes_of) for w in self.words.findall(chunk)]

    def any_words(self, text: str) -> list[str | int]:
        """Words of any text, and the ids of added tokens in it."""
        out: list[str | int] = []
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            out += self.plain_words(text[at : found.start()])
            out.append(self.added[found.group()])
            at = found.end()
        return out + self.plain_words(text[at:])

    def plain_words(self, text: str) -> list[str]:
        text = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)] if text else []


class Coder:
    """Encodes texts; keeps the encodings of up to ``CACHED_CHUNKS`` chunks."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.splitter = vocabulary, Splitter(vocabulary.made)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.decoded: list[str] = []
        self.known: dict[str, list[int]] = {}
        self.lengths, self.flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]

    def learn(self, chunks: list[str]) -> None:
        words = [self.splitter.chunk_words(c) for c in chunks]
        encoded = self.known
        distinct = list({w for ws in words for w in ws} - encoded.keys())
        encoded.update(zip(distinct, self.vocabulary.encode_words(distinct)))
        names = self.vocabulary.names
        ids = [[t for w in ws for t in encoded[w]] for ws in words]
        for chunk, found in zip(chunks, ids):
            self.index[chunk] = len(self.decoded)
            self.decoded.append(" ".join([names[t] for t in found]))
        self.lengths.append(np.array([len(i) for i in ids], np.int64))
        self.flat.append(np.array([t for i in ids for t in i], np.uint32))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids and decoded text of each text; call with a bounded group of texts."""
        split = [self.splitter.chunks(t) for t in texts]
        plain = [c for c in split if c]
        if len(self.index) > CACHED_CHUNKS:
            self.clear()
        new = list(set().union(*plain) - self.index.keys()) if plain else []
        if new:
            self.learn(new)
        lengths, flat = np.concatenate(self.lengths), np.concatenate(self.flat)
        self.lengths, self.flat = [lengths], [flat]
        begin = np.cumsum(lengths) - lengths
        index, decoded = self.index, self.decoded
        names = self.vocabulary.names
        for text, chunks in zip(texts, split):
            if chunks is None:
                words = self.splitter.any_words(text)
                strings = list({w for w in words if isinstance(w, str)})
                encoded = dict(zip(strings, self.vocabulary.encode_words(strings)))
                ids = [t for w in words for t in (encoded[w] if isinstance(w, str) else (w,))]
                yield np.array(ids, np.uint32), " ".join([names[t] for t in ids])
            else:
                rows = np.fromiter(map(index.__getitem__, chunks), np.int64, len(chunks))
                yield flat[grouped_ranges(begin[rows], lengths[rows])], " ".join(map(decoded.__getitem__, rows.tolist()))


def groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _task(sent, digests: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = Coder(Vocabulary.of_parts(sent.value))
    for batch in batches:
        at = 0
        kept = [c for c in batch.schema.names if c != "text"]
        for group in groups([t or "" for t in batch.column("text").to_pylist()]):
            found = list(coder.encode(group))
            if digests:
                made = [
                    pa.array([len(i) for i, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i, _ in found], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in found], pa.string()),
                ]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                made = [pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([d for _, d in found], pa.string())]
                names = ["ids", "decoded"]
            rows = batch.slice(at, len(group))
            at += len(group)
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], *made], names=[*kept, *names])


def _run(docs: DataFrame, vocabulary: str, digests: bool, added: str, carried: Column | None) -> DataFrame:
    # Its plain parts, so that executors need no copy of this package to read the broadcast.
    sent = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary(vocabulary)))
    source = docs.select("doc_id", "text") if carried is None else docs.select("doc_id", "text", carried.alias("carried"))
    fields = [f for f in source.schema.fields if f.name != "text"]
    return source.mapInArrow(lambda b: _task(sent, digests, b), T.StructType(fields + T._parse_datatype_string(added).fields))


def encoded(docs: DataFrame, vocabulary: str, carried: Column | None = None) -> DataFrame:
    """``doc_id``, token ``ids`` and ``decoded`` text of every document."""
    return _run(docs, vocabulary, False, "ids array<int>, decoded string", carried)


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The digest columns of the registered query, made in the tasks so that the ids need not leave them."""
    return _run(docs, vocabulary, True, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", None)
