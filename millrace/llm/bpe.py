"""BPE encoding and decoding with forced boundaries (operator 10).

The vocabulary file is a public one of the tokenizers library: white space becomes one space, text is composed
and lower-cased, a pattern cuts it into pieces, the bytes of a piece are BPE symbols and its last symbol carries
an end mark. Two bytes that never stand side by side inside any vocabulary token can never be in one token:
between them a cut is certain. Each piece is cut there, the fragments are encoded on their own and the ids are
put together again.

Defined results: null text is empty; empty text has no ids and decodes to ''. Strings of the special tokens
inside a text become the special ids, as in the library's default. Repeated rows give repeated rows. A run of
bytes of any length takes n log n steps.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_batches

#: Entries of each generation of a worker's memory.
REMEMBERED = 100_000
#: Control characters that Python takes for white space and Unicode does not.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
#: White space as Unicode has it.
SPACE = regex.compile("[\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


class Memory:
    """Results by key in two generations: what is asked for again outlives what is not."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        if (found := self.young.get(key)) is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        self.young[key] = value


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class Codec:
    """One vocabulary file, read once in each Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, steps = told["model"], told["pre_tokenizer"]["pretokenizers"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.size = max(self.vocab.values()) + 1
        self.rank = {self.vocab[a] * self.size + self.vocab[b]: k for k, (a, b) in enumerate(model["merges"])}
        self.result = [self.vocab[a + b] for a, b in model["merges"]]
        self.letters = {b: letter for b, letter in enumerate(byte_letters())}
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.inside = self.pairs_inside()
        self.words, self.parts = Memory(), Memory()

    def pairs_inside(self) -> set[str]:
        """Pairs of neighbouring bytes that some token holds."""
        found: set[str] = set()
        for token in self.vocab:
            body = token.removesuffix(self.end) if self.end else token
            found.update(body[i : i + 2] for i in range(len(body) - 1))
        return found

    def fragments(self, letters: str) -> list[str]:
        """Cut where no token can reach across."""
        inside, out, first = self.inside, [], 0
        for i in range(1, len(letters)):
            if letters[i - 1 : i + 1] not in inside:
                out.append(letters[first:i])
                first = i
        out.append(letters[first:])
        return out

    def merged(self, ids: list[int]) -> list[int]:
        """Join the pair of lowest rank, leftmost first, until none is left."""
        if len(ids) > 64:
            return self.merged_long(ids)
        rank, none, size = self.rank.get, len(self.rank), self.size
        ranks = [rank(a * size + b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i] = self.result[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] * size + ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] * size + ids[i + 1], none)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, in n log n steps."""
        n, rank, size = len(ids), self.rank.get, self.size
        after, before, parts = list(range(1, n + 1)), list(range(-1, n - 1)), list(ids)
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            least, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = self.result[least], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank(parts[i] * size + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if (k := before[i]) >= 0 and (r := rank(parts[k] * size + parts[i])) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[i]))
        return [p for p in parts if p >= 0]

    def fragment_ids(self, fragment: str, last: bool) -> list[int]:
        vocab = self.vocab
        ids = [vocab[c] for c in fragment]
        if last:
            ids[-1] = vocab[fragment[-1] + self.end]
        return self.merged(ids)

    def piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        if (ids := self.parts.get(piece)) is None:
            *heads, tail = self.fragments(piece.encode().decode("latin-1").translate(self.letters))
            found = [i for f in heads for i in self.fragment_ids(f, False)]
            ids = np.array(found + self.fragment_ids(tail, True), "<u4").tobytes()
            if len(piece) <= 64:
                self.parts.put(piece, ids)
        return ids

    def word(self, word: str) -> bytes:
        """Ids of a run without white space: no piece reaches across it."""
        if (ids := self.words.get(word)) is None:
            ids = b"".join(map(self.piece, self.pieces.findall(word)))
            if len(word) <= 64:
                self.words.put(word, ids)
        return ids

    def split(self, text: str) -> list[str]:
        """Runs without white space of the composed, lower-cased text."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter: a final sigma has no form of its own
        text = text.lower()
        return text.split() if NOT_SPACE.search(text) is None else SPACE.split(text)

    def encode(self, text: str) -> bytes:
        if self.specials is not None and any(s in text for s in self.special):
            parts = self.specials.split(text)
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.plain(p) for p in parts)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        young, word = self.words.young.get, self.word
        return b"".join([young(w) or word(w) for w in self.split(text)])

    def decode(self, ids: bytes) -> str:
        """Tokens with a space between them: the vocabulary names no decoder."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, key: Column, text: Column) -> DataFrame:
    """key, ids (binary: little-endian unsigned 32-bit integers) and decoded of every row.

    ``path`` names the vocabulary file; it is installed on every executor. No shuffle: a row is encoded
    where it is read.
    """

    def make():
        own = codec(path)

        def step(keys: list, texts: list) -> tuple[list, ...]:
            ids = [own.encode(t) for t in texts]
            return keys, ids, [own.decode(i) for i in ids]

        return step

    kind = df.select(key.alias("key")).schema["key"].dataType.simpleString()
    return map_batches(df, [key.alias("key"), F.coalesce(text, F.lit("")).alias("text")], make, f"key {kind}, ids binary, decoded string")
