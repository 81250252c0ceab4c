"""Personal data by patterns and a skip-chain conditional random field (operator 9).

Patterns give the base spans: email, ip, card (16 to 19 digits, Luhn), phone (8 to 15 digits), leftmost and
non-overlapping for each kind, failing matches dropped. The field then labels tokens (runs without white space
that hold a digit or ``@``; all others are no personal data) from their shape, from the labels of tokens beside
them, and from the labels of equal or similar tokens anywhere in the document: tokens of one form, or of the same
four or more digits, are joined from one occurrence to the next and share a potential, so that one clear
occurrence carries its label to unclear ones. Labels are the largest marginals of loopy message passing. A run of
tokens of one kind becomes a span if no base span meets it and its mean marginal is at least ``SURE``.

Learning: pseudo-likelihood on at most ``SAMPLE`` documents that hold a digit or ``@``, chosen by a hash of their
id and text, ``SAMPLE_TOKENS`` tokens of each in runs of ``RUN`` spread over the whole text; labels are the base spans,
and tokens of dropped matches are left out. The potential of equal labels of joined tokens is learned, with a prior of
at least 1: consistency counts also where the sample repeats nothing.

Defined results: null and empty texts have no spans. Rows that repeat an id and a text are one document of the sample and
each get a row. Where nothing can be learned only base spans are given.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: none
SAMPLE, SAMPLE_TOKENS, RUN, STEPS, RATE = 1_500, 200, 20, 300, 0.2
#: Characters of the longest token whose shape is remembered.
REMEMBERED = 200
ROUNDS, DAMPING, SURE = 40, 0.3, 0.9
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits that fails from its start fails from every digit in it.
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
DIGITS = re.compile(r"[0-9]([\x20-]?[0-9])+")
CALL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
MARKED = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def luhn_card(token: str) -> bool:
    """A whole card number in one token."""
    digits = re.sub("[^0-9]", "", token)
    return 16 <= len(digits) <= 19 and luhn(digits)


def emails(text: str) -> list[tuple[int, int]]:
    """From each ``@`` back over the local part: the leftmost match without trying every start."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > last and text[first - 1] in LOCAL:
            first -= 1
        end = DOMAIN.match(text, at) if first < at else None
        if end is not None:
            last = end.end()
            found.append((first, last))
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) sorted by kind and start; places of dropped matches."""
    found, dropped = [], []
    if "@" in text:
        found += [(0, a, b) for a, b in emails(text)]
    if MARKED.search(text) is not None:
        for m in ADDRESS.finditer(text):
            fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
            (found.append((1, *m.span())) if fits else dropped.append(m.span()))
        for m in DIGITS.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            (found.append((2, *m.span())) if 16 <= len(digits) <= 19 and luhn(digits) else dropped.append(m.span()) if len(digits) >= 16 else None)
        if "+" in text:
            for m in CALL.finditer(text):
                (found.append((3, *m.span())) if 8 <= sum(c.isdigit() for c in m[0]) <= 15 else dropped.append(m.span()))
    return found, dropped


def tokens(text: str) -> list[tuple[int, int]]:
    """Places of the tokens that hold a digit or ``@``."""
    return [m.span() for m in TOKEN.finditer(text)] if MARKED.search(text) is not None else []


SHAPES = [
    r"\+[0-9]{1,3}", r"\+[0-9(][0-9().-]{7,}", r"\([0-9]{2,4}\)", r"[0-9]{3}[-.][0-9]{4}", r"[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}", r"[0-9]{4}", r"[0-9]+",
    r"[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}", r"[^@]+@[^@]+\.[^@.]+", r"[^@]+@[^@]+", r"[0-9]{1,3}(\.[0-9]{1,3}){3}", r".*[A-Za-z].*", r".*[=:\"'/].*", r"[0-9]{1,4}([./:-][0-9]{1,4}){1,2}",
]
COMPILED = [re.compile(s) for s in SHAPES]
COUNTS = (1, 2, 3, 4, 8, 13, 16, 20)
WIDTH = 2 + len(SHAPES) + len(COUNTS)


def features(token: str) -> np.ndarray:
    """Shape of a token without the punctuation around it."""
    core = token.strip(".,;:!?\"'<>[]{}")
    digits = re.sub("[^0-9]", "", core)
    out = [1.0, float(luhn_card(core)), *(float(c.fullmatch(core) is not None) for c in COMPILED)]
    bucket = sum(len(digits) >= n for n in COUNTS)
    return np.array(out + [float(bucket == k + 1) for k in range(len(COUNTS))])


def likeness(token: str) -> str:
    """Tokens with one likeness are joined over any distance."""
    digits = re.sub("[^0-9]", "", token)
    return digits if len(digits) >= 4 and "@" not in token else token.strip(".,;:!?\"'<>[]{}()").lower()


def joined(keys: list, docs: list[int]) -> np.ndarray:
    """Edges from each token to the next of the same likeness in its document."""
    last, edges = {}, []
    for k, pair in enumerate(zip(docs, keys, strict=True)):
        if pair in last:
            edges.append((last[pair], k))
        last[pair] = k
    return np.array(edges, np.int64).reshape(-1, 2)


@dataclass
class Field:
    unary: np.ndarray  # WIDTH x LABELS
    chain: np.ndarray  # LABELS x LABELS: of a token and the next one
    skip: float  # of two joined tokens with one label

    def outside(self, chained: np.ndarray, n: int) -> np.ndarray:
        """Potentials towards neighbours that hold neither digit nor ``@``."""
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[chained[:, 1]] = False
        after[chained[:, 0]] = False
        return before[:, None] * self.chain[0] + after[:, None] * self.chain[:, 0]

    def marginals(self, x: np.ndarray, chained: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """Loopy sum-product over all tokens of a batch at once: documents are parts of one graph without edges between."""
        n = len(x)
        own = x @ self.unary + self.outside(chained, n)
        if not len(chained) and not len(skips):
            return softmax(own)
        source = np.concatenate([chained[:, 0], skips[:, 0], chained[:, 1], skips[:, 1]])
        target = np.concatenate([chained[:, 1], skips[:, 1], chained[:, 0], skips[:, 0]])
        half = len(source) // 2
        same = self.skip * np.eye(LABELS)
        there = np.concatenate([np.repeat(self.chain[None], len(chained), 0), np.repeat(same[None], len(skips), 0)])
        pair = np.concatenate([there, there.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        message = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, target, message)
            inner = belief[source] - message[back]
            z = inner[:, :, None] + pair
            top = z.max(1)
            new = top + np.log(np.exp(z - top[:, None]).sum(1))
            new = DAMPING * message + (1 - DAMPING) * (new - new.max(1, keepdims=True))
            moved, message = np.abs(new - message).max(initial=0), new
            if moved < 1e-3:
                break
        belief = own.copy()
        np.add.at(belief, target, message)
        return softmax(belief)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learn(x: np.ndarray, y: np.ndarray, chained: np.ndarray, skips: np.ndarray, known: np.ndarray) -> Field:
    """Pseudo-likelihood: each known token given its neighbours' labels."""
    field = Field(np.zeros((x.shape[1], LABELS)), np.zeros((LABELS, LABELS)), 0.0)
    n, one = len(x), np.eye(LABELS)[y]
    before, after, friends = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, LABELS))
    before[chained[:, 1]], after[chained[:, 0]] = y[chained[:, 0]], y[chained[:, 1]]
    np.add.at(friends, skips[:, 0], one[skips[:, 1]])
    np.add.at(friends, skips[:, 1], one[skips[:, 0]])
    weight = known / max(known.sum(), 1)
    for _ in range(STEPS):
        z = x @ field.unary + field.chain[before] + field.chain[:, after].T + field.skip * friends
        error = (one - softmax(z)) * weight[:, None]
        field.unary += RATE * 10 * (x.T @ error - 1e-5 * field.unary)
        grad = np.zeros((LABELS, LABELS))
        np.add.at(grad, before, error)
        np.add.at(grad.T, after, error)
        field.chain += RATE * 10 * (grad - 1e-5 * field.chain)
        field.skip = max(0.0, field.skip + RATE * 10 * float((friends * error).sum()))
    field.skip = max(field.skip, 1.0)
    return field


class Reader:
    """Tokens of texts with remembered shapes."""

    def __init__(self):
        self.shapes: dict[str, np.ndarray] = {}

    def shape(self, token: str) -> np.ndarray:
        if len(token) > REMEMBERED:
            return features(token)
        if (found := self.shapes.get(token)) is None:
            if len(self.shapes) > 100_000:
                self.shapes.clear()
            found = self.shapes[token] = features(token)
        return found

    def graph(self, texts: list[str], places: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, edges of neighbours and edges of like tokens over all texts."""
        words = [t[a:b] for t, p in zip(texts, places, strict=True) for a, b in p]
        docs = [k for k, p in enumerate(places) for _ in p]
        chained, at = [], 0
        for t, p in zip(texts, places, strict=True):
            chained += [(at + k, at + k + 1) for k in range(len(p) - 1) if p[k + 1][0] - p[k][1] < 5 and t[p[k][1] : p[k + 1][0]].isspace()]
            at += len(p)
        x = np.array([self.shape(w) for w in words]).reshape(-1, WIDTH)
        return x, np.array(chained, np.int64).reshape(-1, 2), joined([likeness(w) for w in words], docs)


def meets(a: int, b: int, spans: list[tuple[int, int]]) -> bool:
    """Whether [a, b) meets one of the sorted, disjoint spans."""
    from bisect import bisect_left

    k = bisect_left(spans, (b, -1))
    return k > 0 and spans[k - 1][1] > a


def added(text: str, places: list[tuple[int, int]], chances: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of labelled tokens that meet no base span."""
    taken = [sorted((a, b) for kind, a, b in base if kind == k) for k in range(len(KINDS))]
    out, k, label = [], 0, chances.argmax(1)
    while k < len(places):
        end = k + 1
        if label[k] >= 3:  # cards and phones may take several tokens
            whole = lambda i: luhn_card(text[places[i][0] : places[i][1]]) or text[places[i][0]] == "+"
            while end < len(places) and label[end] == label[k] and not whole(end) and not luhn_card(text[places[end - 1][0] : places[end - 1][1]]) and text[places[end - 1][1] : places[end][0]].isspace() and places[end][0] - places[end - 1][1] < 5:
                end += 1
        if label[k]:
            a, b = places[k][0], places[end - 1][1]
            while a < b and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
                b -= 1
            if a < b and chances[k:end, label[k]].mean() >= SURE and not any(meets(a, b, t) for t in taken):
                out.append((int(label[k]) - 1, a, b))
        k = end
    return out


def spread_over(places: list[tuple[int, int]]) -> list[int]:
    """Numbers of the tokens to learn from: all of them, or runs at equal distances from the first to the last."""
    if len(places) <= SAMPLE_TOKENS:
        return list(range(len(places)))
    starts = np.linspace(0, len(places) - RUN, SAMPLE_TOKENS // RUN).astype(int)
    return sorted({i for a in starts.tolist() for i in range(a, a + RUN)})


def fit(docs: DataFrame, key: str, text: str) -> Field | None:
    marked = docs.where(F.col(text).rlike("[0-9@]")).select(F.xxhash64(key, text).alias("rid"))
    chosen = marked.distinct().orderBy("rid").limit(SAMPLE)
    rows = docs.select(F.xxhash64(key, text).alias("rid"), F.col(text).alias("text")).join(F.broadcast(chosen), "rid").dropDuplicates(["rid"])  # at most SAMPLE hashes

    def make():
        def step(rids: list, texts: list) -> tuple:
            words, labels, beside = [], [], []
            for t in texts:
                base, dropped = base_spans(t)
                places = tokens(t)
                used = spread_over(places)
                own, marks = [places[i] for i in used], []
                for a, b in own:
                    kind = next((k + 1 for k, c, d in base if c < b and a < d), 0)
                    marks.append(-1 if not kind and any(c < b and a < d for c, d in dropped) else kind)
                words.append([t[a:b] for a, b in own])
                labels.append(marks)
                beside.append([k > 0 and used[k - 1] == used[k] - 1 and t[own[k - 1][1] : a].isspace() for k, (a, _) in enumerate(own)])
            return rids, words, labels, beside

        return step

    columns = [F.col("rid"), F.col("text")]
    got = map_batches(rows, columns, make, "rid long, words array<string>, labels array<int>, beside array<boolean>").orderBy("rid").limit(SAMPLE).collect()
    words = [w for r in got for w in r.words]
    y = np.array([v for r in got for v in r.labels], np.int64)
    if not len(y) or y.max() < 1:
        return None
    beside = np.array([v for r in got for v in r.beside], bool)
    chained = np.stack([np.flatnonzero(beside) - 1, np.flatnonzero(beside)], 1)
    skips = joined([likeness(w) for w in words], [k for k, r in enumerate(got) for _ in r.words])
    reader = Reader()
    x = np.array([reader.shape(w) for w in words])
    return learn(x, np.maximum(y, 0), chained, skips, (y >= 0).astype(float))


def find(docs: DataFrame, key: Column, text: Column, field: Field | None) -> DataFrame:
    """key, base and spans: arrays of (kind, start, end), sorted by kind and start. No shuffle."""
    kind = docs.select(key.alias("key")).schema["key"].dataType.simpleString()

    def make():
        reader = Reader()

        def step(keys: list, texts: list) -> tuple:
            base = [base_spans(t)[0] for t in texts]
            spans = [list(b) for b in base]
            if field is not None:
                places = [tokens(t) for t in texts]
                own = [k for k, p in enumerate(places) if p]
                if own:
                    chances = field.marginals(*reader.graph([texts[k] for k in own], [places[k] for k in own]))
                    at = 0
                    for k in own:
                        spans[k] += added(texts[k], places[k], chances[at : at + len(places[k])], base[k])
                        at += len(places[k])
            named = lambda found: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(found)]
            return keys, [named(b) for b in base], [named(s) for s in spans]

        return step

    span = "array<struct<kind:string,start:int,end:int>>"
    return map_batches(docs, [key.alias("key"), F.coalesce(text, F.lit("")).alias("text")], make, f"key {kind}, base {span}, spans {span}")

