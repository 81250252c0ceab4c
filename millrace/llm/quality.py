"""Quality classifier: a convolutional network over bytes (operator 1).

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` places that overlap by ``OVERLAP`` and cover the whole
text. ``FILTERS`` learned filters look at ``WIDTH`` bytes from every place; each filter's largest response in a
chunk is kept. The mean and the maximum over the chunks go through one hidden layer to one probability.

Training: labelled rows chosen by a hash of their id, at most ``SAMPLE`` of each label and ``SAMPLE_CHUNKS``
chunks spread over each text; these bounds make the sample fit the driver. Scores read whole texts. The
weights of both labels are equal in training; the share of label 1 among all usable labels is put back
into the bias, so a score is a probability for the table as it is.

Defined results: null and empty texts are one empty chunk. A document with several labels has the highest. Of rows that
repeat an id one text is learned from, the first in order; each row is scored.
With no usable label every score is 0.5; with one label only, the score is that of the smoothed share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import filter_batches, map_batches

WIDTH, FILTERS, HIDDEN = 5, 24, 16
CHUNK, OVERLAP = 512, 64
SAMPLE, SAMPLE_CHUNKS = 2_000, 6
EPOCHS, LEAST_STEPS, BATCH, RATE = 12, 150, 64, 0.004
#: Chunks convolved at a time: the responses stay in the cache.
BLOCK = 8


def chunks(text: bytes) -> np.ndarray:
    """All chunks of a text, zeros after its end."""
    step = CHUNK - OVERLAP
    count = max(1, -(-(len(text) - OVERLAP) // step))
    padded = np.zeros((count - 1) * step + CHUNK + WIDTH - 1, np.uint8)
    padded[: min(len(text), len(padded))] = np.frombuffer(text, np.uint8)[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK + WIDTH - 1)[::step]


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    first: np.ndarray  # (2 FILTERS + 1) x HIDDEN, with the bias
    last: np.ndarray  # HIDDEN + 1, with the bias

    def pooled(self, parts: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of every filter in each chunk, and its place."""
        top = np.empty((len(parts), FILTERS), np.float32)
        place = np.empty((len(parts), FILTERS), np.int64) if where else None
        for at in range(0, len(parts), BLOCK):
            block = parts[at : at + BLOCK]
            answer = self.filters[0].take(block[:, :CHUNK], 0)
            for w in range(1, WIDTH):
                answer += self.filters[w].take(block[:, w : w + CHUNK], 0)
            top[at : at + BLOCK] = answer.max(1)
            if place is not None:
                place[at : at + BLOCK] = answer.argmax(1)
        return np.maximum(top, 0), place

    def combined(self, pooled: np.ndarray) -> float:
        x = np.concatenate([pooled.mean(0), pooled.max(0), [1]])
        return float(np.append(np.tanh(x @ self.first), 1) @ self.last)

    def score(self, text: bytes) -> float:
        z = self.combined(self.pooled(chunks(text))[0])
        return float(1 / (1 + np.exp(-z))) if z > -500 else 0.0


def train(texts: list[list[bytes]], labels: list[int], share: float, seed: int = 7) -> Network:
    """Fit by Adam on documents given as lists of chunks."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(0, 0.2, (2 * FILTERS + 1, HIDDEN)).astype(np.float32),
        np.zeros(HIDDEN + 1, np.float32),
    )
    net.last[:-1] = rng.normal(0, 0.3, HIDDEN)
    docs = [np.stack([np.frombuffer(c, np.uint8) for c in t]) for t in texts]
    y = np.array(labels, np.float32)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32)
    params = [net.filters, net.first, net.last]
    moments, squares, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(docs)) if len(docs) >= BATCH else LEAST_STEPS)):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            sizes = np.array([len(docs[i]) for i in own])
            bounds = np.append(0, np.cumsum(sizes))
            parts = np.concatenate([docs[i] for i in own])
            pooled, place = net.pooled(parts, True)
            mean = np.add.reduceat(pooled, bounds[:-1], 0) / sizes[:, None]
            high = np.maximum.reduceat(pooled, bounds[:-1], 0)
            x = np.concatenate([mean, high, np.ones((len(own), 1))], 1).astype(np.float32)
            hidden = np.tanh(x @ net.first)
            out = np.concatenate([hidden, np.ones((len(own), 1), np.float32)], 1)
            error = (1 / (1 + np.exp(-np.clip(out @ net.last, -30, 30))) - y[own]) * weight[own] / len(own)
            back = error[:, None] * net.last[:-1] * (1 - hidden**2)
            into = back @ net.first.T
            doc = np.repeat(np.arange(len(own)), sizes)
            down = into[doc, :FILTERS] / sizes[doc, None]
            down += into[doc, FILTERS : 2 * FILTERS] * (pooled == high[doc])
            down *= pooled > 0
            grad = np.zeros((WIDTH, 256 * FILTERS), np.float32)
            column = np.arange(FILTERS)
            for w in range(WIDTH):
                byte = np.take_along_axis(parts, place + w, 1).astype(np.int64)
                grad[w] = np.bincount((byte * FILTERS + column).ravel(), down.ravel(), 256 * FILTERS)
            grads = [grad.reshape(net.filters.shape) + 1e-4 * net.filters, x.T @ back + 1e-4 * net.first, out.T @ error]
            step += 1
            for p, g, m, s in zip(params, grads, moments, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.last[-1] += np.log(share / (1 - share))  # the share of label 1, in training one half
    return net


def fit(documents: DataFrame, labels: DataFrame, usable: Column) -> Network | float:
    """Learn from labelled rows for which ``usable`` (a condition on doc_id) holds; a number where nothing can be learned."""
    known = labels.where(usable & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return 0.5
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    chosen = None
    for label in (0, 1):
        own = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = own if chosen is None else chosen.union(own)

    def make():
        def step(ids: list, texts: list, quality: list) -> tuple:
            out = []
            for t in texts:
                c = chunks(t)
                at = np.unique(np.linspace(0, len(c) - 1, min(SAMPLE_CHUNKS, len(c))).astype(int))
                out.append([c[i].tobytes() for i in at])
            return ids, out, quality

        return step

    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most twice SAMPLE ids
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    columns = [F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("quality").cast("int").alias("quality")]
    got = map_batches(rows, columns, make, "doc_id long, parts array<binary>, quality int").orderBy("doc_id").limit(2 * SAMPLE).collect()
    if len({r.quality for r in got}) < 2:
        return share
    return train([[bytes(p) for p in r.parts] for r in got], [r.quality for r in got], share)


def scores(documents: DataFrame, net: Network | float, key: Column, text: Column) -> DataFrame:
    """key, score: the probability of label 1. No shuffle."""
    kind = documents.select(key.alias("key")).schema["key"].dataType.simpleString()

    def make():
        rate = net.score if isinstance(net, Network) else lambda t: float(net)
        return lambda keys, texts: (keys, [rate(t) for t in texts])

    return map_batches(documents, [key.alias("key"), F.coalesce(text, F.lit("")).cast("binary").alias("text")], make, f"key {kind}, score double")


def accepted(documents: DataFrame, net: Network | float, text: str, least: float) -> DataFrame:
    """The rows, with all of their columns, whose text scores ``least`` or more. No shuffle."""

    def make():
        rate = net.score if isinstance(net, Network) else lambda t: float(net)
        return lambda texts: [rate((t or "").encode()) >= least for t in texts]

    return filter_batches(documents, text, make)
