"""The byte network: covering chunks, gradients by held-out quality, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality
from millrace.llm.queries import QUERIES


def test_chunks_cover_every_place():
    for n in [0, 1, 511, 512, 513, 960, 961, 5000]:
        text = bytes(np.random.default_rng(n).integers(1, 255, n, dtype=np.uint8))
        parts = quality.chunks(text)
        step = quality.CHUNK - quality.OVERLAP
        covered = set()
        for k, part in enumerate(parts):
            assert part[: quality.CHUNK].tobytes().rstrip(b"\0") == text[k * step : k * step + quality.CHUNK]
            covered.update(range(k * step, min(n, k * step + quality.CHUNK)))
        assert covered == set(range(n))


def test_pooling_against_a_loop():
    rng = np.random.default_rng(1)
    net = quality.Network(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), np.zeros((1, 1)), np.zeros(1))
    text = bytes(rng.integers(0, 255, 700, dtype=np.uint8))
    parts = quality.chunks(text)
    got, _ = net.pooled(parts)
    for k, part in enumerate(parts):
        for f in (0, 5):
            best = max(sum(net.filters[w, part[p + w], f] for w in range(quality.WIDTH)) for p in range(quality.CHUNK))
            assert got[k, f] == pytest.approx(max(best, 0), rel=1e-4)


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op1_quality"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    marked = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(got[i].score, y) for i, y in marked.items() if got[i].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "a", 0), (2, "word " * 40_000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    one = quality.fit(docs, labels, F.lit(True))
    assert one == pytest.approx(2 / 3)
    assert [r.score for r in quality.scores(docs, one, F.col("doc_id"), F.col("text")).collect()] == [one] * 4
    assert quality.fit(docs, labels.limit(0), F.lit(True)) == 0.5
    both = quality.fit(docs, labels.limit(1).union(spark.createDataFrame([(2, 0, 0)], labels.schema)), F.lit(True))
    rows = quality.scores(docs, both, F.col("doc_id"), F.col("text")).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert quality.scores(docs.limit(0), both, F.col("doc_id"), F.col("text")).count() == 0


def test_a_document_repeated_often(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 5)
    docs = [(i, ("good words in a line " if i % 2 else "zx# qq! ") * 5) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    usable = F.lit(True)
    once = quality.fit(table(docs), labels, usable)
    often = quality.fit(table(docs + [d for d in docs[:20] for _ in range(12)]), labels, usable)
    assert isinstance(often, quality.Network)
    assert np.allclose(once.score(docs[0][1].encode()), often.score(docs[0][1].encode()))


def test_score_against_a_loop():
    """Filters, mean and maximum over the chunks, hidden layer and probability, one by one."""
    rng = np.random.default_rng(2)
    shapes = (quality.WIDTH, 256, quality.FILTERS), (2 * quality.FILTERS + 1, quality.HIDDEN), (quality.HIDDEN + 1,)
    net = quality.Network(*(rng.normal(size=s).astype(np.float32) for s in shapes))
    text = bytes(rng.integers(1, 255, 1200, dtype=np.uint8))
    tops = []
    for part in quality.chunks(text):
        answers = [[sum(float(net.filters[w, part[at + w], f]) for w in range(quality.WIDTH)) for at in range(quality.CHUNK)] for f in range(quality.FILTERS)]
        tops.append([max(0.0, *a) for a in answers])
    tops = np.array(tops)
    hidden = np.tanh(np.concatenate([tops.mean(0), tops.max(0), [1.0]]) @ net.first)
    z = float(np.append(hidden, 1.0) @ net.last)
    assert len(tops) == 3 and abs(net.score(text) - 1 / (1 + np.exp(-z))) < 1e-3
