"""Importance resampling against counting every run of every text."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").encode().lower())
    return [zlib.crc32(b" ".join(w[i : i + k])) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def plain(docs, target, percent=5):
    here, there = [(i, *features(t)) for i, t in docs], [features(t)[0] for t in target]
    s, t = Counter(b for _, f, _ in here for b in f), Counter(b for f in there for b in f)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)}
    rows = []
    for i, f, n in here:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def run(spark, docs, target, percent=5):
    left = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, weight int, line string")
    right = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(left, right, F.col("doc_id"), F.col("text"), F.col("text"), percent)
    return sorted((tuple(r[c] for c in ("key", "n_features", "weight", "score", "rank")) for r in got.collect()), key=str)


def texts(n, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "gamma9", "été", "Ä", "x", "日本", "the", "of", "THE"])
    line = lambda: rng.choice([" ", ", ", "--"]).join(word() for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 6, 12])))
    shared = [line() for _ in range(8)]
    return ["\n".join(rng.choice([line(), rng.choice(shared)]) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


def test_against_all_runs(spark):
    docs = list(enumerate(texts(300, 1)))
    docs += [(900, None), (901, ""), (902, "\n\n"), (903, "one"), (904, "one\ntwo"), (905, "a\nb\nc"), (None, "a b c " * 10), (906, docs[5][1]), (5, docs[5][1]), (5, docs[5][1]), (907, docs[6][1] * 400)]
    docs += [(1000 + i, "one line that very many texts hold\n" + t) for i, t in enumerate(texts(200, 2))]
    target = [*texts(40, 3), None, ""]
    want = plain(docs, target, 30)
    assert sum(r[4] is not None for r in want) > 50
    assert run(spark, docs, target, 30) == want


def test_empty_tables(spark):
    assert run(spark, [], ["a b"]) == []
    docs = list(enumerate(texts(30, 4)))
    assert run(spark, docs, []) == plain(docs, [])


def test_runs_over_line_ends_only():
    words = resample.edge_words(b"one two three four five six")
    assert words == [b"one", b"two", None, b"five", b"six"]
    assert resample.edge_words(b"one two three four") == [b"one", b"two", b"three", b"four"]
    assert resample.edge_words(b"..") == []
