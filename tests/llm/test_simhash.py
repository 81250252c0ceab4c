"""Fingerprints and components against plain loops."""

import random

import numpy as np
import xxhash

from millrace.llm import simhash
from millrace.llm.components import components
from millrace.llm.queries import QUERIES
from tests.conftest import SMALL


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """fps: {id: fingerprint} -> {id: smallest reachable id}."""
    ids, seen = sorted(fps), {}
    for i in ids:
        if i in seen:
            continue
        stack = [i]
        seen[i] = i
        while stack:
            x = stack.pop()
            for j in ids:
                if j not in seen and bin(fps[x] ^ fps[j]).count("1") <= 4:
                    seen[j] = i
                    stack.append(j)
    return seen


def test_fingerprints():
    for text in ["", " \n", "One", "A b c", "a B c d", "x " * 5000, "Ünï a b c d\x0be f", "a b c d e f g h"]:
        assert simhash.fingerprint(text.encode(), 4) == plain_fingerprint(text)


def test_bit_sliced_distances():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    values = np.concatenate([base, base ^ np.uint64(0b10110001), base ^ np.uint64(1 << 40), rng.integers(0, 2**63, 1000, dtype=np.uint64)])
    near = simhash.within(values[:300], simhash.planes(values), len(values))
    assert (near == (np.bitwise_count(values[:300, None] ^ values[None]) <= 4)).all()


def test_query_on_documents(spark):
    docs = {r.doc_id: plain_fingerprint(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = plain_components(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, SMALL).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in docs.items()}


def test_hot_key_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 20)
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(50)}
    centre = rng.getrandbits(64)
    for _ in range(150):  # one cluster and a chain
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), 3)))
    x = rng.getrandbits(64)
    for _ in range(60):
        x ^= sum(1 << b for b in rng.sample(range(20), 4))
        fps.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    found = components(simhash.near_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")))
    roots = {r.node: r.root for r in found.collect()}
    want = plain_components({f: f for f in fps})
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert {g for g in groups({signed(k): signed(v) for k, v in want.items()}) if len(g) > 1} == groups(roots)


def test_long_chain_and_star(spark):
    n = 2_000
    edges = [(i, i + 1) for i in range(n)] + [(10_000, 10_001 + i) for i in range(n)] + [(7, 7), (5, 4), (4, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == 2 * n + 2 and len({r.root for r in got if r.node < 10_000}) == 1 and len({r.root for r in got}) == 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(3, None, 1), (2, "", 1), (2, "", 1), (None, "a b c d", 1), (9, "A b  c\td", 1)], "doc_id long, text string, fp int")
    got = sorted((str(r.key), r.fp, r.component) for r in simhash.near_duplicates(df, F.col("doc_id"), F.col("text"), 4).collect())
    assert [x[2] for x in got] == [2, 2, 2, 9, 9] and simhash.near_duplicates(df.limit(0), F.col("doc_id"), F.col("text"), 4).count() == 0
