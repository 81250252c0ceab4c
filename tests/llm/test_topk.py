"""Exact search against plain products."""

import random

from millrace.llm import topk


def plain(queries, vectors, k):
    import math

    held = lambda s: min(max(s, -(2**63) + 1), 2**63 - 1)
    whole = lambda v: [math.floor(64 * x) for x in v]
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    out = []
    for q, a in {(i, tuple(v)) for i, v in queries if i is not None and ok(v)}:
        found = sorted((-held(sum(x * y for x, y in zip(whole(a), whole(b), strict=True))), i) for i, b in vectors if i is not None and ok(b) and i != q and len(a) == len(b))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def run(spark, queries, vectors, k):
    schema = "vec_id long, embedding array<double>, score int"
    make = lambda rows: spark.createDataFrame([(i, v, 1) for i, v in rows], schema)
    return sorted(tuple(r) for r in topk.search(make(queries), make(vectors), k).collect())


def test_search(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.01, 1.0]) for _ in range(6)]) for i in range(300)]
    rows += [(None, [1.0] * 6), (900, None), (901, [float("nan")] * 6), (902, [None] * 6), (903, [float("inf")] * 6), (904, []), (905, [1.0]), (906, [0.5]), (299, rows[299][1]), (907, [1e30] * 6), (908, [2e30] * 6)]
    queries = [r for r in rows if r[0] is None or r[0] % 20 == 0 or r[0] >= 900]
    want = plain(queries, rows, 7)
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "FAN", 3)
    got = run(spark, queries, rows, 7)
    assert got == want


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0])], [(0, [1.0]), (1, [2.0])], 20) == [(0, 1, 1, 64 * 128)]
    assert run(spark, [], [], 20) == []
