"""Base spans against the patterns as they stand, marginals against enumeration, spans the field adds."""

import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import personal
from millrace.llm.queries import QUERIES
from tests.conftest import SMALL

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans():
    rng = random.Random(4)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", ".5.6.7", "4111 1111-1111 1111", "4111111111111111", "+1 (650) 555-0100", "+", "-", " ", "9", "00", "é", "(", ")", "a@b.c@d.e", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 12)))
        assert [(personal.KINDS[k], a, b) for k, a, b in personal.base_spans(text)[0]] == plain(text), text
    long = "1" * 200_000 + "a" * 200_000 + "@" + "1." * 100_000 + "+1" * 50_000
    assert personal.base_spans(long)[0] is not None
    assert personal.tokens("b" * 500_000 + " x9 " + "c" * 500_000 + "7") == [(500_001, 500_003), (500_004, 1_000_005)]


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    n = 5
    x = rng.normal(size=(n, personal.WIDTH))
    field = personal.Field(rng.normal(size=(personal.WIDTH, personal.LABELS)) / 4, rng.normal(size=(personal.LABELS, personal.LABELS)), 1.5)
    chained, skips = np.array([[0, 1], [1, 2]]), np.array([[2, 4]])  # a forest: message passing is exact
    own = x @ field.unary + field.outside(chained, n)
    total = np.zeros((n, personal.LABELS))
    for y in itertools.product(range(personal.LABELS), repeat=n):
        e = np.exp(sum(own[i, y[i]] for i in range(n)) + sum(field.chain[y[a], y[b]] for a, b in chained) + sum(field.skip * (y[a] == y[b]) for a, b in skips))
        for i in range(n):
            total[i, y[i]] += e
    assert np.allclose(field.marginals(x, chained, skips), total / total.sum(1, keepdims=True), atol=0.02)


def test_query_on_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op9_personal"](spark, SMALL).collect():
        want = plain(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in PATTERNS]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) <= set(r.spans.split(",")) or not told


def test_added_spans_and_odd_rows(spark):
    rng = random.Random(1)
    rows = []
    for k in range(300):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        card = next(c for c in iter(lambda: str(rng.randint(4 * 10**15, 5 * 10**15)), None) if personal.luhn(c))
        rows.append((k, f"call {phone} now or pay {card} or mail a.{k}@mail.example.com from 10.2.{k % 200}.7 ok, {k} times in {1900 + k}", 0))
    phone, card = "+1 (650) 555-0199", next(str(c) for c in range(4 * 10**15, 5 * 10**15) if personal.luhn(str(c)))
    text = f"so {phone} {card} it is"
    rows += [(1000, text, 0), (1001, None, 0), (1002, "", 0), (1003, "none at all", 0), (1003, "none at all", 0), (None, "x@y.z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    field = personal.fit(df, "doc_id", "text")
    got = {}
    for r in personal.find(df, F.col("doc_id"), F.col("text"), field).collect():
        got.setdefault(r.key, []).append((r.base, [(s.kind, s.start, s.end) for s in r.spans]))
    assert got[1000][0] == ([], [("card", text.index(card), text.index(card) + 16), ("phone", 3, 3 + len(phone))])
    assert all(len(s) == 4 and len(b) == 4 for k in range(300) for b, s in got[k])
    assert got[1001] == got[1002] == [([], [])] and len(got[1003]) == 2 and len(got[None]) == 1
    assert personal.fit(df.where("doc_id = 1003"), "doc_id", "text") is None
    assert personal.find(df.limit(0), F.col("doc_id"), F.col("text"), None).count() == 0


def test_shapes_of_whole_tokens():
    reader, short = personal.Reader(), personal.features("xx@y.example")
    long = "x" * 210 + "@y.example"
    assert (reader.shape(long) == personal.features(long)).all() and (personal.features(long) == short).all()
    assert long not in reader.shapes


def test_learned_tokens_are_spread_over_the_text():
    places = [(i, i + 1) for i in range(5000)]
    used = personal.spread_over(places)
    assert len(used) == personal.SAMPLE_TOKENS and used[0] == 0 and used[-1] == 4999
    assert sum(b - a == 1 for a, b in zip(used, used[1:])) == len(used) - personal.SAMPLE_TOKENS // personal.RUN
    assert personal.spread_over(places[:7]) == list(range(7))
