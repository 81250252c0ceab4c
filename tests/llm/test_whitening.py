"""Whitening against a dense eigensolver, and the solver by itself."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import whitening


def run(spark, rows, wanted=4):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, x int, tile string")
    return whitening.whiten(table, F.col("vec_id"), F.col("embedding"), wanted).collect()


def usable(rows, dim):
    fine = [(i, v) for i, v in rows if v and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, tuple(math.floor(256 * c) for c in v)) for i, v in fine]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 9)) * [3, 2.9, 2.8, 2, 1, 0.5, 0.4, 0.3, 0.2]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[7].tolist()) for i in range(300)]
    return [*rows, (7, base[8].tolist()), (None, base[9].tolist()), (2000, None), (2001, []), (2002, [math.nan] * 9), (2003, [None] * 9), (2004, [math.inf] * 9), (2005, [1.0])]


def test_against_dense_solver(spark, vectors):
    got = run(spark, vectors)
    rows = usable(vectors, 9)
    fit = np.array(sorted({x for _, x in rows}))
    n, sums = len(fit), fit.sum(0)
    values, components = np.linalg.eigh(np.cov(fit.T, bias=True))
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    want = {}
    for i, x in rows:
        deviation = sum((n * int(c) - int(s)) ** 2 for c, s in zip(x, sums))
        for k in range(1, 5):
            white = (np.array(x) - sums / n) @ components[:, -k] / math.sqrt(values[-k])
            want.setdefault((i, k), []).append((deviation, abs(white), values[-k] / values.sum()))
    signs = {}
    for r in got:
        near = [w for w in want[r.key, r.component] if w[0] == r.deviation]
        assert any(abs(abs(r.whitened) - w[1]) < 1e-9 and abs(r.explained - w[2]) < 1e-12 for w in near)
        signs.setdefault(r.component, []).append((r.deviation, r.whitened))
    assert max(r.identity_error for r in got) < 1e-9
    for k in range(1, 5):
        found = sorted({(r.deviation, r.whitened) for r in got if r.component == k})
        whole = {d: ((np.array(x) - sums / n) @ components[:, -k] / math.sqrt(values[-k])) for i, x in rows for d in [sum((n * int(c) - int(s)) ** 2 for c, s in zip(x, sums))]}
        turned = {round(w / whole[d]) for d, w in found if abs(whole[d]) > 1e-6}
        assert len(turned) == 1


def test_few_rows_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [])]) == []
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    got = run(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])])
    assert [(r.key, r.component, r.n, r.deviation) for r in sorted(got, key=lambda r: r.key)] == [(1, 1, 2, 65536), (2, 1, 2, 65536), (3, 1, 2, 65536)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == 1.0 for r in got)


def test_deviation_is_exact_for_large_entries(spark):
    rows = [(0, [3e9, 1.0]), (1, [-3e9, 2.0]), (2, [1e9, 0.5]), (3, [5e300, 1.0])]
    held = [[min(max(math.floor(Fraction(c) * 256), -(2**53)), 2**53) for c in v] for _, v in rows]
    n, sums = 4, [sum(c) for c in zip(*held)]
    for r in run(spark, rows, 1):
        assert r.deviation == min(sum((n * c - s) ** 2 for c, s in zip(held[r.key], sums)), 2**63 - 1)


@pytest.mark.parametrize("values", [[5.0, 5.0, 5.0, 5.0, 1.0], [1 + 1e-4 * i for i in range(30)], [2.0**-i for i in range(50)], [1.0, 0, 0, 0, 0], [3.0]])
def test_solver(values):
    rng = np.random.default_rng(5)
    d = len(values)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    matrix = (q * values) @ q.T
    got, vectors, residuals = whitening.leading(lambda b: matrix @ b, d, 4)
    want = np.sort(values)[::-1][:4]
    assert np.allclose(got, want, atol=1e-12 * max(values))
    assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-12)
    assert np.abs(matrix @ vectors - vectors * got).max() < 1e-11 * max(values)


def test_solver_on_many_dimensions():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 300))
    matrix, products = np.cov(x.T), 0

    def product(b):
        nonlocal products
        products += 1
        return matrix @ b

    got, vectors, residuals = whitening.leading(product, 300, 4)
    assert np.allclose(got, np.linalg.eigvalsh(matrix)[::-1][:4], rtol=1e-12)
    assert residuals.max() < 1e-12 and products < 250


def test_minres_side_by_side():
    rng = np.random.default_rng(7)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    shifts = np.array([0.0, 1.0, -2.0])
    right = rng.standard_normal((20, 3))
    got = whitening.minres(lambda b: a @ b - b * shifts, right, 60, 1e-12)
    for j, s in enumerate(shifts):
        assert np.allclose((a - s * np.eye(20)) @ got[:, j], right[:, j], atol=1e-6)
