"""Whitening of vectors by their leading principal components, found by Jacobi-Davidson (operator 11).

Components become whole numbers, floor(256 * c). The fit list holds each distinct vector once. Its covariance is never
formed: it is only known through products with blocks of columns, each one Spark job over packed tiles of the fit list,
in which every tile is centred before it is multiplied. The solver keeps an orthonormal subspace on the driver (a few
columns of the vectors' length) and repeats: Rayleigh-Ritz in the subspace; a Ritz vector whose residual has reached
double precision is locked; for the others the correction equation, projected away from locked and current vectors,
is solved by inner MINRES, all columns side by side so that one job serves them all; the corrections widen the
subspace, which is cut back to its best Ritz vectors when it is full. It ends when all wanted vectors are locked.

Scale: a job reads the tiles (bounded number of rows each) and sends length times columns numbers, summed in Spark
before they reach the driver. Sums are whole numbers and exact. Copies of a vector fall together before they move.

Defined results: vectors that are null, empty, or hold null or non-finite entries take no part. Vectors of one length
can be fitted together; where lengths differ, those of the commonest length do (of equally common ones the shortest)
and the others take no part. Rows that repeat a vector or an id each give their rows. Components without variance
(a rank below the number asked for, a single distinct vector) have no rows. Equal eigenvalues: any unit basis of their
space. Entries are held to 2^53 either way, deviations to the range of a long. Empty tables give no rows. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_batches
from millrace.llm.shared import cut

#: Steps of a component, components, entries of a tile, columns of the subspace when it is cut back and at most.
SCALE, WANTED, TILE_ENTRIES, KEPT, WIDEST = 256, 4, 1 << 18, 12, 40
#: A residual of this share of the largest eigenvalue counts as double precision; steps of MINRES, outer rounds at most.
CLOSE, STEPS, ROUNDS = 2.0**-46, 12, 200
#: Numbers of all tasks that one task adds up.
GATHERED = 1 << 20
LONGEST = 2**63 - 1


@dataclass
class Whitener:
    """The fit: rows, sums by dimension, eigenvalues and components (rows), trace, residuals, products used."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    products: int = 0
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole(df: DataFrame, key: Column, vector: Column) -> DataFrame:
    """key and x, the entries as whole numbers, of the rows that take part."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    held = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(1 << 53)), F.lit(-(1 << 53))).cast("long")
    rows = df.where(vector.isNotNull() & (F.size(vector) > 0) & ~bad)
    return rows.select(key.cast("long").alias("key"), F.transform(vector, held).alias("x"))


def packed(rows: DataFrame, dim: int) -> DataFrame:
    """Tiles of the fit list: rows and their numbers as bytes."""
    most = max(1, TILE_ENTRIES // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                values = batch.column(0).slice(at, most).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([values.astype("<i8").tobytes()], pa.binary())], ["tile"])

    return rows.select("x").mapInArrow(run, "tile binary")


def summed(tiles: DataFrame, dim: int, make: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all tiles of ``size`` numbers that a function makes of a tile's rows; added up in Spark, place by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for raw in batch.column(0):
                total += make(np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dim)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "v"])

    out = np.zeros(size)
    for r in gathered(tiles.mapInArrow(run, "at long, v double"), size).agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def gathered(parts: DataFrame, size: int):
    """Rows of all tasks grouped by place, in one exchange to as few tasks as their number asks for."""
    tasks = 1 + parts.rdd.getNumPartitions() * size // GATHERED
    return parts.repartition(tasks, "at").groupBy("at")


def exact_sums(tiles: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension: upper and lower bits are added apart, so that no task leaves a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * dim + 1, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dim)
                total += np.concatenate([(x >> 27).sum(0), (x & ((1 << 27) - 1)).sum(0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    added = gathered(tiles.mapInArrow(run, "at long, v long"), 2 * dim + 1).agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = {r["at"]: int(r["v"]) for r in added.collect()}
    return out[2 * dim], [(out[i] << 27) + out[dim + i] for i in range(dim)]


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the block's part orthogonal to the columns of ``against``; columns that vanish go."""
    kept = against
    for column in block.T:
        size = np.linalg.norm(column)
        if not size or not np.isfinite(size):
            continue
        v = column / size
        for _ in range(3):
            v = v - kept @ (kept.T @ v)
            size = np.linalg.norm(v)
            if size < 1e-10:
                break
            v = v / size
        if size >= 1e-10:
            kept = np.column_stack([kept, v])
    return kept[:, against.shape[1] :]


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Approximate solutions of a symmetric system for each column of ``right``, side by side.

    ``product`` multiplies a block, column j by the matrix of column j. The residuals fall by ``rate`` or the steps end.
    """
    size = np.linalg.norm(right, axis=0)
    live = size > 0
    safe = lambda x: np.where(x == 0, 1.0, x)
    solved, v_old, v = np.zeros_like(right), np.zeros_like(right), right / safe(size)
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    beta, eta, left = np.zeros_like(size), size.copy(), size.copy()
    c_old, c, s_old, s = np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    for _ in range(steps):
        z = product(v) - beta * v_old
        alpha = (v * z).sum(0)
        z = z - alpha * v
        beta_new = np.linalg.norm(z, axis=0)
        # the two last rotations, then a new one that makes the entry below the diagonal vanish
        delta = c * alpha - c_old * s * beta
        rho1 = np.hypot(delta, beta_new)
        rho2, rho3 = s * alpha + c_old * c * beta, s_old * beta
        live = live & (rho1 > 1e-14 * size)
        c_old, s_old = c, s
        c, s = np.where(live, delta / safe(rho1), 1.0), np.where(live, beta_new / safe(rho1), 0.0)
        w_old, w = w, np.where(live, (v - rho3 * w_old - rho2 * w) / safe(rho1), 0.0)
        solved = solved + np.where(live, c * eta, 0.0) * w
        eta = np.where(live, -s * eta, 0.0)
        left = np.where(live, left * np.abs(s), left)
        live = live & (beta_new > 1e-14 * np.abs(alpha).max(initial=0))
        v_old, v, beta = v, np.where(live, z / safe(beta_new), 0.0), beta_new
        if not live.any() or (left[live] <= rate * size[live]).all():
            break
    return solved


def leading(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest eigenvalues, their unit vectors (columns) and residuals of a symmetric positive matrix known by its products."""
    wanted = min(wanted, dim)
    start = np.random.default_rng(11).standard_normal((dim, min(dim, wanted + 2)))
    basis = orthonormal(start, np.zeros((dim, 0)))
    image = product(basis)
    locked, values, residuals, best, stuck = np.zeros((dim, 0)), [], [], np.inf, 0
    for outer in range(ROUNDS):
        h = basis.T @ image
        theta, mix = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-theta)
        theta, mix = theta[order], mix[:, order]
        ritz, ritz_image = basis @ mix, image @ mix
        scale = max([abs(theta[0]) if len(theta) else 0.0, *map(abs, values)]) or 1.0
        rest = wanted - len(values)
        # residuals are taken against the locked vectors too, whose part a product brings back by rounding
        r = ritz_image[:, :rest] - ritz[:, :rest] * theta[:rest]
        r = r - locked @ (locked.T @ r)
        sizes = np.linalg.norm(r, axis=0)
        whole_space = basis.shape[1] + locked.shape[1] >= dim
        # rounding of the products may keep residuals a little above the goal: when nothing gets better, they are there
        worst = float(sizes.max(initial=0.0))
        stuck = 0 if worst < best / 2 else stuck + 1
        best = min(best, worst)
        goal = scale * (CLOSE if stuck < 4 or worst > 2.0**-36 * scale else 2.0**-36)
        done = 0
        while done < len(sizes) and (sizes[done] <= goal or whole_space):
            done += 1
        if done:
            # only a leading run is locked, so that the locked ones are the largest
            values += theta[:done].tolist()
            residuals += sizes[:done].tolist()
            locked = np.column_stack([locked, ritz[:, :done]])
            basis, image = ritz[:, done:], ritz_image[:, done:]
            theta, r, sizes = theta[done:], r[:, done:], sizes[done:]
            best, stuck = np.inf, 0
            if len(values) == wanted or not basis.shape[1]:
                break
        elif basis.shape[1] + rest > WIDEST:
            basis, image = ritz[:, :KEPT], ritz_image[:, :KEPT]
        else:
            basis, image = ritz, ritz_image
        rest = min(wanted - len(values), len(sizes))
        u, shift = basis[:, :rest], theta[:rest]
        fixed = np.column_stack([locked, u])

        def projected(block: np.ndarray) -> np.ndarray:
            block = block - fixed @ (fixed.T @ block)
            out = product(block) - block * shift
            return out - fixed @ (fixed.T @ out)

        far = sizes > 1e-2 * scale
        # far from a solution the correction equation says little: the residuals themselves widen the subspace
        t = -r if far.all() else minres(projected, -(r - fixed @ (fixed.T @ r)), STEPS, max(0.5 ** (outer + 1), 1e-4))
        fresh = orthonormal(np.column_stack([t, r]) if outer % 4 == 3 else t, np.column_stack([locked, basis]))
        if not fresh.shape[1]:
            fresh = orthonormal(np.random.default_rng(outer).standard_normal((dim, rest)), np.column_stack([locked, basis]))
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, product(fresh)])
    return np.array(values), locked, np.array(residuals)


def fit(rows: DataFrame, wanted: int = WANTED) -> Whitener | None:
    """Fit on the distinct vectors of rows with a column x of whole numbers; None when there are none."""
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), "dim").first()
    if common is None:
        return None
    dim = common.dim
    tiles = cut(packed(rows.where(F.size("x") == dim).select("x").distinct(), dim), "tiles")
    n, sums = exact_sums(tiles, dim)
    mean = np.array([s / n for s in sums])
    used = 0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal used
        used += 1

        def one(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return summed(tiles, dim, one, block.size).reshape(block.shape) / n

    trace = float(summed(tiles, dim, lambda x: np.array([((x - mean) ** 2).sum()]), 1)[0]) / n
    if not trace:
        return Whitener(n, sums, np.zeros(0), np.zeros((0, dim)), 0.0, np.zeros(0))
    values, vectors, residuals = leading(product, dim, wanted)
    held = values > trace * dim * 2.0**-52
    got = Whitener(n, sums, values[held], vectors[:, held].T, trace, residuals[held], used)
    k = len(got.values)
    whiten = got.vectors.T / np.sqrt(got.values)

    def spread_of(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ whiten
        return w.T @ w

    got.identity_error = float(np.abs(summed(tiles, dim, spread_of, k * k).reshape(k, k) / n - np.eye(k)).max(initial=0.0))
    return got


def whitened(rows: DataFrame, fitted: Whitener) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each row and component."""
    dim, k = len(fitted.sums), len(fitted.values)
    n, sums, mean = fitted.n, fitted.sums, fitted.mean
    whiten = fitted.vectors.T / np.sqrt(fitted.values)

    def make():
        # whole numbers as longs where no step can leave their range, else as Python's
        wide = np.array(sums, object)

        def deviations(x: np.ndarray) -> list[int]:
            most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
            if most < 1 << 62 and most * most * dim < 1 << 63:
                return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
            return [min(int(d), LONGEST) for d in ((n * x.astype(object) - wide) ** 2).sum(1)]

        def step(keys: list, vectors: list):
            x = np.array(vectors, np.int64).reshape(-1, dim)
            w = (x - mean) @ whiten
            repeat = np.repeat(np.arange(len(keys)), k)
            return [keys[i] for i in repeat], np.tile(np.arange(1, k + 1, dtype=np.int32), len(keys)), np.repeat(np.array(deviations(x), np.int64), k), w.ravel()

        def typed(keys: list, vectors: list):
            key, component, deviation, white = step(keys, vectors)
            return key, pa.array(component), pa.array(deviation), pa.array(white)

        return typed

    usable = rows.where(F.size("x") == dim) if k else rows.limit(0)
    got = map_batches(usable, [F.col("key"), F.col("x")], make, "key long, component int, deviation long, whitened double")
    shares = F.array(*[F.lit(float(v / fitted.trace)) for v in fitted.values]) if k else F.array(F.lit(0.0))
    return got.select(
        "key", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("component")).alias("explained"),
        F.lit(fitted.identity_error).alias("identity_error"),
    )


def whiten(df: DataFrame, key: Column, vector: Column, wanted: int = WANTED) -> DataFrame:
    """Fit on the distinct vectors of a table and whiten every row of it."""
    rows = whole(df, key, vector)
    fitted = fit(rows, wanted)
    if fitted is None:
        fitted = Whitener(1, [0], np.zeros(0), np.zeros((0, 1)), 0.0, np.zeros(0))
    return whitened(rows, fitted)
