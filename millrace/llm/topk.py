"""Exact top-k search by tiled matrix products (operator 3).

Vectors become whole numbers, floor(64 * x). Rows are packed into tiles of bounded size by a hash of the row:
queries into query tiles, all vectors into shards. Each pair of a query tile and a shard is one matrix product
in one Python call, and only the k best of each query leave it. These lists are merged as a tree, ``FAN`` shards
at a time, until one list is left for each query. Query tiles travel to the shards (they are the smaller side);
shards are shuffled once.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part. Only vectors
of one length are compared. A row's own id is never its candidate, so rows that repeat an id with the same
vector are one query and are no candidates of one another; as candidates of others repeated rows all count.
Ties go to the smaller id. Fewer than k candidates: all. Scores are exact: products run in float64 while they
stay below 2^53, else on Python integers, and components and scores are
held to the range of a long. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a query tile, rows of a shard, shards merged at a time, groups of shards that a query tile goes to.
TILE, SHARD, FAN, GROUPS = 1024, 2048, 16, 1024


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vector as packed doubles of the rows that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad).select(
        F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("v"), F.size(v).alias("dim")
    )


def packed(rows: DataFrame, tiles: int, name: str) -> DataFrame:
    """One row for each tile: ids and the matrix as bytes, sorted by id."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        matrix = np.array(part["v"].tolist(), np.float64)
        return pd.DataFrame({
            "dim": [part["dim"].iloc[0]], name: [part[name].iloc[0]], f"{name}_ids": [part["id"].to_numpy(np.int64).tobytes()], f"{name}_matrix": [matrix.tobytes()],
        })

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", "v", "copy"), F.lit(tiles)).cast("int"))
    return dealt.groupBy("dim", name).applyInPandas(pack, f"dim int, {name} int, {name}_ids binary, {name}_matrix binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    low, high = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
    return np.array([[min(max(int(x), low), high) for x in row] for row in whole(a) @ whole(b).T], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id, without the query's own id. ``ids`` is sorted."""
    use = np.flatnonzero(ids != own)
    if len(use) > k:
        s = scores[use]
        least = np.partition(s, len(s) - k)[len(s) - k]
        above, equal = use[s > least], use[s == least]
        use = np.concatenate([above, equal[: k - len(above)]])
    return scores[use], ids[use]


def search(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score."""
    # of equal rows no more than k can be in a list
    counted = usable(vectors, key, vector).groupBy("id", "v", "dim").agg(F.count("*").alias("n"))
    base = counted.select("id", "v", "dim", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy"))
    asked = usable(queries, key, vector).dropDuplicates().withColumn("copy", F.lit(1))
    shards = max(1, -(-vectors.count() // SHARD))
    tiles = max(1, -(-queries.count() // TILE))
    right = packed(base, shards, "shard")
    # a query tile travels once to each group of shards; which there are is known beforehand
    group = max(1, shards // GROUPS)
    groups = F.sequence(F.lit(0), F.lit((shards - 1) // group))
    left = packed(asked, tiles, "tile").select("*", F.explode(groups).alias("group"))
    pairs = left.join(right.withColumn("group", F.floor(F.col("shard") / group).cast("int")), ["dim", "group"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                dim = int(r.dim)
                q, v = (np.frombuffer(x, np.float64).reshape(-1, dim) for x in (r.tile_matrix, r.shard_matrix))
                q_ids, v_ids = (np.frombuffer(x, np.int64) for x in (r.tile_ids, r.shard_ids))
                s = products(q, v)
                found = [best(s[i], v_ids, q_ids[i], k) for i in range(len(q_ids))]
                yield pd.DataFrame({
                    "query_id": np.repeat(q_ids, [len(f[0]) for f in found]), "vec_id": np.concatenate([f[1] for f in found]),
                    "score": np.concatenate([f[0] for f in found]), "place": r.shard, "dim": dim,
                })

    lists = pairs.mapInPandas(score, "query_id long, vec_id long, score long, place int, dim int")
    while True:
        shards = -(-shards // FAN)
        lists = lists.withColumn("place", F.floor(F.col("place") / FAN).cast("int"))
        one = Window.partitionBy("query_id", "dim", "place").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(one)).where(F.col("rank") <= k)
        if shards <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
