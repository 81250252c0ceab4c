"""SimHash near-duplicates with bit-sliced distances (operator 2).

Fingerprint: A-Z are lower-cased, words are runs without white space, shingles are ``size`` words with spaces
between (fewer words: all of them; none: fingerprint zero). A bit is set if more than half of the shingles'
XXH64 hashes (seed 42) have it.

Links: two fingerprints within ``RADIUS`` bits agree on at least two of six blocks of the 64 bits, so they meet
under one of fifteen keys of two blocks. Equal fingerprints are one row before that. A key shared by more than
``BUCKET`` fingerprints is dealt into tiles, and each pair of tiles is a bucket of its own: no task holds an
unbounded group, and no link is lost. In a bucket the fingerprints are stored as bit planes; the distances of
up to ``QUERIES`` fingerprints to all others are counted at once, 64 in a machine word, by carry-save counters,
and a block of lanes is abandoned when all of its lanes are beyond the radius. A bucket gives one link for each
fingerprint (to the first of its component there), not its pairs.

Defined results: null text is empty. Rows with one id count as several rows; null ids get the component of their
fingerprint, and never name it unless no other id is there. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import ROWS, map_batches
from millrace.llm.components import components
from millrace.llm.shared import cut
from millrace.operators.verdict import filter_of

#: Most bits of the Bloom filter by which texts are sifted.
BITS = 1 << 26
SEED, RADIUS = 42, 4
#: First bit and width of the six blocks.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: Fingerprints in a tile, queries at a time, 64-bit words in a block of lanes, shingles hashed at a time.
BUCKET, QUERIES, LANES, STEP = 1_500, 256, 16, 1 << 16

#: Words of a wide fingerprint, its radius (texts that share 0.8 of their shingles differ in 39 of 256 bits in the mean), width
#: of its keys, ways to cut the bits into keys, fingerprints of a bucket whose pairs are all links, least similarity. In a
#: larger bucket the pairs are links if those near any others are near so many in the mean.
WORDS, WIDE_RADIUS, BAND, WAYS, ALL_PAIRS, SIMILAR, FEW = 4, 62, 14, 3, 64, 0.8, 4
#: Words of lanes whose differences are added at a time.
ADDED = 512
ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def fingerprint(text: bytes, size: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = np.append(0, ends[:-1]), ends - 1
    width = min(size, len(words))
    count, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    n = len(words) - width + 1
    for at in range(0, n, STEP):
        a, b = starts[at : min(at + STEP, n)].tolist(), ends[at + width - 1 : min(at + STEP, n) + width - 1].tolist()
        h = np.array([digest(joined[x:y], SEED) for x, y in zip(a, b, strict=True)], ">u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def wide_fingerprint(text: bytes, size: int) -> bytes:
    """``WORDS`` fingerprints of other hashes of the same shingles (mixed from the first), as one value."""
    words = text.lower().split()
    if not words:
        return bytes(8 * WORDS)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = np.append(0, ends[:-1]), ends - 1
    width = min(size, len(words))
    count, digest = np.zeros(64 * WORDS, np.int64), xxhash.xxh64_intdigest
    n = len(words) - width + 1
    for at in range(0, n, STEP):
        a, b = starts[at : min(at + STEP, n)].tolist(), ends[at + width - 1 : min(at + STEP, n) + width - 1].tolist()
        h = np.array([digest(joined[x:y], SEED) for x, y in zip(a, b, strict=True)], np.uint64)
        for k in range(WORDS):
            g = (h ^ (h >> np.uint64(29))) * ODD[k]
            g = (g ^ (g >> np.uint64(32))) * ODD[-1 - k]
            g ^= g >> np.uint64(31)
            count[64 * k : 64 * k + 64] += np.unpackbits(g.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(count * 2 > n).tobytes()


def fingerprints(df: DataFrame, key: Column, text: Column, size: int) -> DataFrame:
    """key, fp (the 64 bits as a long). No shuffle."""
    kind = df.select(key.alias("key")).schema["key"].dataType.simpleString()

    def make():
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return lambda keys, texts: (keys, [signed(fingerprint(t, size)) for t in texts])

    return map_batches(df, [key.alias("key"), F.coalesce(text, F.lit("")).cast("binary").alias("text")], make, f"key {kind}, fp long")


def bits_of(values: np.ndarray) -> np.ndarray:
    """One row of bits for each value of one or more 64-bit words."""
    return np.unpackbits(values.reshape(len(values), -1).astype(">u8").view(np.uint8).reshape(len(values), -1), axis=1)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row i holds bit i of every value, 64 lanes in a word."""
    own = bits_of(values)
    bits = np.zeros((-(-len(values) // 64) * 64, own.shape[1]), np.uint8)
    bits[: len(values)] = own
    return np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view(np.uint64)


def within(queries: np.ndarray, lanes: np.ndarray, n: int, radius: int = RADIUS) -> np.ndarray:
    """Which of the n values in the planes ``lanes`` are within the radius of each query.

    As many carry-save counter words as the radius has bits count the differences of each lane; one more keeps
    what went beyond them.
    """
    masks = np.where(bits_of(queries).astype(bool), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    out = np.zeros((len(queries), lanes.shape[1]), np.uint64)
    for at in range(0, lanes.shape[1], LANES):
        block = lanes[:, at : at + LANES]
        over = np.zeros((len(queries), block.shape[1]), np.uint64)
        count = [np.zeros_like(over) for _ in range(radius.bit_length())]
        near = ~over
        for plane in range(len(lanes)):
            carry = masks[:, plane, None] ^ block[plane]
            for digit in count:
                digit ^= carry
                carry &= ~digit  # a digit that was one and met a one is zero now
            over |= carry
            if plane % 8 == 7 and plane >= radius:
                near = ~(over | above(count, radius))
                if not near.any():
                    break  # every lane of the block is beyond the radius
        out[:, at : at + LANES] = near
    return np.unpackbits(out.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is above the radius, compared digit by digit from the highest."""
    equal, found = ~np.zeros_like(count[0]), np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            equal = equal & count[k]
        else:
            found |= equal & count[k]
            equal = equal & ~count[k]
    return found


def links(values: np.ndarray, radius: int = RADIUS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(members, first member) of every component with more than one value; the values differ."""
    left, found = values, []
    while len(left) > 1:
        head = left[:QUERIES]
        near = within(head, planes(left), len(left), radius)
        near[np.arange(len(head)), np.arange(len(head))] = False
        linked = np.flatnonzero(near.any(1))
        if not len(linked):
            left = left[len(head) :]
            continue
        alone = np.ones(len(left), bool)
        alone[: len(head)] = near.any(1)
        root = head[linked[0]]
        alone[linked[0]] = False
        left, frontier, members = left[alone], root[None], []
        while len(frontier) and len(left):
            hit = within(frontier[:QUERIES], planes(left), len(left), radius).any(0)
            frontier, new, left = frontier[QUERIES:], left[hit], left[~hit]
            members.append(new)
            frontier = np.concatenate([frontier, new])
        own = np.concatenate(members)
        found.append((own, np.repeat(root[None], len(own), 0)))
    return found


def bucket_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        arrays = [np.asarray(v, np.int64).view(np.uint64) for v in batch["fps"]]
        two = [v for v in arrays if len(v) == 2]
        if two:  # most buckets: one distance each, 64 of them in a word
            a, b = np.array(two).T
            near = within(np.zeros(1, np.uint64), planes(a ^ b), len(a))[0]  # distances to nothing of what differs
            pairs.append((a[near], b[near]))
        for v in arrays:
            if len(v) > 2:
                pairs += links(v)
        a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.uint64) for i in (0, 1))
        yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def near_links(fps: DataFrame) -> DataFrame:
    """a, b: links that connect all of the distinct fingerprints ``fp`` within the radius."""
    part = lambda first, width: F.shiftrightunsigned("fp", 64 - first - width).bitwiseAND(F.lit((1 << width) - 1))
    keys = [
        F.struct(F.lit(k).alias("table"), (F.shiftleft(part(*BLOCKS[i]), 11).bitwiseOR(part(*BLOCKS[j]))).alias("key"))
        for k, (i, j) in enumerate(combinations(range(6), 2))
    ]
    keyed = fps.select("fp", F.inline(F.array(*keys)))
    hot = keyed.groupBy("table", "key").count().where(F.col("count") > BUCKET)
    dealt = keyed.join(hot, ["table", "key"], "left").withColumn("tiles", F.ceil(F.coalesce("count", F.lit(1)) / BUCKET).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int")
    others = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: j != F.col("own")))
    tiled = dealt.withColumn("own", own).select("table", "key", "own", "fp", F.explode(others).alias("other"))
    sides = [F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    buckets = tiled.select("table", "key", *sides, "fp").groupBy("table", "key", "low", "high").agg(F.collect_list("fp").alias("fps"))
    return buckets.where(F.size("fps") > 1).select("fps").mapInPandas(bucket_links, "a long, b long")


def near_duplicates(df: DataFrame, key: Column, text: Column, size: int) -> DataFrame:
    """key, fp, component (the smallest key that links reach)."""
    rows = cut(fingerprints(df, key, text, size), "fingerprints")
    single = rows.groupBy("fp").agg(F.min("key").alias("first"))
    roots = components(near_links(single.select("fp")))
    joined = single.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return rows.join(named_by(joined), "fp").select("key", "fp", "component")


def named_by(joined: DataFrame) -> DataFrame:
    """fp, component: the smallest ``first`` of all rows of the same root.

    A root with a thousandth or more of all rows (a thousand at most) is looked up by a broadcast join, so that a giant
    group is no hot key.
    """
    lowest = cut(joined.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("n")), "groups")
    often = F.col("n") >= max(1, -(-(lowest.agg(F.sum("n")).first()[0] or 0) // 1000))
    giants = F.broadcast(lowest.where(often).select("root", F.col("component").alias("giant")))
    looked = joined.join(giants, "root", "left")
    others = looked.where("giant IS NULL").join(lowest.where(~often).drop("n"), "root")
    return looked.where("giant IS NOT NULL").select("fp", F.col("giant").alias("component")).union(others.select("fp", "component"))


def counted(x: np.ndarray) -> list[np.ndarray]:
    """Binary digits, lowest first, of how many planes (first axis) have each bit: carry-save adders take three planes of one weight to two."""
    digits = []
    while len(x):
        carries = []
        while len(x) > 2:
            k = len(x) // 3
            a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
            s = a ^ b
            carry = s & c
            carry |= a & b
            carries.append(carry)
            s ^= c
            x = np.concatenate([s, x[3 * k :]])
        if len(x) == 2:
            carries.append(x[:1] & x[1:])
            x = x[:1] ^ x[1:]
        digits.append(x[0])
        x = np.concatenate(carries) if carries else x[:0]
    return digits


def masks(values: np.ndarray) -> np.ndarray:
    """Row i has a word for each value: all ones where its bit i is one."""
    return 0 - np.ascontiguousarray(bits_of(values).T).astype(np.uint64)


def near_words(queries: np.ndarray, lanes: np.ndarray, later: bool = False) -> np.ndarray:
    """Which lanes are within ``WIDE_RADIUS`` of each query (``masks``), 64 in a word; lanes beyond the last value are to be ignored.

    later: queries are the lanes themselves, and words of lanes before a query's may be left out.
    """
    out, at = np.zeros((queries.shape[1], lanes.shape[1]), np.uint64), 0
    while at < len(out):
        first = at // 64 if later else 0
        step = max(1, ADDED // (lanes.shape[1] - first))
        out[at : at + step, first:] = ~above(counted(queries[:, at : at + step, None] ^ lanes[:, None, first:]), WIDE_RADIUS)
        at += step
    return out


def unpacked(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def small_pairs(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the radius of buckets of at most 64 values, side by side: a bucket stands in one word of lanes or in two."""
    place = np.arange(len(values))
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    split = np.flatnonzero(start // 64 < place // 64)
    row, word = np.concatenate([place, split]), np.concatenate([place, split - 64]) // 64
    near = ~above(counted(masks(values)[:, row] ^ planes(values)[:, word]), WIDE_RADIUS)
    near[: len(place)] &= (np.uint64(1) << (place % 64).astype(np.uint64)) - np.uint64(1)  # those before it
    some = np.flatnonzero(near)
    i, j = np.nonzero(unpacked(near[some, None], 64))
    i, j = row[some[i]], 64 * word[some[i]] + j
    own = j >= start[i]
    return values[j[own]], values[i[own]]


def tree(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, one of those near it) along a breadth-first tree of each component."""
    left, found = np.ones(len(near), bool), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while left.any():
        frontier = np.flatnonzero(left)[:1]
        left[frontier] = False
        while len(frontier):
            hit = near[frontier] & left
            new = np.flatnonzero(hit.any(0))
            found.append((new, frontier[hit[:, new].argmax(0)]))
            left[new] = False
            frontier = new
    a, b = zip(*found, strict=True)
    return np.concatenate(a), np.concatenate(b)


def large_pairs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """All pairs within the radius, and False; where a value that has any others near has more than ``FEW`` in the mean, only trees of them, and True."""
    place = np.arange(len(values))
    own, lane = place // 64, (place % 64).astype(np.uint64)
    words = near_words(masks(values), planes(values), later=True)
    words[np.arange(words.shape[1])[None] < own[:, None]] = 0
    words[place, own] &= ~np.uint64(1) << lane  # those after it
    if len(values) % 64:
        words[:, -1] &= np.uint64((1 << len(values) % 64) - 1)
    some = np.flatnonzero(words.any(1) | unpacked(np.bitwise_or.reduce(words, axis=0)[None], len(values))[0])
    near = unpacked(words[some], len(values))[:, some]
    many = bool(2 * near.sum() > FEW * len(some))
    i, j = tree(near | near.T) if many else np.nonzero(near)
    return values[some[i]], values[some[j]], many


def words_of(column: pa.Array) -> np.ndarray:
    """A row of 64-bit words for each wide fingerprint of a column."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, WORDS)


def wide_bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, whole.num_rows, ROWS):
            lists = whole.column(0).slice(first, ROWS)
            values, sizes = words_of(lists.flatten()), lists.value_lengths().to_numpy(zero_copy_only=False)
            ends, pairs = np.cumsum(sizes), []
            small, at = sizes <= min(ALL_PAIRS, 64), 0
            pairs = [large_pairs(values[ends[k] - sizes[k] : ends[k]]) for k in np.flatnonzero(~small)]
            values, sizes = values[np.repeat(small, sizes)], sizes[small]
            for some in np.split(sizes, np.flatnonzero(np.diff(np.cumsum(sizes) // ADDED)) + 1):
                if len(some):
                    pairs.append((*small_pairs(values[at : at + some.sum()], some), False))
                    at += some.sum()
            for a, b, many in pairs:
                if len(a):
                    sides = [pa.array([r.tobytes() for r in v.astype(">u8")], pa.binary()) for v in (a, b)]
                    yield pa.RecordBatch.from_arrays([*sides, pa.array(np.full(len(a), many))], ["a", "b", "many"])


def wide_keys(fps: DataFrame) -> DataFrame:
    """fp, table, key: the bits of a fingerprint cut into keys in ``WAYS`` ways: runs of bits, then bits ever further apart."""
    bits, per_way = 64 * WORDS, 64 * WORDS // BAND
    strides = [next(s for s in range(way * BAND + 1, bits) if np.gcd(s, bits) == 1) for way in range(WAYS)]

    def run(batches):
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 8 * WORDS)
            spread = np.unpackbits(values, axis=1)
            weights = 1 << np.arange(BAND, dtype=np.int32)
            for way, stride in enumerate(strides):
                order = np.arange(per_way * BAND) * stride % bits
                keys = spread[:, order].reshape(len(values), per_way, BAND) @ weights
                for k in range(per_way):
                    table = pa.array(np.full(len(values), way * per_way + k, np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0), table, pa.array(keys[:, k].astype(np.int32))], ["fp", "table", "key"])

    return fps.select("fp").mapInArrow(run, "fp binary, table int, key int")


def wide_buckets(keyed: DataFrame, member: str):
    """The rows of a key, grouped; those of a key with more than ``BUCKET`` rows by pairs of tiles."""
    hot = keyed.groupBy("table", "key").count().where(F.col("count") > BUCKET)
    dealt = keyed.join(hot, ["table", "key"], "left").withColumn("tiles", F.ceil(F.coalesce("count", F.lit(1)) / BUCKET).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int")
    others = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: j != F.col("own")))
    tiled = dealt.withColumn("own", own).select("table", "key", "own", member, F.explode(others).alias("other"))
    sides = [F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    return tiled.select("table", "key", *sides, member).groupBy("table", "key", "low", "high")


def wide_links(keyed: DataFrame) -> DataFrame:
    """a, b: distinct wide fingerprints that share a key and are within the radius; many: true if a bucket with too many pairs gives only trees of them."""
    buckets = wide_buckets(keyed, "fp").agg(F.collect_list("fp").alias("fps"))
    found = buckets.where(F.size("fps") > 1).select("fps").mapInArrow(wide_bucket_pairs, "a binary, b binary, many boolean")
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("many").alias("many"))


def apart_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All pairs of a bucket that are within the radius and not of one component."""
    for batch in batches:
        for own, roots in zip(batch["fps"], batch["roots"], strict=True):
            values, root = np.frombuffer(b"".join(own), ">u8").astype(np.uint64).reshape(-1, WORDS), np.asarray(roots, np.int64)
            queries, lanes, names = masks(values), planes(values), list(own)
            for at in range(0, len(values), QUERIES):
                near = unpacked(near_words(queries[:, at : at + QUERIES], lanes), len(values)) & (root[at : at + QUERIES, None] < root[None])
                i, j = np.nonzero(near)
                yield pd.DataFrame({"a": [names[at + k] for k in i], "b": [names[k] for k in j]}, dtype=object)


def apart_links(labels: DataFrame) -> DataFrame:
    """a, b: all fingerprints that share a key and are within the radius and whose roots (labels: fp, root) differ.

    Labels are needed only for the members of trees: all other pairs within the radius are links. Their keys are made
    anew, so that the keys of all others need not be dealt out again.
    """
    rows = wide_keys(labels.select("fp")).join(labels, "fp")
    mixed = rows.groupBy("table", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("table", "key")
    left = rows.join(mixed, ["table", "key"], "left_semi").select("table", "key", "fp", F.struct("fp", "root").alias("one"))
    buckets = wide_buckets(left, "one").agg(F.collect_list("one").alias("ones")).select(F.col("ones.fp").alias("fps"), F.col("ones.root").alias("roots"))
    found = buckets.where(F.array_min("roots") < F.array_max("roots")).mapInPandas(apart_pairs, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    width, digest = min(size, len(words)), xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k : k + width]), SEED) for k in range(len(words) - width + 1)], np.uint64))


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """fp, hashes: each text (fp, text) shingled once."""
    make = lambda: lambda fps, texts: (fps, [shingle_hashes(t, size).tobytes() for t in texts])
    return cut(map_batches(texts, [F.col("fp"), F.col("text")], make, "fp binary, hashes binary"), "shingles")


def alike(links: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) whose texts share ``SIMILAR`` or more of their shingles (sets: fp, hashes)."""

    def make():
        def step(a: list, b: list, left: list, right: list) -> tuple:
            keep = []
            for x, y in zip(left, right, strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= SIMILAR * (len(p) + len(q) - both))
            use = np.flatnonzero(keep)
            return [a[k] for k in use], [b[k] for k in use]

        return step

    sides = [sets.select(F.col("fp").alias(n), F.col("hashes").alias(f"{n}_hashes")) for n in "ab"]
    rows = links.join(sides[0], "a").join(sides[1], "b")
    return map_batches(rows, [F.col(c) for c in ("a", "b", "a_hashes", "b_hashes")], make, "a binary, b binary")


def similar_documents(df: DataFrame, key: Column, text: Column, size: int) -> DataFrame:
    """key, rank (hash of the text), component (key and rank of its first row): groups of texts linked by pairs that share 0.8 of their shingles.

    Fingerprints of ``WORDS`` * 64 bits; texts meet where one of 54 keys of ``BAND`` bits is equal (for a similarity of
    0.8 at least one is with a chance of 0.996) and are looked at within ``WIDE_RADIUS`` bits. The pairs are verified on
    the shingles themselves. Equal fingerprints are one text. In a bucket of more than ``ALL_PAIRS`` where those that
    have any others within the radius have more than ``FEW`` in the mean, each is first verified against one neighbour;
    what this joins is one component, and then all pairs of different components within the radius are verified. Pairs
    inside a component, which change nothing, are all that is left out.
    """
    kind = df.select(key.alias("key")).schema["key"].dataType.simpleString()

    def make():
        return lambda keys, ranks, texts: (keys, ranks, [wide_fingerprint(t, size) for t in texts])

    body = F.coalesce(text, F.lit(""))
    columns = [key.alias("key"), F.xxhash64(key, body).alias("rank"), body.cast("binary").alias("text")]
    rows = cut(map_batches(df, columns, make, f"key {kind}, rank long, fp binary"), "fingerprints")
    single = cut(rows.groupBy("fp").agg(F.min(F.struct("key", "rank")).alias("first")), "distinct")
    keyed = cut(wide_keys(single.select("fp")), "wide-keys")
    found = cut(wide_links(keyed), "wide-links")
    links = found.select("a", "b")
    ends_of = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = cut(single.join(ends_of(links), "fp").select("fp", F.col("first.rank").alias("rank")), "wanted")
    # texts that a Bloom filter of the wanted ones rules out stay where they are
    sifted = df.select(*columns[1:]).where(filter_of(wanted, "rank", most=BITS)(F.col("rank")))
    texts = sifted.dropDuplicates(["rank"]).join(wanted, "rank").select("fp", "text")
    sets = shingle_sets(texts, size)
    named = lambda pairs: pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    linked = cut(named(alike(links, sets)), "alike")
    roots = components(linked)
    trees = cut(ends_of(found.where("many")), "wide-trees")
    if not trees.isEmpty():
        labels = trees.withColumn("node", F.xxhash64("fp")).join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
        rest = cut(apart_links(cut(labels, "wide-labels")).join(links, ["a", "b"], "left_anti"), "apart-links")
        if not rest.isEmpty():
            roots = components(linked.union(named(alike(rest, sets))))
    joined = single.withColumn("node", F.xxhash64("fp")).join(roots, "node", "left").select("fp", "first", F.coalesce("root", "node").alias("root"))
    return rows.join(named_by(joined), "fp").select("key", "rank", "component")
