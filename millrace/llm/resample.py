"""Importance resampling towards a target distribution, with lines counted once (operator 13).

Features are the runs of 1 to ``RUN`` consecutive words of a text, hashed into buckets. Newlines separate words, so
they cut a text into lines, and a line's own features do not depend on where it stands. Equal lines are brought
together first; each distinct line is tokenised and hashed once, and its bucket counts are multiplied by its
occurrences. Runs that reach over a line's end are added separately: they need the first and last ``RUN`` - 1 words of
each line only. A bucket's gain is 1000 times the logarithm of its share in the target over its share here (one is
added to each bucket), rounded down; a text's weight is the sum of the gains of its features: the weights of its
lines, looked up, plus those of its crossing runs. Gumbel noise from a hash of seed and id turns the weights into
scores whose highest are a sample without replacement.

Scale: lines move once, as counts by text, and are combined before they move. Back to the documents go two hashes and a
weight. Lines that make up a thousandth or more of all (a thousand at most, so their table is bounded) are looked up
by a broadcast join, so that no line is a hot key; the others by a shuffled join of hashes. The gains are one bounded
array. Ranks come from one range exchange of thin rows.

Defined results: null texts have no words, no features, weight 0. Each input row gives one row; rows that repeat an id
and a text are equal and each takes part in the draw. A null id is scored with the hash of seed and an empty text, and
comes first among ties. A document is known by its id and a hash of its text, a line by two hashes. Empty tables give
no rows; an empty target gives gains against counts of nought. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import ROWS, map_batches
from millrace.llm.shared import cut
from millrace.operators.ranking import with_row_number

#: Words of the longest run, buckets, least words of a text that is drawn, percent drawn, seed of the noise.
RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A line with this share of all lines or more is looked up by a broadcast join; there are at most 1 / HOT of them.
HOT = 1 / 1000


def buckets_of(words: list[bytes], owner: np.ndarray, line: np.ndarray | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and owners of the runs of words that have one owner; with ``line``, of those that touch two lines or more.

    The checksum of a run goes on from that of the run without its last word. A word None belongs to no run.
    """
    found, owners = [], []
    if line is None:
        sums = list(map(crc32, words))
        found.append(np.array(sums, np.int64)), owners.append(owner)
        spaced = [b" " + w for w in words]
        for run in range(2, RUN + 1):
            sums = list(map(crc32, spaced[run - 1 :], sums))
            same = owner[run - 1 :] == owner[: len(owner) - run + 1] if len(owner) >= run else np.zeros(0, bool)
            found.append(np.array(sums, np.int64)[same]), owners.append(owner[run - 1 :][same])
    else:
        for run in range(2, RUN + 1):
            if len(words) < run:
                break
            use = np.flatnonzero((owner[run - 1 :] == owner[: len(owner) - run + 1]) & (line[run - 1 :] != line[: len(line) - run + 1]))
            made = [(None if None in (part := words[i : i + run]) else crc32(b" ".join(part)), owner[i]) for i in use.tolist()]
            found.append(np.array([m for m, _ in made if m is not None], np.int64)), owners.append(np.array([o for m, o in made if m is not None], np.int64))
    return np.concatenate(found or [np.zeros(0, np.int64)]) % buckets, np.concatenate(owners or [np.zeros(0, np.int64)])


def packed(found: np.ndarray, owners: np.ndarray, rows: int, buckets: int) -> list[bytes]:
    """For each owner from 0 to rows - 1 the sorted bucket numbers of its runs, in two or four bytes each."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    order = np.lexsort((found, owners))
    ends = np.searchsorted(owners[order], np.arange(rows + 1))
    raw, size = found[order].astype(kind).tobytes(), kind.itemsize
    return [raw[a * size : b * size] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def unpacked(raw: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all rows, and where each row begins and the last ends."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    starts = np.concatenate([[0], np.cumsum([len(r) // kind.itemsize for r in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), kind), starts


def edge_words(line: bytes) -> list[bytes | None]:
    """The words of a line that runs over its ends can hold: all of a short one, else its first and last with None between."""
    few = [m.group() for m in islice(WORD.finditer(line), 2 * RUN - 1)]
    if len(few) < 2 * RUN - 1:
        return few
    last = [m.group()[::-1] for m in islice(WORD.finditer(line[::-1]), RUN - 1)]
    return [*few[: RUN - 1], None, *last[::-1]]


def line_step(buckets: int):
    """Function of lines and their occurrences: these, two hashes are left to Spark, and the packed buckets."""

    def make():
        def step(lines: list[str], times: list[int], a: list[int], b: list[int]):
            words, sizes = [], []
            for text in lines:
                own = WORD.findall(text.encode())
                words += own
                sizes.append(len(own))
            owner = np.repeat(np.arange(len(lines)), sizes)
            return a, b, times, packed(*buckets_of(words, owner, None, buckets), len(lines), buckets)

        return step

    return make


def crossing_step(buckets: int):
    """Function of ids and texts: id, hashes and the packed buckets of the runs over line ends."""

    def make():
        def step(key: list, mark: list, texts: list[str | None]):
            words, owner, line = [], [], []
            at = 0
            for i, text in enumerate(texts):
                for own in map(edge_words, (text or "").encode().split(b"\n")):
                    at += 1
                    words += own
                    owner += [i] * len(own)
                    line += [at] * len(own)
            got = buckets_of(words, np.array(owner, np.int64), np.array(line, np.int64), buckets)
            return key, mark, packed(*got, len(texts), buckets)

        return step

    return make


def histogram(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: how often each bucket stands in the packed rows (times, packed); one row of a task for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                found, starts = unpacked(batch.column(1).to_pylist(), buckets)
                times = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(starts))
                # weights are added as whole numbers, which doubles would round beyond 2^53
                np.add.at(total, found, times)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def marks(text: Column) -> list[Column]:
    """Two hashes of a text that do not follow from one another."""
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(13), text).alias("b")]


def line_of(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.explode(F.filter(F.split(lowered(text), "\n"), lambda x: x.rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"))).alias("line")


def distinct_lines(docs: DataFrame, text: Column, buckets: int, name: str) -> DataFrame:
    """a, b, times, packed: each distinct line once, written to the shared folder."""
    lines = docs.select(line_of(text)).groupBy("line").agg(F.count("*").alias("times"))
    got = map_batches(lines, [F.col("line"), F.col("times"), *marks(F.col("line"))], line_step(buckets), "a long, b long, times long, packed binary")
    return cut(got, name)


def crossing_runs(docs: DataFrame, key: Column, text: Column, buckets: int, name: str) -> DataFrame:
    """key, mark, packed of each row: its runs over line ends, written to the shared folder."""
    mark = F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark")
    columns = [key.cast("long").alias("key"), mark, lowered(text).alias("text")]
    return cut(map_batches(docs, columns, crossing_step(buckets), "key long, mark long, packed binary"), name)


def counted(lines: DataFrame, crossing: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows."""
    both = lines.select("times", "packed").union(crossing.select(F.lit(1).cast("long"), "packed"))
    total = np.zeros(buckets, np.int64)
    for r in histogram(both, buckets).collect():  # one row for each bucket, their number is a parameter
        total[r.bucket] = r.n
    return total


def gains_of(here: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed shares of the target over those here."""
    n, s, t = len(here), float(here.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(here.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(rows: DataFrame, columns: list[str], gains: np.ndarray) -> DataFrame:
    """The columns, features and weight of the packed rows."""
    # the array has one entry for each bucket and goes to each task with the function
    kept = rows.select(*columns, "packed")
    schema = ", ".join(f"{c} {t}" for c, t in kept.dtypes if c != "packed")

    def make():
        def step(*values):
            found, starts = unpacked(values[-1], len(gains))
            upto = np.concatenate([[0], np.cumsum(gains[found])])
            return *values[:-1], pa.array(np.diff(starts)), pa.array(np.diff(upto[starts]))

        return step

    return map_batches(kept, [F.col(c) for c in kept.columns], make, schema + ", features long, weight long")


def weights(docs: DataFrame, target: DataFrame, key: Column, text: Column, target_text: Column, buckets: int = BUCKETS) -> DataFrame:
    """key, n_features, weight of every row of ``docs``, and the number of the row among equal ones."""
    lines = distinct_lines(docs, text, buckets, "lines")
    crossing = crossing_runs(docs, key, text, buckets, "crossing")
    here = counted(lines, crossing, buckets)
    there = counted(distinct_lines(target, target_text, buckets, "target-lines"), crossing_runs(target, F.lit(None), target_text, buckets, "target-crossing"), buckets)
    gains = gains_of(here, there)

    priced = cut(weighed(lines, ["a", "b", "times"], gains), "priced")
    least = max(1, math.ceil((lines.agg(F.sum("times")).first()[0] or 0) * HOT))
    often = F.col("times") >= least
    ids = [key.cast("long").alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark")]
    placed = docs.select(*ids, line_of(text)).select("key", "mark", *marks(F.col("line")))
    # at most 1 / HOT lines have that many of all occurrences
    common = F.broadcast(priced.where(often).select("a", "b", F.col("features").alias("hot_features"), F.col("weight").alias("hot_weight")))
    looked = placed.join(common, ["a", "b"], "left")
    found = looked.where("hot_weight IS NOT NULL").select("key", "mark", F.col("hot_features").alias("features"), F.col("hot_weight").alias("weight"))
    others = looked.where("hot_weight IS NULL").select("key", "mark", "a", "b").join(priced.where(~often).drop("times"), ["a", "b"])
    # rows that repeat an id and a text bring each line once for every row; crossing runs carry the number of rows
    inside = found.union(others.select("key", "mark", "features", "weight")).withColumn("rows", F.lit(0))
    over = weighed(crossing, ["key", "mark"], gains).withColumn("rows", F.lit(1))
    summed = inside.union(over.select("key", "mark", "features", "weight", "rows")).groupBy("key", "mark").agg(
        F.sum("features").alias("f"), F.sum("weight").alias("w"), F.sum("rows").alias("rows"))
    # all rows of one id and text are alike, so their sums divide evenly; they are counted out by the thousand
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(rows - 1) div 1000")))
    last = F.least(F.col("rows"), F.col("block") * 1000 + 1000)
    copies = summed.select("*", block.alias("block")).select("*", F.explode(F.sequence(F.col("block") * 1000 + 1, last)).alias("copy"))
    return copies.select("key", F.expr("f div rows").alias("n_features"), F.expr("w div rows").alias("weight"), "copy")


def features_of(words: int) -> int:
    """Runs of a text of so many words."""
    return sum(max(0, words - run + 1) for run in range(1, RUN + 1))


def resample(docs: DataFrame, target: DataFrame, key: Column, text: Column, target_text: Column, percent: int = PERCENT) -> DataFrame:
    """key, n_features, weight, score, rank of every row; rank is null for rows that are not drawn."""
    got = weights(docs, target, key, text, target_text)
    digest = F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digest, 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = cut(got.withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_features") >= features_of(LEAST_WORDS)
    drawn = scored.where(able).count() * percent // 100
    ranked = with_row_number(scored.where(able).withColumn("down", -F.col("score")), ["down", "key", "n_features", "weight", "copy"], out="rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank").cast("long")).alias("rank")
    shown = ["key", "n_features", "weight", "score"]
    return ranked.select(*shown, rank).union(scored.where(~able).select(*shown, F.lit(None).cast("long")))
