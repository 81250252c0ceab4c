"""Ordered computations over keys of any size: a long time line is cut into parts of equal numbers of rows.

Each part is worked on by itself; only one small row per key and part is ordered along the key, to carry the state
from part to part. Where every key is short (its rows are counted first) a time line is one part and nothing is
carried. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import placed

# Rows of a key that are still one part.
ROWS = 500_000


def in_parts(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, bool]:
    """Rows with their ``_part`` along the time line of their key, and whether any key has more than one.

    A key with more than ``ROWS`` rows cuts the lines by a range exchange on key and order: by the number of rows, however
    unevenly they lie in time.
    """
    longest = df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= ROWS:
        return df.withColumn("_part", F.lit(0)), False
    return placed(df, [*key, *order]).drop("_at"), True


def beside(df: DataFrame, key: str, order: Sequence[str], marks: dict[str, Column], after: bool = False) -> DataFrame:
    """For each name add the last mark that is not null on an earlier row of its key, or with ``after`` the first on a later row."""
    rows, cut = in_parts(df.withColumns({f"_mark_{n}": m for n, m in marks.items()}), [key], order)
    # later rows are earlier ones of the line turned round: a frame that grows is carried on, one that shrinks is read anew for each row
    turn = F.desc if after else F.asc
    edge = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "_part").orderBy(*map(turn, order)).rowsBetween(*edge)
    found = {n: F.last(f"_mark_{n}", ignorenulls=True).over(inside) for n in marks}
    spent = ["_part", *(f"_mark_{n}" for n in marks)]
    if not cut:
        return rows.withColumns(found).drop(*spent)
    rows = rows.withColumns({f"_in_{n}": c for n, c in found.items()})
    far = F.max_by if not after else F.min_by
    # the outermost mark of each part, brought on to the parts behind it
    ends = rows.groupBy(key, "_part").agg(*[
        far(F.col(f"_mark_{n}"), F.when(F.col(f"_mark_{n}").isNotNull(), F.struct(*order))).alias(f"_end_{n}") for n in marks
    ])
    along = Window.partitionBy(key).orderBy(turn("_part")).rowsBetween(*edge)
    carried = ends.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), *[F.last(f"_end_{n}", ignorenulls=True).over(along).alias(f"_carry_{n}") for n in marks])
    joined = rows.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    given = {n: F.coalesce(f"_in_{n}", f"_carry_{n}") for n in marks}
    return joined.withColumns(given).drop(*spent, "_key", "_p", *(f"_{w}_{n}" for n in marks for w in ("in", "carry")))


def last_before(df: DataFrame, key: str, at: str, tie: str, value: Column, out: str) -> DataFrame:
    """Add ``out``: struct(at, tie, value) of the row before this one in the time line of its key."""
    return beside(df, key, [at, tie], {out: F.struct(F.col(at), F.col(tie), value.alias("value"))})


def peak_overlap(spans: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """key, peak: the largest number of spans of a key open at once; a span is closed at its end."""
    steps = F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d"))
    )
    rows = spans.select(*key, F.inline(steps))
    # steps at the same time fall together before anything is ordered
    rows = rows.groupBy(*key, "at").agg(F.sum("d").alias("d"))
    rows, cut = in_parts(rows, key, ["at"])
    inside = Window.partitionBy(*key, "_part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_running", F.sum("d").over(inside))
    parts = rows.groupBy(*key, "_part").agg(F.max("_running").alias("_top"), F.sum("d").alias("_net"))
    if not cut:
        return parts.select(*key, F.col("_top").alias("peak"))
    along = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum("_net").over(along), F.lit(0))
    return parts.withColumn("_peak", level + F.col("_top")).groupBy(*key).agg(F.max("_peak").alias("peak"))
