"""Row numbers over groups of any size, without pulling a group into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written


def placed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows in the order of ``by``, dealt by a range exchange: ``_part`` is the number of the partition, ``_at`` the place inside.

    Partitions have about equal sizes and follow one another, as many as the session shuffles into. They are written to
    the shared folder, because the bounds of a range exchange come from a sample that another run would draw anew.
    """
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return written(numbered, "ranged")


def with_row_number(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), out: str = "rn", total: str | None = None) -> DataFrame:
    """Add ``out``, the 1-based position in ``order`` inside each group, and ``total``, the group size.

    ``order`` must be a total order. One range exchange on group and order deals the rows into sorted partitions, so a
    hot group is spread over several. Counts by partition and group give what stands before each of them: the number is
    that sum and the place inside. Only counts are brought together.
    """
    rows = placed(df, [*group, *order])
    parts = [*group, "_part"]
    sizes = rows.groupBy(*parts).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        sizes = sizes.withColumn(total, F.sum("_n").over(Window.partitionBy(*group)))
    named = {c: f"_of_{c}" for c in parts}
    joined = rows.join(sizes.withColumnsRenamed(named), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()]))
    return joined.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(out), *([total] if total else []))
