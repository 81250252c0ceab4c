"""Tables written to the shared folder, to cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.session import fresh_path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lost executors cost no recomputation of what lies before.

    Where a loop cuts in each round, checkpoint() keeps the partitioning of the plan before, whose description
    grows with every round; a written table starts with a clean plan.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove a table made by ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
