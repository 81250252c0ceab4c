"""Session set-up and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs assume; extra settings by keyword, dots as '__'."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # call sites of column functions are only looked up for error messages, at a round trip each
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the cluster in spark.checkpoint.dir; with a local master one of its own when unset.

    On a cluster a machine-local folder would hold a part of the rows on every executor, so there it must be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "millrace-" + spark.sparkContext.applicationId)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoint() at the shared folder unless the session has one already."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: later steps start from there, whatever is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Input with fewer splits than cores, cut up for all cores; larger input is returned as it is.

    Expensive expressions on a small file would else run in one task. Input of any size has more splits
    than cores and gets no exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stage_text(df: DataFrame, name: str, column: str = "line", **options: str) -> str:
    """Write one string column as text files below the shared folder and return the path."""
    path = fresh_path(df.sparkSession, name)
    df.select(column).write.options(**options).text(path)
    return path
