"""Published checksums against local files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """filename, state (new, changed, unchanged, local) and whether the major versions agree.

    Contents are hashed before the join, so only checksums are shuffled.
    """
    local = files.select("filename", F.md5(F.col("content").cast("binary")).alias("_local"), F.col("version").alias("_lv"))
    published = manifest.select("filename", F.col("md5sum").alias("_remote"), F.col("version").alias("_rv"))
    rows = local.join(published, "filename", "full_outer")
    state = (
        F.when(F.col("_remote").isNull(), "local").when(F.col("_local").isNull(), "new")
        .when(F.col("_local") == F.col("_remote"), "unchanged").otherwise("changed")
    )
    return rows.select("filename", state.alias("state"), (F.substring("_lv", 1, 1) == F.substring("_rv", 1, 1)).alias("compatible"))
