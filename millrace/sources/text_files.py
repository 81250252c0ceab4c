"""Line oriented inputs: access logs, lists, hosts files, manifests, wildcard lists, topic dumps, ratings.

Each reader is a Spark scan plus a parser on its ``line`` column; the parsers also take any other table
of lines, so they work on streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import urls as U


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, pos, line; ``pos`` orders the lines of a file: block start, then row within the scan."""
    rows = spark.read.text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos"),
        F.col("value").alias("line"),
    )


def ctime(ts: Column) -> Column:
    return F.concat(
        F.date_format(ts, "EEE MMM "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.date_format(ts, " HH:mm:ss yyyy")
    )


def access_line(ip: Column, ts: Column, method: Column, url: Column) -> Column:
    return F.concat(ip, F.lit(" - "), ctime(ts), F.lit(" - "), method, F.lit(" "), url, F.lit(" HTTP/1.1"))


ACCESS = r"^(\S+) - (\S{3}) (\S{3}) +([0-9]+) (\S+) ([0-9]{4}) - (\S+) (\S+) (\S+)$"


def parse_access(lines: DataFrame) -> DataFrame:
    """ip, ts, method, url, version of every access line; other lines are left out."""
    part = lambda n: F.regexp_extract("line", ACCESS, n)
    when = F.concat_ws(" ", part(4), part(3), part(6), part(5))
    return lines.where(F.col("line").rlike(ACCESS)).select(
        part(1).alias("ip"), F.try_to_timestamp(when, F.lit("d MMM yyyy HH:mm:ss")).alias("ts"),
        part(7).alias("method"), part(8).alias("url"), part(9).alias("version"),
    )


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_access(spark.read.text(path).toDF("line"))


def stream_access_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_access(spark.readStream.text(path).toDF("line"))


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """kind, sid, entry from files laid out as kind=.../sid=.../*; blank and # lines are skipped, .gz is unpacked."""
    rows = spark.read.text(path).select("kind", "sid", F.trim("value").alias("entry"))
    return rows.where((F.col("entry") != "") & ~F.startswith("entry", F.lit("#")))


def parse_hosts(lines: DataFrame) -> DataFrame:
    """ip, name: one row per name, lower-cased, comments left out."""
    fields = F.split(F.trim(F.regexp_replace("line", "#.*$", "")), r"\s+")
    rows = lines.select(fields.alias("f")).where(F.size("f") > 1)
    return rows.select(F.get("f", F.lit(0)).alias("ip"), F.explode(F.slice("f", F.lit(2), F.size("f"))).alias("name")).select(
        "ip", F.lower("name").alias("name")
    )


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    return parse_hosts(spark.read.text(path).toDF("line"))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """manifest, md5sum, filename; a manifest with a ``<`` in any line is an error page and dropped whole."""
    rejected = lines.where(F.contains("line", F.lit("<"))).select("manifest").distinct()
    fields = F.split(F.trim("line"), r"\s+")
    rows = lines.join(rejected, "manifest", "left_anti").where(F.trim("line") != "")
    return rows.select("manifest", fields[0].alias("md5sum"), F.get(fields, F.lit(1)).alias("filename"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path).select(F.col("_metadata.file_path").alias("manifest"), F.col("value").alias("line")))


def wildcard_to_regex(pattern: Column) -> Column:
    """``**`` stands for anything, ``*`` for anything but a slash; other special characters are literal."""
    escaped = pattern
    for char in ".?+":
        escaped = F.replace(escaped, F.lit(char), F.lit("\\" + char))
    return F.regexp_replace(F.replace(escaped, F.lit("**"), F.lit(".*")), r"([^.])\*", "$1[^/]*")


def replacement_references(text: Column) -> Column:
    """``$1`` and ``${1}`` become ``\\1``."""
    return F.regexp_replace(text, r"\$\{?([0-9])\}?", r"\\$1")


def import_wildcards(lines: DataFrame) -> DataFrame:
    """file, pos, kind, class, pattern, replacement, disabled of the list after the ``__DATA__`` marker of each file."""
    marker = lines.where(F.startswith("line", F.lit("__DATA__"))).groupBy("file").agg(F.min("pos").alias("_start"))
    rows = lines.join(marker, "file").where((F.col("pos") > F.col("_start")) & ~F.col("line").rlike(r"^\s*(#.*)?$"))
    fields = F.split(F.trim("line"), r"\s+", 2)
    rows = rows.select("file", "pos", fields[0].alias("class"), F.get(fields, F.lit(1)).alias("rest")).where(F.col("class") != "NOZAP")
    printed = F.split("rest", r"\s+", 2)
    is_print = F.col("class") == "PRINT"
    return rows.select(
        "file", "pos", F.when(F.col("class") == "PASS", "allow").otherwise("block").alias("kind"), "class",
        wildcard_to_regex(F.when(is_print, printed[0]).otherwise(F.col("rest"))).alias("pattern"),
        F.when(is_print, replacement_references(F.get(printed, F.lit(1)))).otherwise("").alias("replacement"),
        is_print.alias("disabled"),
    )


def filter_topics(records: DataFrame, wanted: str) -> DataFrame:
    """topic, line: the lines of the topics below one second-level topic.

    A record is the text up to a topic's end tag (read with that tag as line separator), so records of
    one dump are worked on in parallel and no order between lines has to be carried.
    """
    name = F.regexp_extract("record", r'<Topic r:id="([^"\n]*)"', 1)
    second = F.lower(F.get(F.split(name, "/"), F.lit(1)))
    body = F.regexp_extract("record", r'(?s)(<Topic r:id=.*)$', 1)
    rows = records.select(name.alias("topic"), body.alias("body")).where(second == wanted)
    lines = rows.select("topic", F.explode(F.split("body", "\n")).alias("line")).select("topic", F.trim("line").alias("line"))
    return lines.where(F.col("line") != "")


def read_topics(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    return filter_topics(spark.read.option("lineSep", "</Topic>").text(path).toDF("record"), wanted)


def parse_ratings(records: DataFrame) -> DataFrame:
    """url, generic, age, language, sex, violence, modified of ``key value`` stanzas, fields in any order."""
    lines = F.filter(F.split("record", "\n"), lambda s: F.trim(s) != "")
    pair = lambda s: F.struct(
        F.lower(F.regexp_extract(s, r"^\s*([A-Za-z-]+):?\s", 1)).alias("key"), F.trim(F.regexp_extract(s, r"^\s*\S+\s+(.*)$", 1)).alias("value")
    )
    rows = records.select(F.transform(lines, pair).alias("fields")).where(F.size("fields") > 0)

    def field(name: str) -> Column:
        return F.try_element_at(F.filter("fields", lambda f: f["key"] == name), F.lit(-1))["value"]

    def degree(name: str) -> Column:
        value = F.lower(field(name))
        return F.when(value == "0", "none").when(value == "1", "mild").when(value == "2", "heavy").otherwise(value)

    return rows.select(
        field("url").alias("url"), (F.lower(field("generic")) == "true").alias("generic"), field("age").alias("age"),
        degree("language").alias("language"), degree("sex").alias("sex"), degree("violence").alias("violence"),
        field("modified").try_cast("bigint").alias("modified"),
    ).where(F.col("url").isNotNull())


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return parse_ratings(spark.read.option("lineSep", "\n\n").text(path).toDF("record"))


def rating_record(row: dict[str, Column]) -> Column:
    """Stanza of one rating, without the empty line after it."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(k + " "), v.cast("string"))) for k, v in row.items()]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def safe_ratings(ratings: DataFrame) -> DataFrame:
    """The ratings whose URL is in its safe form, the only ones a lookup can meet."""
    return ratings.where(F.col("url") == U.rating_safe(F.col("url")))
