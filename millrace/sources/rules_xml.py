"""Rule folders as XML files, one folder per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ranking import with_row_number

# Rules per file: a larger folder is written as several files, so no folder ends up in one task.
FOLDER_ROWS = 10_000

# The rule elements a folder may hold.
KINDS = [
    "allow", "allowdomains", "allowurls", "antivirus", "block", "blockdomains", "blockurls", "header", "htmlrewrite",
    "image", "imagereduce", "javascript", "mime", "nocomments", "nojscomments", "rating", "replace", "xmlrewrite",
]


def parse_folders(files: DataFrame) -> DataFrame:
    """One row per rule from rows of (file, xml): folder attributes, order, kind, typed attributes, nested texts.

    Rules of all kinds are found in one pass, so their position is the order across kinds. The parts of a
    large folder name their offset, so they count on from each other.
    """
    kinds = "|".join(KINDS)
    element = rf"(?s)<({kinds})\b(?:[^>\"/]+|/(?!>)|\"[^\"]*\")*?(?:/>|>.*?</\1\s*>)"
    head = F.regexp_extract("xml", r"(?s)<folder\b[^>]*>", 0)

    def folder(name: str) -> Column:
        return F.nullif(F.regexp_extract(head, rf'\b{name}="([^"]*)"', 1), F.lit(""))

    rows = files.where(F.length(F.trim("xml")) > 0).select(
        "file", folder("sid").alias("folder_sid"), folder("oid").try_cast("int").alias("folder_oid"),
        F.coalesce(folder("disable") == "1", F.lit(False)).alias("folder_disable"),
        F.coalesce(folder("offset").try_cast("bigint"), F.lit(0)).alias("offset"),
        F.posexplode(F.regexp_extract_all("xml", F.lit(element), F.lit(0))).alias("pos", "rule"),
    )

    def attr(name: str) -> Column:
        return F.nullif(F.xpath_string("rule", F.lit(f"/*/@{name}")), F.lit(""))

    def texts(path: str) -> Column:
        return F.xpath("rule", F.lit(path))

    elements = F.regexp_extract_all("rule", F.lit(r"(?s)<attr\b[^>]*?/>|<attr\b[^>]*>.*?</attr\s*>"), F.lit(0))

    def named_attr(e: Column) -> Column:
        name = F.nullif(F.regexp_extract(e, r'^<attr\b[^>]*?\bname="([^"]*)"', 1), F.lit(""))
        return F.struct(F.coalesce(name, F.lit("href")).alias("name"), unescape(F.regexp_extract(e, r"(?s)>(.*)</attr\s*>$", 1)).alias("pattern"))

    def named(tag: str):
        return lambda e: F.struct(
            unescape(F.regexp_extract(e, rf'^<{tag}\b[^>]*?\bname="([^"]*)"', 1)).alias("name"), unescape(F.regexp_extract(e, rf"(?s)>(.*)</{tag}\s*>$", 1)).alias("value"))

    limits = F.regexp_extract_all("rule", F.lit(r"(?s)<limit\b[^>]*?/>|<limit\b[^>]*>.*?</limit\s*>"), F.lit(0))
    titles = F.map_from_arrays(F.array_distinct(texts("/*/title/@lang")), F.slice(texts("/*/title/text()"), F.lit(1), F.size(F.array_distinct(texts("/*/title/@lang")))))
    has_titles = F.size(texts("/*/title/@lang")) == F.size(texts("/*/title/text()"))
    return rows.select(
        "file", "folder_sid", "folder_oid", "folder_disable", (F.col("offset") + F.col("pos")).alias("oid"),
        F.regexp_extract("rule", r"^<([a-z]+)", 1).alias("kind"), attr("sid").alias("sid"),
        F.coalesce(attr("disable") == "1", F.lit(False)).alias("disable"),
        attr("url").alias("url"), attr("tag").alias("tag"), attr("selector").alias("selector"), attr("search").alias("search"),
        attr("filename").alias("filename"), attr("name").alias("name"),
        F.when(has_titles, titles).alias("titles"), texts("/*/matchurl/text()").alias("matchurls"),
        texts("/*/nomatchurl/text()").alias("nomatchurls"), texts("/*/mime/text()").alias("mimes"),
        F.transform(elements, named_attr).alias("attrs"), F.nullif(F.xpath_string("rule", F.lit("/*/matchcontent")), F.lit("")).alias("content"),
        attr("action").alias("action"), attr("filterstage").alias("filterstage"), attr("width").try_cast("int").alias("width"),
        attr("height").try_cast("int").alias("height"), attr("formats").alias("formats"), F.nullif(F.xpath_string("rule", F.lit("/*/replacement/@part")), F.lit("")).alias("part"),
        F.xpath_string("rule", F.lit("/*/replacement")).alias("replacement"), attr("quality").try_cast("int").alias("quality"),
        attr("minimal_size_bytes").try_cast("int").alias("minimal_size_bytes"), attr("replacetype").alias("replacetype"), attr("value").alias("value"),
        F.coalesce(attr("use_extern") == "1", F.lit(False)).alias("use_extern"), F.transform(limits, named("limit")).alias("limits"),
        F.nullif(F.xpath_string("rule", F.lit("/*/url")), F.lit("")).alias("service"),
    )


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """Rules of all folder files below a path; the files are in ISO-8859-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parse_folders(files.select(F.col("path").alias("file"), F.decode("content", "ISO-8859-1").alias("xml")))


def number_folders(rules: DataFrame) -> DataFrame:
    """folder_sid, folder_oid: folders in order of their number, then of their id, counted from zero."""
    folders = rules.groupBy("folder_sid").agg(F.min("folder_oid").alias("was"))
    folders = folders.withColumn("was", F.coalesce("was", F.lit(2147483647)))
    numbered = with_row_number(folders, ["was", "folder_sid"])
    return numbered.select("folder_sid", (F.col("rn") - 1).alias("folder_oid"))


def unescape(text: Column) -> Column:
    out = text
    for char, name in (("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos"), ("\n", "#10"), ("&", "amp")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def escape(text: Column) -> Column:
    out = text
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        out = F.replace(out, F.lit(char), F.lit(f"&{name};"))
    return out


def _nested(name: str):
    return lambda x: F.concat(F.lit(f"<{name}>"), escape(x), F.lit(f"</{name}>"))


def rule_element(kind: Column, attrs: dict[str, Column], titles: dict[str, Column], lists: dict[str, Column] | None = None) -> Column:
    """XML of one rule; null attributes, titles and lists of nested texts are left out."""
    shown = [F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), escape(v.cast("string")), F.lit('"'))) for k, v in attrs.items()]
    inner = [F.when(v.isNotNull(), F.concat(F.lit(f'<title lang="{k}">'), escape(v), F.lit("</title>"))) for k, v in titles.items()]
    for name, texts in (lists or {}).items():
        inner.append(F.array_join(F.transform(texts, _nested(name)), ""))
    return F.concat(
        F.lit("<"), kind, F.array_join(F.array_compact(F.array(*shown)), ""), F.lit(">"),
        F.array_join(F.array_compact(F.array(*inner)), ""), F.lit("</"), kind, F.lit(">"),
    )


def write_folders(rules: DataFrame, path: str, rows: int = FOLDER_ROWS) -> None:
    """Write folder files: head, rules in order, end; rules stream through a sort, none is gathered.

    Beside the columns of a rule table those of ``matchurls``, ``nomatchurls`` and ``mimes`` (arrays) or ``mime`` are written
    where they are there.

    A folder of more than ``rows`` rules becomes several files, each with its offset in the head; with a
    sufficient ``rows`` every folder is one file.
    """
    ranked = with_row_number(rules, ["oid"], ["folder_sid"]).withColumn("part", F.floor((F.col("rn") - 1) / rows))
    folder = ["folder_sid", "part", "folder_oid", "folder_disable"]
    lists = {n: F.col(c) for n, c in (("matchurl", "matchurls"), ("nomatchurl", "nomatchurls"), ("mime", "mimes")) if c in rules.columns}
    if "mime" in rules.columns and "mime" not in lists:
        lists["mime"] = F.when(F.col("mime").isNotNull(), F.array("mime"))
    body = ranked.select(
        "folder_sid", "part", F.lit(1).alias("place"), F.col("rn").cast("bigint").alias("rn"),
        rule_element(
            F.col("kind"), {"sid": F.col("sid"), "disable": F.when(F.col("disable"), "1"), "url": F.col("url")},
            {"en": F.col("title_en"), "de": F.col("title_de")}, lists,
        ).alias("line"),
    )
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="iso-8859-1"?><folder sid="'), escape(F.col("folder_sid")), F.lit('" oid="'),
        F.col("folder_oid").cast("string"), F.when(F.col("part") > 0, F.concat(F.lit('" offset="'), (F.col("part") * rows).cast("string"))).otherwise(""),
        F.when(F.col("folder_disable"), '" disable="1">').otherwise('">'),
    )
    ends = ranked.select(*folder).distinct().select("folder_sid", "part", F.inline(F.array(
        F.struct(F.lit(0).alias("place"), F.lit(0).cast("bigint").alias("rn"), head.alias("line")),
        F.struct(F.lit(2).alias("place"), F.lit(0).cast("bigint").alias("rn"), F.lit("</folder>").alias("line")),
    )))
    rows = body.unionByName(ends).repartition("folder_sid", "part").sortWithinPartitions("folder_sid", "part", "place", "rn")
    rows.select("folder_sid", "part", "line").write.partitionBy("folder_sid", "part").option("encoding", "iso-8859-1").text(path)
