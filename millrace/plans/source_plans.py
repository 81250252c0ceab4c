"""Queries that go through files: the input is written below the shared folder and read back by the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.operators.cleaning import clean
from millrace.plans.html_plans import CLEAN_SQL
from millrace.plans.loaded import rule_set
from millrace.plans.registry import query
from millrace.session import fresh_path, stage_text
from millrace.sources import rules_xml as X
from millrace.sources import text_files as S

CTIME = "strftime(ts, '%a %b ') || lpad(day(ts)::VARCHAR, 2, ' ') || strftime(ts, ' %H:%M:%S %Y')"


@query("scan_access_log", sql="SELECT client_ip AS ip, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, method, url, 'HTTP/1.1' AS version FROM requests")
def scan_access_log(t):
    lines = t.requests.select(S.access_line(F.col("client_ip"), F.col("ts"), F.col("method"), F.col("url")).alias("line"))
    path = stage_text(lines, "access")
    return S.read_access_log(t.spark, path).select("ip", F.unix_seconds("ts").alias("seconds"), "method", "url", "version")


@query("scan_hosts_file", sql=r"""SELECT '10.1.' || (page_id // 250 % 250)::VARCHAR || '.' || (page_id % 250)::VARCHAR AS ip, unnest([regexp_extract(url, '//([^/]*)', 1), 'alias' || page_id::VARCHAR]) AS name
  FROM pages WHERE page_id % 5 <> 0""")
def scan_hosts_file(t):
    ip = F.expr("'10.1.' || cast(page_id div 250 % 250 as string) || '.' || cast(page_id % 250 as string)")
    line = F.concat(ip, F.lit("\t"), F.upper(U.host(F.col("url"))), F.lit("  Alias"), F.col("page_id").cast("string"), F.lit(" # of page"))
    off = F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("# "), line)).otherwise("")
    return S.read_hosts(t.spark, stage_text(t.pages.select(F.when(F.col("page_id") % 5 == 0, off).otherwise(line).alias("line")), "hosts"))


@query("scan_manifest", sql="SELECT (doc_id % 4)::VARCHAR AS manifest, md5(text) AS md5sum, 'f' || doc_id::VARCHAR || '.zap' AS filename FROM documents WHERE doc_id % 4 <> 3")
def scan_manifest(t):
    """Four manifests; the last one is an error page and dropped as a whole."""
    line = F.concat(F.md5(F.col("text").cast("binary")), F.lit("  f"), F.col("doc_id").cast("string"), F.lit(".zap"))
    line = F.when((F.col("doc_id") % 4 == 3) & (F.col("doc_id") % 40 == 3), "<html>not found").otherwise(line)
    path = fresh_path(t.spark, "manifest")
    rows = t.documents.select((F.col("doc_id") % 4).cast("string").alias("manifest"), line.alias("line"))
    rows.write.partitionBy("manifest").text(path)
    lines = t.spark.read.text(path).select(F.col("manifest").cast("string").alias("manifest"), F.col("value").alias("line"))
    return S.parse_manifest(lines)


def _wild_lines(t):
    """Lines of wildcard lists, one list per eighth page: comments and a marker, then an entry per page."""
    host, page = U.host(F.col("url")), F.col("page_id")
    entry = (
        F.when(page % 5 == 0, F.concat(F.lit("NOZAP http://"), host, F.lit("/**")))
        .when(page % 5 == 1, F.concat(F.lit("PASS http://"), host, F.lit("/*.gif")))
        .when(page % 5 == 2, F.concat(F.lit("PRINT http://"), host, F.lit("/(a*)/**  http://"), host, F.lit("/print/${1}?$2")))
        .when(page % 5 == 3, F.concat(F.lit("AD  http://"), host, F.lit("/ads+/*?x=**")))
        .otherwise("  # comment")
    )
    file = (page % 8).cast("string")
    rows = t.pages.select(file.alias("file"), page.alias("pos"), entry.alias("line"))
    # the entries of the first pages of each list stand before its marker
    marker = F.when(F.col("pos") == F.col("file").cast("bigint") + 8, "__DATA__ below").otherwise(F.col("line"))
    return rows.withColumn("line", marker)


def _regex_sql(x: str) -> str:
    out = x
    for c in ".?+":
        out = f"replace({out}, '{c}', chr(92) || '{c}')"
    return rf"regexp_replace(replace({out}, '**', '.*'), '([^.])\*', '\1[^/]*', 'g')"


@query("import_wildcard_list", sql=rf"""WITH p AS (SELECT page_id AS pos, regexp_extract(url, '//([^/]*)', 1) AS host FROM pages WHERE page_id >= 16 AND page_id % 5 IN (1, 2, 3)),
  e AS (SELECT *, CASE pos % 5 WHEN 1 THEN 'http://' || host || '/*.gif' WHEN 2 THEN 'http://' || host || '/(a*)/**' ELSE 'http://' || host || '/ads+/*?x=**' END AS wild FROM p)
  SELECT (pos % 8)::VARCHAR AS file, pos, CASE pos % 5 WHEN 1 THEN 'allow' ELSE 'block' END AS kind, CASE pos % 5 WHEN 1 THEN 'PASS' WHEN 2 THEN 'PRINT' ELSE 'AD' END AS class,
    {_regex_sql('wild')} AS pattern, CASE pos % 5 WHEN 2 THEN 'http://' || host || '/print/' || chr(92) || '1?' || chr(92) || '2' ELSE '' END AS replacement, pos % 5 = 2 AS disabled FROM e""")
def import_wildcard_list(t):
    return S.import_wildcards(_wild_lines(t))


@query("wildcard_to_regex", sql=f"SELECT page_id, {_regex_sql(chr(39) + 'http://*.' + chr(39) + ' || replace(url, ' + chr(39) + '/en/' + chr(39) + ', ' + chr(39) + '/**/a+b*' + chr(39) + ')')} AS pattern FROM pages")
def wildcard_to_regex(t):
    wild = F.concat(F.lit("http://*."), F.replace("url", F.lit("/en/"), F.lit("/**/a+b*")))
    return t.pages.select("page_id", S.wildcard_to_regex(wild).alias("pattern"))


@query("filter_topic_dump", sql="""WITH l AS (SELECT doc_id, unnest(['<Topic r:id="Top/Kids_and_Teens/' || doc_id::VARCHAR || '">', '<catid>' || n_chars::VARCHAR || '</catid>', '<lang>' || lang || '</lang>']) AS line FROM documents WHERE doc_id % 3 = 1)
  SELECT 'Top/Kids_and_Teens/' || doc_id::VARCHAR AS topic, line FROM l""")
def filter_topic_dump(t):
    top = F.when(F.col("doc_id") % 3 == 1, "Top/Kids_and_Teens/").when(F.col("doc_id") % 3 == 2, "Top/Arts/").otherwise("Top")
    text = F.concat(
        F.lit('<Topic r:id="'), top, F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("doc_id").cast("string")), F.lit('">\n  <catid>'),
        F.col("n_chars").cast("string"), F.lit("</catid>\n  <lang>"), F.col("lang"), F.lit("</lang>\n</Topic>\n<ExternalPage about=\"x\"/>"),
    )
    return S.read_topics(t.spark, stage_text(t.documents.select(text.alias("line")), "topics"), "kids_and_teens")


@query("scan_list_files", sql="SELECT kind, sid, entry FROM lists")
def scan_list_files(t):
    """Lists written as compressed files per kind and rule, with comments and blank lines, and read back."""
    noise = F.explode(F.array(F.concat(F.lit("  "), "entry", F.lit(" ")), F.lit("# a comment"), F.lit("")))
    path = fresh_path(t.spark, "lists")
    t.lists.select("kind", "sid", noise.alias("line")).write.partitionBy("kind", "sid").option("compression", "gzip").text(path)
    return S.read_lists(t.spark, path)


RATING_FIELDS = ["url", "language", "generic", "violence", "modified", "sex", "age"]


@query("scan_rating_records", sql="SELECT url, generic, nullif(age, '') AS age, language, sex, violence, CAST(modified AS BIGINT) AS modified FROM ratings")
def scan_rating_records(t):
    record = S.rating_record({f: F.nullif(F.col(f).cast("string"), F.lit("")) for f in RATING_FIELDS})
    return S.read_ratings(t.spark, stage_text(t.ratings.select(record.alias("line")), "ratings", lineSep="\n\n"))


@query("write_ratings", sql="""SELECT url, generic, CAST(modified AS BIGINT) AS modified FROM (SELECT url || CASE WHEN length(url) % 4 = 0 THEN '?q' ELSE '' END AS url, generic, modified FROM ratings)
  WHERE url NOT LIKE '%?q' AND regexp_matches(url, '^[a-z]+://[^/]+/.+$')""")
def write_ratings(t):
    """Ratings in safe form are stored as parquet, parted by kind; unsafe keys are dropped."""
    spoiled = t.ratings.withColumn("url", F.concat("url", F.when(F.length("url") % 4 == 0, "?q").otherwise("")))
    path = fresh_path(t.spark, "rating-store")
    S.safe_ratings(spoiled).write.mode("overwrite").partitionBy("generic").parquet(path)
    return t.spark.read.parquet(path).select("url", F.col("generic").cast("boolean").alias("generic"), F.col("modified").cast("bigint").alias("modified"))


def _read_back(t, name):
    path = fresh_path(t.spark, name)
    X.write_folders(t.rules, path)
    return X.read_folders(t.spark, path)


RULES_BACK = """WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY folder_sid ORDER BY oid) - 1 AS INTEGER) AS pos FROM rules)
  SELECT folder_sid, folder_oid, folder_disable, pos AS oid, kind, sid, disable, {} FROM r"""


@query("scan_rules_xml", sql=RULES_BACK.format("title_en, title_de"))
def scan_rules_xml(t):
    rows = _read_back(t, "folders")
    return rows.select(
        "folder_sid", "folder_oid", "folder_disable", "oid", "kind", "sid", "disable",
        F.try_element_at("titles", F.lit("en")).alias("title_en"), F.try_element_at("titles", F.lit("de")).alias("title_de"),
    )


@query("write_rules", sql=RULES_BACK.format("url, mime"))
def write_rules(t):
    return _read_back(t, "rules").select("folder_sid", "folder_oid", "folder_disable", "oid", "kind", "sid", "disable", "url", F.get("mimes", F.lit(0)).alias("mime"))


@query("write_clean_pages", sql=CLEAN_SQL + " SELECT page_id, CAST(len(html) AS INTEGER) AS n_chars, md5(html) AS md5sum FROM cleaned")
def write_clean_pages(t):
    path = fresh_path(t.spark, "clean")
    clean(t.pages.select("page_id", "url", "html"), rule_set(t).tag_rules, rule_set(t).text_rules).write.option("compression", "zstd").parquet(path)
    return t.spark.read.parquet(path).select("page_id", F.length("html").alias("n_chars"), F.md5(F.col("html").cast("binary")).alias("md5sum"))


@query("scan_binary", sql="SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def scan_binary(t):
    """Raw files of each language with their sizes; the contents are not read for it."""
    path = fresh_path(t.spark, "binary")
    t.documents.select("lang", "text").write.partitionBy("lang").option("maxRecordsPerFile", 1000).text(path)
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.groupBy("lang").agg(F.sum("length").alias("bytes"))
