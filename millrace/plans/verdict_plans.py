"""Verdict, list and admission queries over requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import policy as P
from millrace.functions import rules as R
from millrace.functions import urls as U
from millrace.operators import headers as A
from millrace.operators import verdict as V
from millrace.plans.loaded import rule_set
from millrace.plans.registry import query
from millrace.plans.url_plans import HOST, MEDIA_SQL


def listed(t, kind):
    return t.lists.where(F.col("kind") == kind).select("sid", "entry")


def ranked(t, kind):
    """Entries of one list with a total order: sid, then entry."""
    return listed(t, kind).select(F.struct("sid", "entry").alias("rank"), "sid", "entry")


def values(rows) -> str:
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows) + ")"


@query("block_domains", sql=f"SELECT req_id FROM requests WHERE {HOST} IN (SELECT entry FROM lists WHERE kind = 'blockdomains')")
def block_domains(t):
    hosts = listed(t, "blockdomains").select(F.col("entry").alias("host"))
    return t.requests.select("req_id", U.host(F.col("url")).alias("host")).join(hosts, "host", "left_semi").select("req_id")


@query(
    "block_urls",
    sql="""SELECT req_id, min(l.sid) AS sid FROM requests r JOIN lists l ON l.kind = 'blockurls' AND contains(r.url, l.entry) GROUP BY req_id""",
)
def block_urls(t):
    hits = V.first_substring(t.requests.select("req_id", "url"), "url", ranked(t, "blockurls"), "sid")
    return hits.where(F.col("sid").isNotNull()).select("req_id", "sid")


@query(
    "block_patterns",
    sql=f"""SELECT req_id, CAST(rank AS INTEGER) AS rank, sid FROM requests JOIN
    {values([(i, r.sid, r.pattern) for i, r in enumerate(P.BLOCK_PATTERNS)])} v(rank, sid, pattern) ON regexp_matches(url, pattern)""",
)
def block_patterns(t):
    return t.requests.select("req_id", F.inline(R.pattern_hits(F.col("url"), rule_set(t).block_patterns)))


def _expand_sql(rule) -> str:
    import re

    parts = re.split(r"\\(\d)", rule.replacement)
    return " || ".join(
        f"regexp_extract(url, '{rule.pattern}', {p})" if i % 2 else f"'{p}'" for i, p in enumerate(parts) if p or i % 2
    )


FIRST_PATTERN_SQL = "CASE " + " ".join(f"WHEN regexp_matches(url, '{r.pattern}') THEN '{r.sid}'" for r in P.BLOCK_PATTERNS) + " END"
REPLACEMENT_SQL = (
    "CASE " + " ".join(f"WHEN regexp_matches(url, '{r.pattern}') THEN {_expand_sql(r) if r.replacement else 'NULL'}" for r in P.BLOCK_PATTERNS) + " END"
)


@query(
    "block_replacement",
    sql=f"SELECT req_id, {FIRST_PATTERN_SQL} AS sid, {REPLACEMENT_SQL} AS replacement FROM requests WHERE {FIRST_PATTERN_SQL} IS NOT NULL",
)
def block_replacement(t):
    hits = t.requests.select("req_id", R.first_pattern(F.col("url"), rule_set(t).block_patterns).alias("p"))
    return hits.where(F.col("p").isNotNull()).select("req_id", "p.sid", "p.replacement")


ALLOW_PATTERN_SQL = "CASE " + " ".join(f"WHEN regexp_matches(url, '{r.pattern}') THEN '{r.sid}'" for r in P.ALLOW_PATTERNS) + " END"
VERDICT_BODY = f"""
url_entries AS (SELECT kind, sid, entry FROM lists WHERE kind IN ('allowurls', 'blockurls')
  UNION ALL SELECT 'allowurls', sid, entry FROM {values(P.ALLOW_URLS)} a(sid, entry) UNION ALL SELECT 'blockurls', sid, entry FROM {values(P.BLOCK_URLS)} b(sid, entry)),
url_hits AS (SELECT url, kind, sid FROM (SELECT DISTINCT url FROM requests) JOIN url_entries ON entry <> '' AND contains(url, entry)),
first_urls AS (SELECT url AS u, min(sid) FILTER (kind = 'allowurls') AS au, min(sid) FILTER (kind = 'blockurls') AS bu FROM url_hits GROUP BY url),
v0 AS (SELECT r.*, {HOST} AS host, {MEDIA_SQL} AS media FROM requests r),
v1 AS (SELECT v0.*, (SELECT min(sid) FROM lists l WHERE l.kind = 'allowdomains' AND l.entry = host) AS ad,
   au, {ALLOW_PATTERN_SQL} AS ap,
   (SELECT min(sid) FROM lists l WHERE l.kind = 'blockdomains' AND l.entry = host) AS bd,
   bu, {FIRST_PATTERN_SQL} AS bp, {REPLACEMENT_SQL} AS rep FROM v0 LEFT JOIN first_urls ON u = v0.url),
verdicts AS (SELECT req_id, url, host, media, ts, bytes, status,
   CASE WHEN coalesce(ad, au, ap) IS NOT NULL THEN 'allow' WHEN coalesce(bd, bu, bp) IS NOT NULL THEN 'block' ELSE 'pass' END AS verdict,
   CASE WHEN ad IS NOT NULL THEN 'domain' WHEN au IS NOT NULL THEN 'url' WHEN ap IS NOT NULL THEN 'pattern'
        WHEN bd IS NOT NULL THEN 'domain' WHEN bu IS NOT NULL THEN 'url' WHEN bp IS NOT NULL THEN 'pattern' ELSE '' END AS list_class,
   coalesce(ad, au, ap, bd, bu, bp) AS sid,
   CASE WHEN bd IS NULL AND bu IS NULL THEN rep END AS rep FROM v1)
"""


def url_list(t, kind, own):
    """Listed URL entries together with literal ones, ranked by sid and entry."""
    literal = F.inline(F.array(*[F.struct(F.lit(s).alias("sid"), F.lit(e).alias("entry")) for s, e in own]))
    both = listed(t, kind).unionByName(t.spark.range(1).select(literal))
    return both.select(F.struct("sid", "entry").alias("rank"), "sid", "entry")


def verdicts(t, requests=None):
    return V.url_verdict(
        t.requests if requests is None else requests,
        listed(t, "allowdomains"), listed(t, "blockdomains"),
        url_list(t, "allowurls", P.ALLOW_URLS), url_list(t, "blockurls", P.BLOCK_URLS), rule_set(t).allow_patterns, rule_set(t).block_patterns,
    )


@query("allow_override", sql=f"WITH {VERDICT_BODY} SELECT req_id FROM v1 WHERE coalesce(bd, bu, bp) IS NOT NULL AND coalesce(ad, au, ap) IS NULL")
def allow_override(t):
    """Requests hit by a block list and by no allow list."""
    return verdicts(t).where(F.col("verdict") == "block").select("req_id")


@query(
    "url_verdict",
    sql=f"""WITH {VERDICT_BODY} SELECT req_id, verdict, list_class, sid, CASE WHEN verdict = 'block' THEN
   CASE WHEN starts_with(d, 'http://') THEN d ELSE 'http://localhost:8080' || d END END AS document FROM (
   SELECT *, coalesce(rep, CASE media WHEN 'image' THEN '/blocked.png' WHEN 'flash' THEN '/blocked.swf' WHEN 'javascript' THEN '/blocked.js'
     ELSE '/blocked.html?rule=' || sid || '&blockurl=' || replace(replace(url_encode(url), '~', '%7E'), '%20', '+') END) AS d FROM verdicts)""",
)
def url_verdict(t):
    return verdicts(t).select("req_id", "verdict", "list_class", "sid", "document")


@query(
    "nofilter_hosts",
    sql=f"""SELECT req_id FROM (SELECT req_id, {HOST} AS host FROM requests) WHERE
    {' OR '.join(f"host LIKE '%{e}'" if e.startswith('.') else f"host = '{e}'" for e in P.EXEMPT_HOSTS)}""",
)
def nofilter_hosts(t):
    """Hosts equal to an entry, or below it when the entry starts with a dot."""
    entries = t.spark.createDataFrame([(e,) for e in P.EXEMPT_HOSTS], "entry string")
    rows = t.requests.select("req_id", U.host(F.col("url")).alias("host"))
    return V.exempt_hosts(rows, "host", entries).select("req_id")


HITS_SQL = f"""
hits AS (SELECT req_id, 'domain' AS list_class, sid FROM v0 JOIN lists l ON l.kind = 'blockdomains' AND l.entry = host
  UNION ALL SELECT req_id, 'url', sid FROM requests JOIN url_hits USING (url) WHERE kind = 'blockurls'
  UNION ALL SELECT req_id, 'pattern', sid FROM requests JOIN {values([(r.sid, r.pattern) for r in P.BLOCK_PATTERNS])} p(sid, pattern) ON regexp_matches(url, pattern))
"""


def block_hits(t):
    """Every block list hit of every request: req_id, list_class, sid."""
    rows = t.requests.select("req_id", "url", U.host(F.col("url")).alias("host"))
    domains = rows.join(listed(t, "blockdomains").withColumnRenamed("entry", "host"), "host").select("req_id", F.lit("domain").alias("list_class"), "sid")
    urls = rows.join(V.substring_pairs(rows, "url", url_list(t, "blockurls", P.BLOCK_URLS)), "url").select("req_id", F.lit("url").alias("list_class"), "sid")
    patterns = rows.select("req_id", F.lit("pattern").alias("list_class"), F.explode(F.transform(R.pattern_hits(F.col("url"), rule_set(t).block_patterns), lambda h: h["sid"])).alias("sid"))
    return domains.unionByName(urls).unionByName(patterns)


@query(
    "rule_hits",
    sql=f"WITH {VERDICT_BODY}, {HITS_SQL} SELECT list_class, sid, count(*) AS hits, count(DISTINCT req_id) AS requests FROM hits GROUP BY ALL",
)
def rule_hits(t):
    # hits of one request collapse first, so the distinct count needs no second shuffle of rows
    per_request = block_hits(t).groupBy("list_class", "sid", "req_id").agg(F.count("*").alias("n"))
    return per_request.groupBy("list_class", "sid").agg(F.sum("n").alias("hits"), F.count("*").alias("requests"))


@query(
    "top_rules",
    sql=f"WITH {VERDICT_BODY}, {HITS_SQL} SELECT sid, count(*) AS hits FROM hits GROUP BY sid ORDER BY hits DESC, sid LIMIT 5",
)
def top_rules(t):
    return block_hits(t).groupBy("sid").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "sid").limit(5)


@query(
    "verdict_by_host",
    sql=f"""WITH {VERDICT_BODY} SELECT host, media, count(*) AS requests, count(*) FILTER (verdict = 'allow') AS allowed,
    count(*) FILTER (verdict = 'block') AS blocked FROM verdicts GROUP BY ALL""",
)
def verdict_by_host(t):
    return verdicts(t).groupBy("host", "media").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("verdict") == "allow").alias("allowed"),
        F.count_if(F.col("verdict") == "block").alias("blocked"),
    )


@query("lists_union", sql="SELECT CASE WHEN kind LIKE 'block%' THEN 'block' ELSE 'allow' END AS side, sid, entry FROM lists")
def lists_union(t):
    """All entries of a side with their sid, domains and URLs together."""

    def side(name):
        both = listed(t, name + "domains").unionByName(listed(t, name + "urls"))
        return both.select(F.lit(name).alias("side"), "sid", "entry")

    return side("block").unionByName(side("allow"))


@query(
    "list_difference",
    sql="""SELECT 'domains' AS part, entry FROM (SELECT entry FROM lists WHERE kind = 'blockdomains' EXCEPT SELECT entry FROM lists WHERE kind = 'allowdomains')
    UNION ALL SELECT 'urls', entry FROM (SELECT entry FROM lists WHERE kind = 'blockurls' EXCEPT SELECT entry FROM lists WHERE kind = 'allowurls')""",
)
def list_difference(t):
    """Blocked entries that are not allowed as well, domains and URLs."""

    def part(name):
        blocked = listed(t, f"block{name}").select("entry").distinct()
        return blocked.join(listed(t, f"allow{name}"), "entry", "left_anti").select(F.lit(name).alias("part"), "entry")

    return part("domains").unionByName(part("urls"))


@query("first_rule_match", sql=f"SELECT req_id, {FIRST_PATTERN_SQL} AS sid FROM requests WHERE {FIRST_PATTERN_SQL} IS NOT NULL")
def first_rule_match(t):
    """First rule in order: the least of the packed (rank, sid) hits, without a shuffle."""
    first = F.array_min(R.pattern_hits(F.col("url"), rule_set(t).block_patterns))["sid"]
    return t.requests.select("req_id", first.alias("sid")).where(F.col("sid").isNotNull())


@query(
    "request_admission",
    sql="""WITH cases AS (SELECT req_id, CASE WHEN req_id % 50 = 0 THEN 'BREW' WHEN req_id % 50 = 1 THEN 'CONNECT' ELSE method END AS method,
      CASE WHEN req_id % 50 = 2 THEN 'gopher' || url[5:] WHEN req_id % 50 = 3 THEN '' WHEN req_id % 50 = 4 THEN url || repeat('x', 9000)
           WHEN req_id % 50 = 1 THEN regexp_extract(url, '//([^/]*)', 1) || CASE WHEN req_id % 100 = 1 THEN ':443' ELSE ':25' END ELSE url END AS url,
      CASE WHEN req_id % 50 = 5 THEN 'HTTP/2.0' WHEN req_id % 50 = 6 THEN 'junk' ELSE 'HTTP/1.1' END AS version FROM requests)
    SELECT req_id, CAST(CASE WHEN method NOT IN ('GET', 'HEAD', 'CONNECT', 'POST') THEN 405 WHEN url = '' THEN 400
      WHEN version NOT IN ('HTTP/0.9', 'HTTP/1.0', 'HTTP/1.1') THEN 505 WHEN len(url) > 8192 THEN 414
      WHEN method = 'CONNECT' AND NOT (regexp_extract(url, ':([0-9]+)$', 1) IN ('443', '563') OR coalesce(try_cast(regexp_extract(url, ':([0-9]+)$', 1) AS INTEGER) BETWEEN 1024 AND 65535, false)) THEN 403
      WHEN method <> 'CONNECT' AND NOT regexp_matches(url, '^https?://') THEN 403 END AS INTEGER) AS status FROM cases""",
)
def request_admission(t):
    from millrace.functions import http as H

    r, url = F.col("req_id") % 50, F.col("url")
    target = F.concat(U.netloc(url), F.when(F.col("req_id") % 100 == 1, ":443").otherwise(":25"))
    cases = t.requests.select(
        "req_id",
        F.when(r == 0, "BREW").when(r == 1, "CONNECT").otherwise(F.col("method")).alias("method"),
        F.when(r == 2, F.concat(F.lit("gopher"), url.substr(F.lit(5), F.length(url))))
        .when(r == 3, "")
        .when(r == 4, F.concat(url, F.repeat(F.lit("x"), 9000)))
        .when(r == 1, target)
        .otherwise(url)
        .alias("url"),
        F.when(r == 5, "HTTP/2.0").when(r == 6, "junk").otherwise("HTTP/1.1").alias("version"),
    )
    return cases.select("req_id", H.admission_status(F.col("method"), F.col("url"), F.col("version")).alias("status"))


@query(
    "redirect_to_local",
    sql="""WITH sent AS (SELECT req_id, value FROM headers WHERE name = 'Location' AND regexp_matches(value, '^https?://(localhost|127[.]0[.]0[.]1)(:|/|$)'))
    SELECT req_id FROM requests WHERE status IN (301, 302) AND req_id IN (SELECT req_id FROM sent)
      AND NOT regexp_matches(url, '^https?://(localhost|127[.]0[.]0[.]1)(:|/|$)')""",
)
def redirect_to_local(t):
    """A message holds its URL, status and headers: one filter."""
    local = lambda url: F.coalesce(U.host(url).isin("localhost", "127.0.0.1"), F.lit(False))
    target = F.exists(A.named(F.col("response"), "location"), lambda h: local(h["value"]))
    return t.messages.where(F.col("status").isin(301, 302) & target & ~local(F.col("url"))).select("req_id")


@query(
    "image_reduce_candidates",
    sql="""SELECT req_id, coalesce(sid, '') AS sid, CAST(coalesce(quality, 20) AS INTEGER) AS quality FROM (
      SELECT *, CASE WHEN regexp_matches(url, '/en/') THEN 'wc.811' WHEN regexp_matches(url, 'example[.]net|blog[.]') THEN 'wc.812' END AS sid,
        CASE WHEN regexp_matches(url, '/en/') THEN 40 WHEN regexp_matches(url, 'example[.]net|blog[.]') THEN 60 END AS quality,
        CASE WHEN regexp_matches(url, '/en/') THEN 2000 WHEN regexp_matches(url, 'example[.]net|blog[.]') THEN 1000 END AS minimal FROM requests)
      WHERE mime LIKE 'image/%' AND (bytes = 0 OR bytes >= coalesce(minimal, 5120))""",
)
def image_reduce_candidates(t):
    rule = None
    for q in rule_set(t).quality_rules:
        cond = R.applies_to_url(F.col("url"), q.matchurls, q.nomatchurls)
        value = F.struct(F.lit(q.sid).alias("sid"), F.lit(q.quality).alias("quality"), F.lit(q.minimal_size).alias("minimal"))
        rule = F.when(cond, value) if rule is None else rule.when(cond, value)
    default = F.struct(
        F.lit("").alias("sid"), F.lit(P.DEFAULT_QUALITY).alias("quality"), F.lit(P.DEFAULT_MINIMAL_SIZE).alias("minimal")
    )
    images = t.requests.where(F.startswith("mime", F.lit("image/")) & (F.col("bytes") >= 0))
    return (
        images.select("req_id", "bytes", rule.otherwise(default).alias("r"))
        .where((F.col("bytes") == 0) | (F.col("bytes") >= F.col("r.minimal")))
        .select("req_id", "r.sid", "r.quality")
    )


@query("min_size_gate", sql="SELECT req_id, mime FROM requests WHERE bytes >= CASE WHEN mime LIKE 'image/%' THEN 5120 ELSE 5 END")
def min_size_gate(t):
    least = F.when(F.startswith("mime", F.lit("image/")), 5120).otherwise(5)
    return t.requests.where(F.col("bytes") >= least).select("req_id", "mime")


@query(
    "signature_scan",
    sql=f"""SELECT doc_id, string_agg(name, ',' ORDER BY name) AS names, CASE WHEN count(name) > 0 THEN '' ELSE any_value(text) END AS content
      FROM documents LEFT JOIN {values(P.SIGNATURES)} s(name, sig) ON contains(text, sig) GROUP BY doc_id""",
)
def signature_scan(t):
    """Names of the signatures found; the content of a hit is blanked."""
    found = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(s)), F.lit(n)) for n, s in sorted(P.SIGNATURES)]))
    rows = t.documents.select("doc_id", "text", found.alias("found"))
    hit = F.size("found") > 0
    return rows.select(
        "doc_id", F.when(hit, F.array_join("found", ",")).alias("names"), F.when(hit, "").otherwise(F.col("text")).alias("content")
    )
