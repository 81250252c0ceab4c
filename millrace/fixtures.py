"""Tables derived from the driver tables, the same formula for Spark and for the SQL check."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from millrace.session import spread

MIME_BY_REMAINDER = ["text/html", "image/gif", "application/x-javascript", "application/rss+xml", "text/plain"]

_MIME_CASE = (
    "CASE e.event_id % 5 "
    + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MIME_BY_REMAINDER))
    + " END"
)

# {idiv} is the integer division of the dialect.
_REQUESTS = f"""
SELECT e.event_id AS req_id, e.ts AS ts, e.user_id AS user_id,
       '10.0.' || CAST(e.user_id {{idiv}} 256 AS STRING) || '.' || CAST(e.user_id % 256 AS STRING) AS client_ip,
       CASE WHEN e.event_type = 'error' THEN 'HEAD'
            WHEN e.event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
       p.page_id AS page_id, p.url AS url, {_MIME_CASE} AS mime,
       CASE WHEN e.event_type = 'error' THEN 503 WHEN e.event_id % 9 = 0 THEN 302 WHEN e.event_id % 31 = 0 THEN 304 ELSE 200 END AS status,
       CAST(floor(e.value * 100) AS BIGINT) AS bytes
FROM {{events}} e JOIN {{pages}} p ON p.page_id = e.event_id % {{page_count}}
"""

_S = "regexp_extract(url, '^([a-z]+)://', 1)"
_H = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_D = "regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1)"

# URL spellings, each made from the page URL: scheme s, host h, document d.
_URL_VARIANTS = [
    "url",
    "upper(s) || '://' || upper(h) || ':80' || d",
    "s || '://' || h || ':8080/a/./b/../c//d' || d",
    "s || '://' || h || './x%7Ey/%41b%c3%a9?q=a+b;c=d%20e&f&g='",
    "s || '//' || h || d",
    "s || '://' || h || ':443' || chr(92) || 'dir' || chr(92) || '..' || chr(92) || 'file?z'",
    "s || '://' || h || '?only=query'",
    "s || '://' || h || '#'",
    "s || '://' || h || '/a;param=1/b;type=x?y?u=2=3'",
    "s || '://user:pw@' || h || ':99999/../../up/%2e%2e/x.html'",
    "s || '://' || h || '/go?location=http%3A%2F%2Fother.example%2Fp%3Fa%3D1&x=2'",
    "s || '://a---' || h || '/%%%%%%%%%%%%x'",
    "s || '://' || h || '/img/banner_468x60.gif'",
    "s || '://' || h || '/js/app.js?v=1'",
    "s || '://' || h || '/a b/c\"d' || d",
    "'../' || d || '/./x/..'",
]

URL_CASE_COUNT = 16


def _url_cases(explode_open: str, explode_close: str) -> str:
    cases = ", ".join(_URL_VARIANTS)
    return (
        f"SELECT page_id, page_id * 16 + v AS url_id, url FROM (SELECT page_id, v, "
        f"CASE v {' '.join(f'WHEN {i} THEN {e}' for i, e in enumerate(_URL_VARIANTS))} END AS url FROM "
        f"(SELECT page_id, url, {_S} AS s, {_H} AS h, {_D} AS d, {explode_open}{len(_URL_VARIANTS) - 1}{explode_close} AS v "
        f"FROM {{pages}}))"
    )


# (stage, name, value, condition); date is the request time as an HTTP date.
_HEADERS = [
    ("request", "Host", f"{_H}", "true"),
    ("request", "Host", "'second.example'", "req_id % 13 = 0"),
    ("request", "Accept-Encoding", "CASE WHEN req_id % 2 = 0 THEN 'gzip;q=1.0, deflate;q=0.9, identity;q=0.5' ELSE 'identity, X-GZIP; q=0.3' END", "req_id % 9 <> 0"),
    ("request", "User-Agent", "'agent/' || CAST(user_id % 7 AS STRING)", "true"),
    ("request", "Connection", "CASE WHEN req_id % 3 = 0 THEN 'close, X-Hop' ELSE 'Keep-Alive' END", "true"),
    ("request", "X-Hop", "'hop' || CAST(req_id % 10 AS STRING)", "req_id % 2 = 0"),
    ("request", "TE", "'trailers'", "req_id % 4 = 1"),
    ("response", "Content-Type", "CASE WHEN req_id % 6 = 0 THEN mime || '; charset=UTF-8' ELSE mime END", "req_id % 17 <> 0"),
    ("response", "Content-Length", "CASE WHEN req_id % 23 = 0 THEN 'many' ELSE CAST(bytes AS STRING) END", "req_id % 5 <> 4"),
    ("response", "Content-Length", "CAST(bytes + 1 AS STRING)", "req_id % 7 = 0"),
    ("response", "Date", "date", "req_id % 19 <> 0"),
    ("response", "Age", "CAST(req_id % 600 AS STRING)", "req_id % 4 = 0"),
    ("response", "Age", "'0'", "req_id % 12 = 0"),
    ("response", "Warning", "'110 cache \"Response is stale\" \"' || date || '\"'", "req_id % 11 = 0"),
    ("response", "Warning", "'111 proxy.example:80 \"Revalidation failed\" \"Mon, 01 Jan 1990 00:00:00 GMT\"'", "req_id % 22 = 0"),
    ("response", "Warning", "'113 Heuristic expiration'", "req_id % 33 = 0"),
    ("response", "Warning", "'stale cache \"text\"'", "req_id % 44 = 0"),
    ("response", "Trailer", "CASE WHEN req_id % 2 = 0 THEN 'Content-Length' ELSE 'X-Check' END", "req_id % 5 = 0"),
    ("response", "Transfer-Encoding", "'Chunked'", "req_id % 6 = 1"),
    ("response", "Content-Encoding", "'gzip'", "req_id % 4 = 2"),
    ("response", "Cache-Control", "CASE WHEN req_id % 8 = 2 THEN 'No-Transform' ELSE 'max-age=60' END", "true"),
    ("response", "Connection", "'close'", "req_id % 3 = 1"),
    ("response", "X-Rating", "CASE WHEN req_id % 20 = 0 THEN 'http://other.example/rating' ELSE 'http://rating.example/service' END", "req_id % 10 = 0"),
    ("response", "X-Rating-violence", "CASE WHEN req_id % 3 = 0 THEN 'heavy' ELSE 'none' END", "req_id % 10 = 0"),
    ("response", "X-Rating-Age", "CAST(req_id % 18 AS STRING) || '-'", "req_id % 10 = 0"),
    ("response", "Location", "CASE WHEN req_id % 2 = 0 THEN 'http://localhost/next' ELSE 'http://other.example/next' END", "status = 302"),
]


def _headers(dialect: str) -> str:
    if dialect == "spark":
        items = ", ".join(
            f"CASE WHEN {c} THEN struct({i} AS pos, '{s}' AS stage, '{n}' AS name, {v} AS value) END"
            for i, (s, n, v, c) in enumerate(_HEADERS)
        )
        return (
            f"SELECT req_id, ts, page_id, url, status, mime, filter(h, x -> x.stage = 'request') AS request, "
            f"filter(h, x -> x.stage = 'response') AS response FROM (SELECT *, array_compact(array({items})) AS h FROM "
            "(SELECT *, date_format(ts, 'EEE, dd MMM yyyy HH:mm:ss') || ' GMT' AS date FROM {requests}))"
        )
    items = ", ".join(
        f"CASE WHEN {c} THEN {{{{'pos': {i}, 'stage': '{s}', 'name': '{n}', 'value': {v}}}}} END"
        for i, (s, n, v, c) in enumerate(_HEADERS)
    )
    return (
        "SELECT req_id, h.pos AS pos, h.stage AS stage, h.name AS name, h.value AS value FROM "
        f"(SELECT req_id, unnest([{items}]) AS h FROM "
        "(SELECT *, strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT' AS date FROM {requests})) WHERE h IS NOT NULL"
    )


_HOSTS = f"SELECT DISTINCT {_H} AS host FROM {{pages}}"


# Domain lists: every host falls into the lists by its name.
_LIST_ENTRIES = [
    ("'blockdomains'", "'wc.10' || CAST(length(host) % 3 AS STRING)", "host", "length(host) % 5 = 0 OR host LIKE 'spam-farm%' OR host LIKE '%cheap-pills%'"),
    ("'blockdomains'", "'wc.109'", "host", "length(host) % 10 = 0"),
    ("'allowdomains'", "'wc.11' || CAST(length(host) % 2 AS STRING)", "host", "length(host) % 11 = 0"),
    ("'blockurls'", "'wc.12' || CAST(length(host) % 2 AS STRING)", "'//' || host || '/fr'", "length(host) % 2 = 0"),
    ("'allowurls'", "'wc.130'", "host || '/en/1'", "length(host) % 3 = 0"),
]


def _per_host(names: list[str], cases: list[tuple[str, ...]], dialect: str) -> str:
    """The cases (values and a condition, last) of every host as rows: one scan in Spark, plain selects for the check."""
    if dialect == "spark":
        made = [f"CASE WHEN {c[-1]} THEN struct({', '.join(f'{v} AS {n}' for v, n in zip(c, names))}) END" for c in cases]
        return f"SELECT inline(array_compact(array({', '.join(made)}))) FROM {{hosts}}"
    return " UNION ALL ".join(f"SELECT {', '.join(f'{v} AS {n}' for v, n in zip(c, names))} FROM {{hosts}} WHERE {c[-1]}" for c in cases)


def _lists(dialect: str) -> str:
    return _per_host(["kind", "sid", "entry"], _LIST_ENTRIES, dialect)


# Tags that hit every security check, and harmless ones; each page ends with most of them.
TAG_SAMPLES = [
    '<a href="http://x/' + "%" * 12 + '">a</a>',
    '<a href="http://a---b.example/">b</a>',
    '<a href="http://ok.example/x?a=1&amp;b=2">c</a>',
    '<applet hspace="12345x"></applet>',
    '<body onload="x=window ( );">',
    '<embed src="http://x/file.averylongextension?z">',
    '<embed src="' + "e" * 1030 + '" name="n">',
    '<fieldset style="position:absolute">f</fieldset>',
    '<font size="+1000000">g</font>',
    '<frame src="f.html" name="' + "n" * 1025 + '">',
    '<hr align="' + "z" * 60 + '">',
    '<iframe src="http://x---y/' + "%" * 11 + '"></iframe>',
    '<img src=" JavaScript:alert(1)" alt="one">',
    '<img src="a.gif" lowsrc="javascript:x" width="10px" height="5.5" alt="Two\nlines" >',
    '<input type="" name=q>',
    '<input type=text disabled/>',
    '<link rel="icon" href="javascript:alert(2)">',
    '<link rel=stylesheet href="javascript:alert(3)">',
    '<meta http-equiv="Refresh" content="1; url=http://ok/;url=javascript:x">',
    '<meta http-equiv=refresh content="5;url=http://fine.example/">',
    '<meta name="X-Rating" content="http://rating.example/service">',
    '<meta name="X-Rating-violence" content="mild">',
    '<object type="a//b/c" classid="clsid:ec444cb6-3e7e-4865-b1c3-0de72ef39b3f"></object>',
    '<object data="ms-its:mhtml:file://C:x.mht!http://evil/x.chm"></object>',
    '<object codebase="HHCTRL.ocx#1"><param name="p" value="' + "w" * 60 + '"></object>',
    '<object><object><object><object><object>deep</object></object></object></object></object>',
    '<table width="-1"><tr><td width="100%%" height="9999">t</td><td width="abc" height="12345">u</td></tr></table>',
    "<p " + " ".join(f"a{i}=1" for i in range(205)) + ">many</p>",
    '<htmm><hrr/><xyzzy><xmlns:a><bllnk><conten>m</conten>',
    '<!-- note --><!----><? pi ?><unclosed',
    '<base href="http://base.example/dir/">',
    '<b><i>nested <b>twice</b></i></b><script>if (a<b) x("</b>");</script>',
    '<td title="\u00e9 &quot;q&quot;" nowrap>u</td>',
    '<a title="x>y" href="/quoted">v</a>',
    "<p class='one > two' id=three>w</p>",
    '<img alt="<b>" src = "/i.png"/>',
    '<em title="open>x</em>',
    '<a href="/cut',
]


def _tag_samples() -> str:
    parts = " || ".join(
        "CASE WHEN (page_id * 7 + length(html) + {}) % 5 <> 0 THEN '{}' ELSE '' END".format(i, s.replace("'", "''").replace("{", "{{").replace("}", "}}"))
        for i, s in enumerate(TAG_SAMPLES)
    )
    return f"SELECT page_id, url, html || {parts} AS html FROM {{pages}}"


RULE_KINDS = [
    "allow", "block", "blockdomains", "allowurls", "header", "htmlrewrite", "image",
    "imagereduce", "javascript", "nocomments", "rating", "replace", "xmlrewrite", "antivirus",
]
_KIND_CASE = "CASE k % 14 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(RULE_KINDS)) + " END"

# A catalogue of rules that grows with the part table.
_RULES = f"""
SELECT k, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 50 = 1 THEN 'wc.' || CAST(k + 1 AS STRING)
            WHEN k % 8 = 3 THEN 'lc.' || CAST(k AS STRING) ELSE 'wc.' || CAST(k AS STRING) END AS sid,
       'wc.f' || CAST(size % 20 AS STRING) AS folder_sid, CAST((size % 20) * 7 % 20 AS INT) AS folder_oid,
       CASE WHEN size % 20 IN (3, 11) THEN true ELSE false END AS folder_disable, k AS oid, {_KIND_CASE} AS kind,
       CASE WHEN k % 6 = 0 THEN true ELSE false END AS disable, name AS title_en,
       CASE WHEN k % 4 = 0 THEN NULL ELSE type END AS title_de, lower(brand) AS url,
       CASE WHEN k % 3 = 0 THEN 'text/html' WHEN k % 3 = 1 THEN 'image/gif' END AS mime
FROM (SELECT p_partkey AS k, p_size AS size, p_name AS name, p_type AS type, p_brand AS brand FROM {{part}})
"""

_RULES_INCOMING = """
SELECT sid, folder_sid, kind, CASE WHEN k % 9 = 0 THEN url || '/new' ELSE url END AS url, mime,
       CASE WHEN k % 10 = 0 THEN 'New ' || title_en ELSE title_en END AS title_en,
       CASE WHEN k % 20 = 4 THEN 'Neu' ELSE title_de END AS title_de
FROM {rules} WHERE k % 12 <> 0 AND sid IS NOT NULL AND k % 50 NOT IN (1, 2)
UNION ALL
SELECT 'wc.new' || CAST(k AS STRING), folder_sid, kind, url, mime, title_en, title_de FROM {rules} WHERE k % 40 = 0
UNION ALL
SELECT 'lc.new' || CAST(k AS STRING), folder_sid, kind, url, mime, title_en, title_de FROM {rules} WHERE k % 41 = 0
"""


_SEG = "regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)', 1)"
_DEGREE = "CASE ({0}) % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'mild' WHEN 2 THEN 'heavy' WHEN 3 THEN 'none' END"

# Ratings of every site and every first path segment; some categories are missing, some values unsafe.
_RATINGS = f"""
SELECT url, generic, CASE n % 6 WHEN 0 THEN '10-' WHEN 1 THEN '6-18' WHEN 2 THEN '-12' WHEN 3 THEN '7' WHEN 4 THEN '' END AS age,
       {_DEGREE.format('n')} AS language, {_DEGREE.format('n + 1')} AS sex, {_DEGREE.format('n + 2')} AS violence,
       1700000000 + n * 60 AS modified
FROM (SELECT DISTINCT {_S} || '://' || {_H} AS url, true AS generic, length({_H}) AS n FROM {{pages}}
      UNION ALL
      SELECT DISTINCT {_S} || '://' || {_H} || '/' || {_SEG}, false, length({_H}) + ascii({_SEG}) FROM {{pages}} WHERE {_SEG} <> '')
WHERE n % 7 <> 0
"""


_ZONE = "regexp_extract(host, '([^.]+[.][^.]+)$', 1)"
_BARE = "regexp_replace(host, '^(www|m|blog)[.]', '')"

# Records of the zones of all hosts; seq is the order in which they were added.
_N = "length(host)"
_RECORDS = [
    (_BARE, "'A'", f"300 + {_N} * 10", f"'10.9.' || CAST({_N} AS STRING) || '.' || CAST(ascii(host) AS STRING)", "true"),
    (_BARE, "'A'", f"120 + {_N}", f"'10.8.0.' || CAST({_N} AS STRING)", f"{_N} % 3 = 0"),
    ("host", "'CNAME'", f"60 + {_N}", _BARE, f"host <> {_BARE}"),
    ("'alias.' || host", "'CNAME'", "900", "host", "true"),
    ("'deep.alias.' || host", "'CNAME'", "30", "'alias.' || host", f"{_N} % 2 = 0"),
    ("'loop.' || host", "'CNAME'", "5", "'pool.' || host", f"{_N} % 5 = 0"),
    ("'pool.' || host", "'CNAME'", "5", "'loop.' || host", f"{_N} % 5 = 0"),
    ("'gone.' || host", "'CNAME'", "5", "'nowhere.' || host", f"{_N} % 7 = 0"),
    (_ZONE, "'SOA'", "3600", f"'ns1.' || {_ZONE} || ' admin ' || CAST({_N} AS STRING)", "true"),
    (_ZONE, "'NS'", f"3600 + {_N}", f"'ns' || CAST({_N} % 2 AS STRING) || '.' || {_ZONE}", f"{_ZONE} <> 'example.org'"),
]


def _dns_records(dialect: str) -> str:
    names = ["zone", "name", "rdclass", "rdtype", "ttl", "rdata", "seq"]
    cases = [(_ZONE, name, "'IN'", kind, f"CAST({ttl} AS BIGINT)", rdata, f"{_N} * 10 + {k}", c) for k, (name, kind, ttl, rdata, c) in enumerate(_RECORDS)]
    return _per_host(names, cases, dialect)


_LOOKUPS = f"""
SELECT req_id, {_H} AS host, {{micros}} AS at_us, CASE WHEN status = 503 THEN 'error' ELSE 'found' END AS kind FROM {{requests}}
"""

_TRANSFERS = f"""
SELECT req_id, {_H} AS endpoint, CASE WHEN length({_H}) % 2 = 0 THEN 'HTTP/1.0' ELSE 'HTTP/1.1' END AS version,
       {{micros}} AS start_us, {{micros}} + bytes * 2000000 AS end_us FROM {{requests}}
"""

# A list of files and the checksums published for them; one in ten differs, is missing or is new.
_FILES = "SELECT 'f' || CAST(doc_id AS STRING) || '.zap' AS filename, text AS content, CASE WHEN doc_id % 7 = 0 THEN '1.0' ELSE '0.10' END AS version FROM {documents} WHERE doc_id % 10 <> 5"
_MANIFEST = """SELECT 'f' || CAST(doc_id AS STRING) || '.zap' AS filename, md5(CASE WHEN doc_id % 10 = 4 THEN text || '!' ELSE text END) AS md5sum, '0.12' AS version
FROM {documents} WHERE doc_id % 10 <> 3"""


class Tables:
    """Driver tables of one folder and the tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return spread(self.spark.read.parquet(f"{self.dir}/{name}.parquet"))

    def sql(self, text: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(text, **tables)

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def part(self) -> DataFrame:
        return self.table("part")

    @cached_property
    def requests(self) -> DataFrame:
        # a count over parquet is answered from the footers
        text = _REQUESTS.replace("{idiv}", "div").replace("{page_count}", str(self.pages.count()))
        return self.sql(text, events=self.events, pages=self.pages.select("page_id", "url", "html"))

    @cached_property
    def url_cases(self) -> DataFrame:
        text = _url_cases("explode(sequence(0, ", "))")
        return self.sql(text, pages=self.pages.select("page_id", "url", "html"))

    @cached_property
    def messages(self) -> DataFrame:
        """One row per request with its header lists: req_id, ts, url, status, mime, request, response."""
        return self.sql(_headers("spark"), requests=self.requests)

    @cached_property
    def headers(self) -> DataFrame:
        """The long form of the messages: req_id, pos, stage, name, value."""
        return self.messages.selectExpr("req_id", "inline(concat(request, response))")

    @cached_property
    def hosts(self) -> DataFrame:
        return self.sql(_HOSTS, pages=self.pages.select("url"))

    @cached_property
    def ratings(self) -> DataFrame:
        return self.sql(_RATINGS, pages=self.pages.select("url"))

    @cached_property
    def dns_records(self) -> DataFrame:
        return self.sql(_dns_records("spark"), hosts=self.hosts)

    @cached_property
    def lookups(self) -> DataFrame:
        return self.sql(_LOOKUPS.replace("{micros}", "unix_micros(cast(ts AS timestamp))"), requests=self.requests)

    @cached_property
    def transfers(self) -> DataFrame:
        return self.sql(_TRANSFERS.replace("{micros}", "unix_micros(cast(ts AS timestamp))"), requests=self.requests)

    @cached_property
    def files(self) -> DataFrame:
        return self.sql(_FILES, documents=self.documents)

    @cached_property
    def manifest(self) -> DataFrame:
        return self.sql(_MANIFEST, documents=self.documents)

    @cached_property
    def tag_samples(self) -> DataFrame:
        return self.sql(_tag_samples(), pages=self.pages.select("page_id", "url", "html"))

    @cached_property
    def lists(self) -> DataFrame:
        return self.sql(_lists("spark"), hosts=self.hosts)

    @cached_property
    def rules(self) -> DataFrame:
        return self.sql(_RULES, part=self.part)

    @cached_property
    def rules_incoming(self) -> DataFrame:
        return self.sql(_RULES_INCOMING, rules=self.rules)


def _duck(text: str) -> str:
    text = text.replace("{page_count}", "(SELECT count(*) FROM pages)")
    text = text.replace("{micros}", "epoch_us(ts)")
    return text.replace("{idiv}", "//").replace("AS STRING", "AS VARCHAR").format(
        events="events", pages="pages", requests="requests", documents="documents", part="part", hosts="hosts", rules="rules"
    )


SQL_FIXTURES: dict[str, str] = {
    "requests": _duck(_REQUESTS),
    "url_cases": _duck(_url_cases("unnest(range(0, 1 + ", "))")),
    "headers": _duck(_headers("duckdb")),
    "hosts": _duck(_HOSTS),
    "tag_samples": _duck(_tag_samples()),
    "lists": _duck(_lists("duck")),
    "dns_records": _duck(_dns_records("duck")),
    "lookups": _duck(_LOOKUPS),
    "transfers": _duck(_TRANSFERS),
    "local_files": _duck(_FILES),
    "manifest": _duck(_MANIFEST),
    "ratings": _duck(_RATINGS),
    "rules": _duck(_RULES),
    "rules_incoming": _duck(_RULES_INCOMING),
}
