"""HTTP, text and network queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import http as H
from millrace.functions import net as N
from millrace.functions import text as X
from millrace.functions import urls as U
from millrace.functions.rules import handler_takes_mime
from millrace.operators import headers as A
from millrace import policy as P
from millrace.plans.registry import query
from millrace.plans.url_plans import PATH
from millrace.plans.verdict_plans import values

LINE_SQL = """CASE WHEN req_id % 10 = 0 THEN method || ' ' || url WHEN req_id % 10 = 1 THEN lower(method) || '  ' || url || ' http/1.0'
  WHEN req_id % 10 = 2 THEN method || ' ' || url || ' HTTP/x.1' WHEN req_id % 10 = 3 THEN ' ' || method || ' ' || url || ' HTTP/1.1 '
  ELSE method || ' ' || url || ' HTTP/0.9' END"""
VERSION_RE = "^HTTP/([0-9]+)[.]([0-9]+)$"


@query(
    "http_request_line",
    sql=f"""WITH l AS (SELECT req_id, regexp_split_to_array(trim({LINE_SQL}), '\\s+') AS p FROM requests)
    SELECT req_id, CASE WHEN len(p) = 3 THEN upper(p[1]) ELSE '' END AS method, CASE WHEN len(p) = 3 THEN p[2] ELSE '' END AS url,
    CAST(CASE WHEN len(p) = 3 AND regexp_matches(upper(p[3]), '{VERSION_RE}') THEN regexp_extract(upper(p[3]), '{VERSION_RE}', 1) ELSE '2' END AS INTEGER) AS major,
    CAST(CASE WHEN len(p) = 3 AND regexp_matches(upper(p[3]), '{VERSION_RE}') THEN regexp_extract(upper(p[3]), '{VERSION_RE}', 2) ELSE '0' END AS INTEGER) AS minor FROM l""",
)
def http_request_line(t):
    return t.requests.select("req_id", H.request_line(F.expr(LINE_SQL)).alias("p")).select("req_id", "p.*")


STATUS_SQL = """CASE WHEN req_id % 6 = 0 THEN 'HTTP/1.1 ' || CAST(status AS STRING) WHEN req_id % 6 = 1 THEN 'HTTP/1.0 299 Very Fine'
  WHEN req_id % 6 = 2 THEN 'HTTP/1.1 999 Odd' WHEN req_id % 6 = 3 THEN 'junk' WHEN req_id % 6 = 4 THEN 'http/1.1 ' || CAST(400 + req_id % 18 AS STRING) || ' some text'
  ELSE 'ICY 299' END"""


@query(
    "http_status_line",
    sql=f"""WITH l AS (SELECT req_id, {STATUS_SQL.replace('AS STRING', 'AS VARCHAR')} AS line FROM requests),
    p AS (SELECT req_id, CASE WHEN contains(line, ' ') THEN line ELSE 'HTTP/1.0 200 OK' END AS line FROM l),
    q AS (SELECT req_id, upper(string_split(line, ' ')[1]) AS v, string_split(line, ' ')[2] AS c,
       CASE WHEN len(string_split(line, ' ')) = 2 THEN 'Bummer' ELSE array_to_string(string_split(line, ' ')[3:], ' ') END AS r FROM p),
    s AS (SELECT req_id, v, r, CAST(CASE WHEN regexp_matches(c, '^[1-5][0-9][0-9]$') THEN c ELSE '200' END AS INTEGER) AS status FROM q)
    SELECT req_id, status, coalesce(reason, r) AS reason,
      CAST(CASE WHEN regexp_matches(v, '{VERSION_RE}') THEN regexp_extract(v, '{VERSION_RE}', 1) ELSE '2' END AS INTEGER) AS major,
      CAST(CASE WHEN regexp_matches(v, '{VERSION_RE}') THEN regexp_extract(v, '{VERSION_RE}', 2) ELSE '0' END AS INTEGER) AS minor
    FROM s LEFT JOIN {values(H.REASONS.items())} k(code, reason) ON code = status""",
)
def http_status_line(t):
    return t.requests.select("req_id", H.status_line(F.expr(STATUS_SQL)).alias("p")).select("req_id", "p.*")


VERSION_CASES = """CASE req_id % 6 WHEN 0 THEN 'HTTP/1.1' WHEN 1 THEN 'http/1.0' WHEN 2 THEN 'HTTP/10.20' WHEN 3 THEN 'HTTP/1' WHEN 4 THEN 'HTTP/a.b' ELSE '1.1' END"""


@query(
    "http_version",
    sql=f"""SELECT req_id, CASE WHEN regexp_matches(upper(v), '{VERSION_RE}') THEN CAST(regexp_extract(upper(v), '{VERSION_RE}', 1) AS INTEGER) ELSE 2 END AS major,
    CASE WHEN regexp_matches(upper(v), '{VERSION_RE}') THEN CAST(regexp_extract(upper(v), '{VERSION_RE}', 2) AS INTEGER) ELSE 0 END AS minor
    FROM (SELECT req_id, {VERSION_CASES} AS v FROM requests)""",
)
def http_version(t):
    return t.requests.select("req_id", H.http_version(F.expr(VERSION_CASES)).alias("v")).select("req_id", "v.*")


@query(
    "http_date_format",
    sql="""SELECT req_id, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS rfc1123, strftime(ts, '%A, %d-%b-%y %H:%M:%S GMT') AS rfc850,
    strftime(ts, '%a %b ') || lpad(day(ts)::VARCHAR, 2, ' ') || strftime(ts, ' %H:%M:%S %Y') AS asctime FROM requests""",
)
def http_date_format(t):
    ts = F.col("ts")
    return t.requests.select(
        "req_id", H.date_rfc1123(ts).alias("rfc1123"), H.date_rfc850(ts).alias("rfc850"), H.date_asctime(ts).alias("asctime")
    )


@query(
    "http_date_parse",
    sql="SELECT req_id, CAST(CASE WHEN req_id % 5 < 3 THEN epoch(date_trunc('second', ts)) END AS BIGINT) AS seconds FROM requests",
)
def http_date_parse(t):
    """Dates in all three layouts, and two kinds of broken ones."""
    ts, r = F.col("ts"), F.col("req_id") % 5
    text = (
        F.when(r == 0, H.date_rfc1123(ts)).when(r == 1, H.date_rfc850(ts)).when(r == 2, H.date_asctime(ts))
        .when(r == 3, F.concat(F.lit("Mon, 99 "), F.date_format(ts, "MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    )
    return t.requests.select("req_id", F.unix_seconds(H.http_date(text)).alias("seconds"))


@query(
    "http_warning_parse",
    sql=r"""SELECT req_id, pos, CASE WHEN pos <> 16 THEN CAST(string_split(value, ' ')[1] AS INTEGER) END AS code,
      CASE WHEN pos = 16 THEN NULL WHEN contains(value, '"') THEN string_split(value, ' ')[2] ELSE '' END AS agent,
      CASE WHEN pos = 16 THEN NULL WHEN contains(value, '"') THEN string_split(value, '"')[2] ELSE substr(value, 5) END AS text,
      CASE WHEN pos <> 16 AND contains(value, '"') THEN CAST(epoch(strptime(string_split(value, '"')[4], '%a, %d %b %Y %H:%M:%S GMT')) AS BIGINT) END AS date
      FROM headers WHERE lower(name) = 'warning'""",
)
def http_warning_parse(t):
    rows = t.headers.where(F.lower("name") == "warning").select("req_id", "pos", H.warning(F.col("value")).alias("w"))
    return rows.select("req_id", "pos", "w.code", "w.agent", "w.text", F.unix_seconds("w.date").alias("date"))


@query(
    "content_type_guess",
    sql=f"""SELECT u.url_id, coalesce(CASE WHEN page_id % 3 = 0 THEN 'text/x-declared' END, m.mime, 'application/octet-stream') AS mime
    FROM url_cases u LEFT JOIN {values(H.MIME_BY_EXTENSION.items())} m(ext, mime) ON m.ext = lower(regexp_extract({PATH}, '[.]([A-Za-z0-9]+)$', 1))""",
)
def content_type_guess(t):
    declared = F.when(F.col("page_id") % 3 == 0, F.lit("text/x-declared"))
    return t.url_cases.select("url_id", H.content_type(declared, F.col("url")).alias("mime"))


@query(
    "content_charset",
    sql="""SELECT req_id, CASE WHEN contains(value, 'charset') THEN 'utf-8' END AS charset FROM headers WHERE lower(name) = 'content-type'""",
)
def content_charset(t):
    return t.headers.where(F.lower("name") == "content-type").select("req_id", H.charset(F.col("value")).alias("charset"))


@query(
    "accept_encoding_map",
    sql="""SELECT req_id, lower(trim(string_split(e, ';')[1])) AS encoding, CASE WHEN contains(e, ';') THEN trim(string_split(e, ';')[2]) END AS preference,
    contains(lower(value), 'gzip') AS gzip FROM (SELECT req_id, value, unnest(string_split(value, ',')) AS e FROM headers WHERE lower(name) = 'accept-encoding')""",
)
def accept_encoding_map(t):
    rows = t.headers.where(F.lower("name") == "accept-encoding")
    return rows.select("req_id", H.takes_gzip(F.col("value")).alias("gzip"), F.inline(H.accept_encodings(F.col("value")))).select(
        "req_id", "encoding", "preference", "gzip"
    )


@query(
    "content_length_int",
    sql="""WITH m AS (SELECT req_id, max(CASE WHEN pos = 8 THEN value END) AS one, max(CASE WHEN pos = 9 THEN value END) AS two FROM headers GROUP BY req_id)
    SELECT req_id, try_cast(coalesce(two, one) AS BIGINT) AS length FROM m""",
)
def content_length_int(t):
    """Length of each message; of several headers the last one counts."""
    return t.messages.select("req_id", H.content_length(A.last_value(F.col("response"), "content-length")).alias("length"))


@query(
    "text_fix_chars",
    sql="""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN chr(147) || text || chr(148) || chr(146) || chr(132) || chr(145)
      ELSE '"' || text || '"' || '''' || '"' || '`' END AS text FROM documents""",
)
def text_fix_chars(t):
    raw = F.concat(F.lit("\x93"), "text", F.lit("\x94\x92\x84\x91"))
    charset = F.when(F.col("doc_id") % 4 == 0, F.lit("utf-8"))
    return t.documents.select("doc_id", X.fix_chars(raw, charset).alias("text"))


@query("text_resolve_entities", sql="""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(html, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&') AS text FROM pages""")
def text_resolve_entities(t):
    return t.pages.select("page_id", X.resolve_entities(F.col("html")).alias("text"))


@query("text_remove_markup", sql="SELECT page_id, regexp_replace(html, '(?s)<.*?>', '', 'g') AS text FROM pages")
def text_remove_markup(t):
    return t.pages.select("page_id", X.remove_markup(F.col("html")).alias("text"))


@query(
    "text_paragraphs",
    sql=r"""WITH p AS (SELECT doc_id, regexp_split_to_array(text || chr(10) || chr(10) || ' ' || chr(10) || source, '\r(?:\r\s*)+|\n(?:\n\s*)+|\r\n(?:\r\n\s*)+') AS p FROM documents)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, v AS paragraph FROM (SELECT doc_id, unnest(p) AS v, generate_subscripts(p, 1) AS i FROM p)""",
)
def text_paragraphs(t):
    text = F.concat("text", F.lit("\n\n \n"), "source")
    return t.documents.select("doc_id", F.posexplode(X.paragraphs(text)).alias("pos", "paragraph"))


@query("script_strip_comments", sql=r"""SELECT page_id, 0 AS pos, regexp_extract(html, '(?is)<script>(.*?)</script>', 1) || chr(10) || 'w(''</scr''+''ipt>'');' AS script FROM pages WHERE regexp_matches(html, '(?is)<script>.*?</script>')""")
def script_strip_comments(t):
    """Bodies of all script elements, each wrapped in comments first as old pages do."""
    bodies = F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1))
    scripts = t.pages.select("page_id", F.posexplode(bodies).alias("pos", "body"))
    wrapped = F.concat(F.lit("<!--\n// note\n\n"), "body", F.lit("\nw('</script>');\n//-->"))
    return scripts.select("page_id", "pos", X.strip_script_comments(wrapped).alias("script"))


SCRIPT_CASES = [("text/javascript", None), ("text/vbscript", None), (None, "JavaScript1.2"), (None, None), ("", "perl"), ("javascript/x", "JavaScript1.5")]
# script tags of the cases, set behind each page's own text
SCRIPT_TAGS = "".join("<script" + (f' type="{t}"' if t is not None else "") + (f' language="{n}"' if n is not None else "") + "></script>" for t, n in SCRIPT_CASES)


@query(
    "script_language",
    sql=f"""SELECT page_id, CAST(i AS INTEGER) AS pos, coalesce(t, '') = 'text/javascript' OR coalesce(t, '') LIKE 'javascript%' OR lower(coalesce(l, '')) LIKE 'javascript%'
      OR (coalesce(t, '') = '' AND coalesce(l, '') = '') AS is_javascript,
      CAST(coalesce(nullif(regexp_extract(lower(coalesce(l, '')), 'javascript([0-9][.][0-9])', 1), ''), '0.0') AS DOUBLE) AS version
      FROM (SELECT page_id, i - 1 AS i, regexp_extract(a, 'type="([^"]*)"', 1) AS t, regexp_extract(a, 'language="([^"]*)"', 1) AS l FROM
        (SELECT page_id, unnest(x) AS a, unnest(range(1, len(x) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html || '{SCRIPT_TAGS}', '(?i)<script\\b([^>]*)>', 1) AS x FROM pages)))""",
)
def script_language(t):
    """Each page's own script tags and every spelling of the attributes."""
    tags = F.regexp_extract_all(F.concat("html", F.lit(SCRIPT_TAGS)), F.lit(r"(?i)<script\b([^>]*)>"), F.lit(1))
    rows = t.pages.select("page_id", F.posexplode(tags).alias("pos", "a"))
    value = lambda name: F.regexp_extract("a", f'{name}="([^"]*)"', 1)
    return rows.select("page_id", "pos", X.script_language(value("type"), value("language")).alias("s")).select("page_id", "pos", "s.*")


# Address spellings made from the client address; {a} .. {d} are its octets.
IP_SQL = """CASE req_id % 8 WHEN 0 THEN '::' || client_ip WHEN 1 THEN client_ip || '9' WHEN 2 THEN 'fe80::' || CAST(user_id AS STRING) || ':1'
  WHEN 3 THEN '1:2:3:4:5:6:7:' || CAST(user_id % 9999 AS STRING) WHEN 4 THEN 'host' || CAST(user_id AS STRING) WHEN 5 THEN '10.300.1.1' WHEN 6 THEN '::1' ELSE client_ip END"""


def _quad_ok(x):
    return rf"(regexp_matches({x}, '^[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}$') AND list_bool_and([o::INTEGER <= 255 for o in string_split({x}, '.')]))"


IP_CTE = f"ips AS (SELECT req_id, client_ip, {IP_SQL.replace('AS STRING', 'AS VARCHAR')} AS ip FROM requests)"
# The octet test only runs on what looks like a dotted quad.
V4_SQL = r"(regexp_matches(ip, '^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|0{0,1}[0-9]{1,2}|00[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|0{0,1}[0-9]{1,2}|00[0-9])){3}$'))"
V6_SQL = "(" + " OR ".join(f"regexp_matches(ip, '{form}')" for form in N.IPV6_FORMS) + ")"


@query("ip_is_valid", sql=f"WITH {IP_CTE} SELECT req_id, ip, {V4_SQL} OR {V6_SQL} AS valid FROM ips")
def ip_is_valid(t):
    return t.requests.select("req_id", F.expr(IP_SQL).alias("ip")).select("req_id", "ip", N.is_valid_ip(F.col("ip")).alias("valid"))


OCTETS = "string_split(client_ip, '.')"
LONG_SQL = f"({OCTETS}[1]::BIGINT * 16777216 + {OCTETS}[2]::BIGINT * 65536 + {OCTETS}[3]::BIGINT * 256 + {OCTETS}[4]::BIGINT)"


@query("ip_to_long", sql=f"SELECT req_id, {LONG_SQL} AS number FROM requests")
def ip_to_long(t):
    return t.requests.select("req_id", N.ip_to_long(F.col("client_ip")).alias("number"))


@query(
    "long_to_ip",
    sql="""SELECT req_id, ((n >> 24) & 255)::VARCHAR || '.' || ((n >> 16) & 255)::VARCHAR || '.' || ((n >> 8) & 255)::VARCHAR || '.' || (n & 255)::VARCHAR AS ip
    FROM (SELECT req_id, (req_id * 2654435 + user_id) % 4294967296 AS n FROM requests)""",
)
def long_to_ip(t):
    return t.requests.select("req_id", N.long_to_ip((F.col("req_id") * 2654435 + F.col("user_id")) % 4294967296).alias("ip"))


@query(
    "ip_net_range",
    sql=f"""SELECT req_id, n // size * size AS lo, n // size * size + size - 1 AS hi
    FROM (SELECT req_id, {LONG_SQL} AS n, CASE WHEN req_id % 3 = 0 THEN 256 ELSE (1::BIGINT << (32 - (req_id % 33))::INTEGER) END AS size FROM requests)""",
)
def ip_net_range(t):
    mask = F.when(F.col("req_id") % 3 == 0, F.lit("255.255.255.0")).otherwise((F.col("req_id") % 33).cast("string"))
    return t.requests.select("req_id", N.net_range(F.concat("client_ip", F.lit("/"), mask)).alias("r")).select("req_id", "r.*")


@query(
    "ip6_expand",
    sql=f"""WITH {IP_CTE} SELECT req_id, CASE WHEN ip LIKE 'fe80::%' THEN 'fe80:0:0:0:0:0:' || ip[7:] WHEN ip = '::1' THEN '0:0:0:0:0:0:0:1'
      WHEN ip LIKE '::%' THEN '0:0:0:0:0:0:' || ip[3:] ELSE ip END AS expanded FROM ips WHERE {V6_SQL}""",
)
def ip6_expand(t):
    rows = t.requests.select("req_id", F.expr(IP_SQL).alias("ip")).where(N.is_ipv6(F.col("ip")))
    return rows.select("req_id", N.expand_ipv6(F.col("ip")).alias("expanded"))


@query(
    "dns_reverse_name",
    sql=f"SELECT req_id, array_to_string(list_reverse({OCTETS}), '.') || '.in-addr.arpa.' AS name FROM requests",
)
def dns_reverse_name(t):
    return t.requests.select("req_id", N.reverse_name(F.col("client_ip")).alias("name"))


@query("dns_reverse_addr", sql="SELECT req_id, client_ip AS ip FROM requests")
def dns_reverse_addr(t):
    return t.requests.select("req_id", N.reverse_addr(N.reverse_name(F.col("client_ip"))).alias("ip"))


TTL_SQL = """CASE req_id % 7 WHEN 0 THEN CAST(bytes AS STRING) WHEN 1 THEN CAST(bytes AS STRING) || 's' WHEN 2 THEN '1w6d4h3m10s'
  WHEN 3 THEN '2h' || CAST(bytes AS STRING) WHEN 4 THEN 'h1' WHEN 5 THEN CAST(req_id AS STRING) || 'W' ELSE CAST(req_id AS STRING) || 'd' || CAST(bytes AS STRING) || 'M' END"""


@query(
    "dns_ttl_seconds",
    sql="""SELECT req_id, CASE WHEN s BETWEEN 0 AND 2147483647 THEN s END AS seconds FROM (SELECT req_id, CASE req_id % 7 WHEN 0 THEN bytes WHEN 1 THEN bytes
      WHEN 2 THEN 604800 + 6 * 86400 + 4 * 3600 + 190 WHEN 5 THEN req_id * 604800 WHEN 6 THEN req_id * 86400 + bytes * 60 END AS s FROM requests)""",
)
def dns_ttl_seconds(t):
    return t.requests.select("req_id", N.ttl_seconds(F.expr(TTL_SQL)).alias("seconds"))


@query(
    "status_has_body",
    sql="SELECT req_id, status FROM requests WHERE status NOT IN (204, 304, 100) AND method <> 'HEAD'",
)
def status_has_body(t):
    return t.requests.where(~F.col("status").isin(204, 304, 100) & (F.col("method") != "HEAD")).select("req_id", "status")


MIME_VARIANT = "CASE WHEN req_id % 4 = 0 THEN upper(mime) || ';charset=x' WHEN req_id % 11 = 0 THEN NULL WHEN req_id % 7 = 0 THEN mime || 'x' ELSE mime END"


def _handler_sql(mimes) -> str:
    return "(" + " OR ".join(f"coalesce(regexp_full_match(m, '(?i){p}(;.+)?'), false)" for p in mimes) + ")" if mimes else "true"


@query(
    "mime_gate",
    sql=" UNION ALL ".join(
        f"SELECT req_id, '{h.name}' AS handler FROM (SELECT req_id, {MIME_VARIANT} AS m FROM requests) WHERE {_handler_sql(h.mimes)}"
        for h in P.HANDLERS
    ),
)
def mime_gate(t):
    """Handlers that take the MIME type of each request."""
    rows = t.requests.select("req_id", F.expr(MIME_VARIANT).alias("mime"))
    taken = [F.when(handler_takes_mime(F.col("mime"), h.mimes), F.lit(h.name)) for h in P.HANDLERS]
    return rows.select("req_id", F.explode(F.array_compact(F.array(*taken))).alias("handler"))


@query(
    "rewrite_needed",
    sql=f"""SELECT req_id FROM (SELECT req_id, {MIME_VARIANT} AS m FROM requests)
    WHERE {' OR '.join(_handler_sql(h.mimes) for h in P.HANDLERS if h.rewrites)}""",
)
def rewrite_needed(t):
    mime = F.expr(MIME_VARIANT)
    needed = F.lit(False)
    for handler in P.HANDLERS:
        if handler.rewrites:
            needed = needed | handler_takes_mime(mime, handler.mimes)
    return t.requests.where(needed).select("req_id")


@query(
    "script_url_allowed",
    sql="""SELECT req_id FROM (SELECT r.req_id, r.url, CASE r.req_id % 4 WHEN 0 THEN 'ftp://x/y.js' WHEN 1 THEN 'http://localhost/a.js' WHEN 2 THEN '/rel.js' ELSE r.url END AS target FROM requests r)
    WHERE regexp_matches(target, '^https?://') AND NOT regexp_matches(target, '^https?://(localhost|127[.]0[.]0[.]1)(:|/|$)')""",
)
def script_url_allowed(t):
    target = F.expr("CASE req_id % 4 WHEN 0 THEN 'ftp://x/y.js' WHEN 1 THEN 'http://localhost/a.js' WHEN 2 THEN '/rel.js' ELSE url END")
    local = ["localhost", "127.0.0.1"]
    rows = t.requests.select("req_id", U.host(F.col("url")).alias("source"), U.url_split(target).alias("t"))
    scheme_ok = F.col("t.scheme").isin("", "http", "https")
    to_local = ~F.col("source").isin(local) & F.col("t.host").isin(local)
    return rows.where(scheme_ok & (F.col("t.host") != "") & ~to_local).select("req_id")
