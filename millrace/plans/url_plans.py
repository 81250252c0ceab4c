"""URL queries over pages, requests and URL spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.plans.registry import query

SCHEME = "lower(regexp_extract(url, '^([^/:]+):', 1))"
NETLOC = "regexp_extract(url, '^(?:[^/:?#]+:)?//([^/?#]*)', 1)"
DOCUMENT = "regexp_extract(url, '(?s)^(?:[^/:?#]+:)?(?://[^/?#]*)?(.*)$', 1)"
PATH = "regexp_extract(url, '(?s)^(?:[^/:?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
FRAGMENT = "regexp_extract(url, '(?s)^[^#]*#(.*)$', 1)"
PORT_OF = "CASE {0} WHEN 'http' THEN 80 WHEN 'https' THEN 443 WHEN 'nntps' THEN 563 ELSE {1} END"


def port_sql(host: str, default: str) -> str:
    number = f"try_cast(regexp_extract({host}, '^[^:]*:([0-9]+)$', 1) AS BIGINT)"
    return f"CAST(CASE WHEN {number} BETWEEN 1 AND 65535 THEN {number} ELSE {default} END AS INTEGER)"


HOST = f"regexp_extract(lower({NETLOC}), '^([^:]*)', 1)"
SPLIT_SQL = f"""
SELECT url_id, {SCHEME} AS scheme, {HOST} AS host,
       {port_sql(NETLOC, PORT_OF.format(SCHEME, 80))} AS port, {DOCUMENT} AS document FROM url_cases
"""


@query("scan_pages", sql="SELECT page_id, url, html FROM pages")
def scan_pages(t):
    return t.pages.select("page_id", "url", "html")


@query("url_split", sql=SPLIT_SQL)
def url_split(t):
    return t.url_cases.select("url_id", U.url_split(F.col("url")).alias("p")).select("url_id", "p.*")


@query(
    "url_unsplit",
    sql=f"""WITH s AS ({SPLIT_SQL}) SELECT url_id, scheme || '://' || host ||
    CASE WHEN port IS NOT DISTINCT FROM {PORT_OF.format('scheme', 'NULL')} THEN '' ELSE ':' || port::VARCHAR END || document AS url FROM s""",
)
def url_unsplit(t):
    return t.url_cases.select("url_id", U.url_unsplit(U.url_split(F.col("url"))).alias("url"))


@query(
    "split_port",
    sql=f"""SELECT url_id, regexp_extract({NETLOC}, '^([^:]*)', 1) AS host, {port_sql(NETLOC, '80')} AS port FROM url_cases""",
)
def split_port(t):
    return t.url_cases.select("url_id", U.split_port(U.netloc(F.col("url")), F.lit(80)).alias("p")).select("url_id", "p.*")


def sql_unquote(x: str) -> str:
    stray = rf"regexp_replace({x}, '%([89A-Fa-f][0-9A-Fa-f])', chr(57345) || '\1', 'g')"
    stray = rf"replace(regexp_replace({stray}, '%([0-9A-Fa-f][0-9A-Fa-f])', chr(57346) || '\1', 'g'), '%', '%25')"
    return f"url_decode(replace(replace({stray}, chr(57346), '%'), '+', '%2B'))"


def sql_quote(x: str, safe: str) -> str:
    out = f"replace(url_encode({x}), '~', '%7E')"
    for c in safe:
        if c not in "-_.":
            lit = "''" if c == "'" else c
            out = f"replace({out}, '%{ord(c):02X}', '{lit}')"
    parts = f"string_split({out}, '%EE%80%81')"
    return (
        f"array_to_string(list_transform({parts}, lambda x, i: CASE WHEN i = 1 THEN x "
        f"ELSE '%' || upper(x[1:2]) || x[3:] END), '')"
    )


def sql_collapse(x: str) -> str:
    p = f"regexp_replace(replace({x}, chr(92), '/'), '/+', '/', 'g')"
    p = rf"regexp_replace(regexp_replace({p}, '^\./', ''), '/\./|/\.$', '/', 'g')"
    segs = f"list_filter(string_split({p}, '/'), lambda s, i: NOT (i = 1 AND s = ''))"
    n = f"len({segs})"
    # the path so far is kept as text; '..' cuts its last segment
    fold = (
        f"list_reduce(list_transform({segs}, lambda s, i: CASE WHEN i = {n} THEN '$' || s ELSE s END), lambda acc, s: "
        r"CASE WHEN s IN ('..', '$..') AND acc <> '' AND NOT regexp_matches(acc, '(^|/)\.\.$') "
        r"THEN regexp_replace(acc, '/[^/]*$', '') || CASE WHEN s = '$..' THEN '/' ELSE '' END "
        f"WHEN s = '..' AND starts_with({p}, '/') THEN acc "
        r"ELSE acc || '/' || ltrim(s, '$') END, '')"
    )
    return (
        f"CASE WHEN NOT contains({p}, '..') THEN {p} WHEN starts_with({p}, '/') THEN {fold} ELSE substr({fold}, 2) END"
    )


NORM_SQL = rf"""
WITH a AS (
  SELECT url_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
         regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS rest FROM url_cases),
b AS (SELECT *, lower({sql_unquote("regexp_extract(rest, '^//([^/?#]*)', 1)")}) AS h0,
         regexp_extract(rest, '(?s)^(?://[^/?#]*)?([^?#]*)', 1) AS p0,
         {QUERY.replace('url', 'rest')} AS q0, {sql_unquote(FRAGMENT.replace('url', 'rest'))} AS f FROM a),
c AS (SELECT *, CASE WHEN contains(h0, chr(92)) THEN substr(h0, instr(h0, chr(92))) ELSE '' END AS tail,
         string_split(h0, chr(92))[1] AS h1 FROM b),
d AS (SELECT *, CASE WHEN tail <> '' THEN tail || CASE WHEN p0 = '/' THEN '' ELSE {sql_unquote('p0')} END ELSE {sql_unquote('p0')} END AS p1,
         regexp_extract(h1, '^(.*@)', 1) AS usr, regexp_replace(h1, '^.*@', '') AS h2 FROM c),
e AS (SELECT *, {PORT_OF.format('scheme', 'NULL')} AS dport,
         regexp_replace(regexp_extract(h2, '^([^:]*)', 1), '\.$', '') AS h3, {port_sql('h2', 'NULL')} AS port FROM d),
pieces AS (SELECT url_id, unnest(string_split(q0, '?')) AS piece, generate_subscripts(string_split(q0, '?'), 1) AS pi FROM e WHERE q0 <> ''),
pairs AS (SELECT url_id, pi, unnest(regexp_split_to_array(piece, '[&;]')) AS part, regexp_extract_all(piece, '[&;]') AS seps,
          generate_subscripts(regexp_split_to_array(piece, '[&;]'), 1) AS i FROM pieces),
kv AS (SELECT *, replace(string_split(part, '=')[1], '+', ' ') AS k,
          CASE WHEN contains(part, '=') THEN replace(substr(part, instr(part, '=') + 1), '+', ' ') END AS v FROM pairs),
texts AS (SELECT url_id, pi, i, {sql_quote(sql_unquote('k'), '/-:,;')} ||
          CASE WHEN v IS NULL THEN '' ELSE '=' || {sql_quote(sql_unquote('v'), '-:,;')} END || coalesce(seps[i], '') AS s FROM kv),
joined AS (SELECT url_id, pi, string_agg(s, '' ORDER BY i) AS s FROM texts GROUP BY ALL),
q AS (SELECT url_id, string_agg(s, '?' ORDER BY pi) AS q FROM joined GROUP BY url_id),
g AS (SELECT e.*, coalesce(q.q, '') AS q FROM e LEFT JOIN q USING (url_id)),
h AS (SELECT url_id, url, scheme, q, {sql_quote('f', '/')} AS fo,
        {sql_quote("CASE WHEN h1 = '' THEN '' WHEN dport IS NOT NULL THEN usr || h3 || CASE WHEN port IS NULL OR port = dport THEN '' ELSE ':' || port::VARCHAR END ELSE h1 END", '@:')} AS ho,
        {sql_quote("CASE WHEN p1 <> '' THEN " + sql_collapse('p1') + " WHEN scheme <> '' AND (q <> '' OR f <> '') THEN '/' ELSE '' END", U.PATH_SAFE)} AS po FROM g)
SELECT url_id, CASE WHEN scheme = '' THEN '' ELSE scheme || ':' END || CASE WHEN ho = '' THEN '' ELSE '//' || ho END ||
  CASE WHEN ho <> '' AND po <> '' AND po[1] <> '/' THEN '/' ELSE '' END || po || CASE WHEN q = '' THEN '' ELSE '?' || q END ||
  CASE WHEN fo <> '' THEN '#' || fo WHEN url LIKE '%#' THEN '#' ELSE '' END AS norm FROM h
"""


@query("url_norm", sql=NORM_SQL)
def url_norm(t):
    return t.url_cases.select("url_id", U.url_norm(F.col("url")).alias("norm"))


@query("collapse_segments", sql=f"SELECT url_id, {sql_collapse(PATH)} AS path FROM url_cases")
def collapse_segments(t):
    return t.url_cases.select("url_id", U.collapse_segments(U.path(F.col("url"))).alias("path"))


@query(
    "url_fix_typos",
    sql="""SELECT url_id, CASE WHEN starts_with(url, 'http//') THEN 'http://' || url[7:]
    WHEN starts_with(url, 'https//') THEN 'https://' || url[8:] ELSE url END AS url FROM url_cases""",
)
def url_fix_typos(t):
    return t.url_cases.select("url_id", U.fix_typos(F.col("url")).alias("url"))


QUOTE_SQL = rf"""
WITH a AS (SELECT url_id, url, regexp_extract(url, '^([A-Za-z]+):', 1) AS s, {sql_quote(QUERY, '&=,')} AS q FROM url_cases),
b AS (SELECT url_id, unnest(string_split(q, '&')) AS part, generate_subscripts(string_split(q, '&'), 1) AS i, len(string_split(q, '&')) AS n FROM a WHERE q <> ''),
c AS (SELECT *, url_decode(string_split(part, '=')[1]) AS k, CASE WHEN contains(part, '=') THEN url_decode(substr(part, instr(part, '=') + 1)) ELSE '' END AS v FROM b),
d AS (SELECT url_id, string_agg({sql_quote('k', '/-:,')} || CASE WHEN v = '' THEN '' ELSE '=' || {sql_quote('v', '/-:,')} END || CASE WHEN i < n THEN '&' ELSE '' END, '' ORDER BY i) AS q FROM c GROUP BY url_id),
e AS (SELECT a.url_id, a.url, a.s, coalesce(d.q, '') AS q, {sql_quote(FRAGMENT, '/')} AS f FROM a LEFT JOIN d USING (url_id))
SELECT url_id, CASE WHEN s <> '' THEN lower(s) || ':' || CASE WHEN {NETLOC} <> '' THEN '//' || {sql_quote(NETLOC, ':')} ELSE '' END || {sql_quote(PATH, '/=,')}
    || CASE WHEN q <> '' THEN '?' || q ELSE '' END || CASE WHEN f <> '' THEN '#' || f ELSE '' END
  WHEN NOT contains(url, '?') THEN {sql_quote('url', '/=,')}
  ELSE {sql_quote(r"regexp_extract(url, '^(.*)[?][^?]*$', 1)", '/=,')} || CASE WHEN regexp_matches(url, '[?]$') THEN '' ELSE '?' || regexp_extract(url, '[?]([^?]*)$', 1) END END AS quoted FROM e"""


@query("url_quote", sql=QUOTE_SQL)
def url_quote(t):
    return t.url_cases.select("url_id", U.url_quote(F.col("url")).alias("quoted"))


@query(
    "url_query_parse",
    sql=f"""
WITH a AS (SELECT url_id, {QUERY} AS q FROM url_cases),
b AS (SELECT url_id, unnest(regexp_split_to_array(q, '[&;]')) AS part, regexp_extract_all(q, '[&;]') AS seps,
      generate_subscripts(regexp_split_to_array(q, '[&;]'), 1) AS i FROM a WHERE q <> '')
SELECT url_id, CAST(i - 1 AS INTEGER) AS pos, url_decode(replace(string_split(part, '=')[1], '+', ' ')) AS key,
  CASE WHEN contains(part, '=') THEN url_decode(replace(substr(part, instr(part, '=') + 1), '+', ' ')) END AS value,
  coalesce(seps[i], '') AS sep FROM b""",
)
def url_query_parse(t):
    q = U.query_string(F.col("url"))
    rows = t.url_cases.select("url_id", q.alias("q")).where(F.col("q") != "")
    return rows.select("url_id", F.posexplode(U.parse_query(F.col("q"), keep_blank=True)).alias("pos", "p")).select(
        "url_id", "pos", "p.*"
    )


@query(
    "url_query_join",
    sql=NORM_SQL[: NORM_SQL.rindex("h AS (SELECT url_id")].rstrip().rstrip(",")
    + " SELECT url_id, q AS query FROM g",
)
def url_query_join(t):
    return t.url_cases.select("url_id", U.join_query(U.query_string(F.col("url"))).alias("query"))


@query(
    "url_split_params",
    sql=f"""
WITH a AS (SELECT url_id, {PATH} AS p, list_last(string_split({PATH}, '/')) AS l FROM url_cases)
SELECT url_id, CASE WHEN contains(l, ';') THEN p[:len(p) - len(l) + instr(l, ';') - 1] ELSE p END AS path,
  CASE WHEN contains(l, ';') THEN substr(l, instr(l, ';') + 1) ELSE '' END AS params FROM a""",
)
def url_split_params(t):
    return t.url_cases.select("url_id", U.split_params(U.path(F.col("url"))).alias("p")).select("url_id", "p.*")


@query("url_strip_site", sql=f"SELECT url_id, {NETLOC} AS site, {DOCUMENT} AS rest FROM url_cases")
def url_strip_site(t):
    return t.url_cases.select("url_id", U.strip_site(F.col("url")).alias("p")).select("url_id", "p.*")


def _safe_sql() -> str:
    sources = {"url": "url", "host": NETLOC, "path": PATH, "query": QUERY, "fragment": FRAGMENT}
    tests = [
        "regexp_matches({}, '{}') AS {}_safe".format(text, U.SAFE_PATTERNS[part].replace("'", "''"), part)
        for part, text in sources.items()
    ]
    return f"SELECT url_id, {', '.join(tests)} FROM url_cases"


@query("url_is_safe", sql=_safe_sql())
def url_is_safe(t):
    url = F.col("url")
    parts = {"url": url, "host": U.netloc(url), "path": U.path(url), "query": U.query_string(url), "fragment": U.fragment(url)}
    return t.url_cases.select("url_id", *[U.is_safe(text, part).alias(f"{part}_safe") for part, text in parts.items()])


@query(
    "url_needs_quoting",
    sql=r"""SELECT url_id, rtrim(url) <> url OR NOT regexp_full_match(url, '[a-zA-Z0-9;/=,~*+()@!_:.&#%?\[\]-]*') AS needs FROM url_cases""",
)
def url_needs_quoting(t):
    return t.url_cases.select("url_id", U.needs_quoting(F.col("url")).alias("needs"))


MEDIA_SQL = r"""CASE WHEN starts_with(mime, 'image/') OR regexp_matches(url, '(?i)\.(gif|jpe?g|ico|png|bmp|pcx|tga|tiff?)$') THEN 'image'
  WHEN starts_with(mime, 'application/x-shockwave-flash') OR regexp_matches(url, '(?i)\.(swf|flash)$') THEN 'flash'
  WHEN starts_with(mime, 'application/x-javascript') OR starts_with(mime, 'text/javascript') OR regexp_matches(url, '(?i)\.js$') THEN 'javascript'
  ELSE 'html' END"""


@query("url_media_class", sql=f"SELECT req_id, {MEDIA_SQL} AS media FROM requests")
def url_media_class(t):
    return t.requests.select("req_id", U.media_class(F.col("url"), F.col("mime")).alias("media"))


CACHE_SQL = rf"{NETLOC} || CASE WHEN regexp_matches({PATH}, '(\.html|/)$') THEN {PATH} ELSE '/' END"


@query("url_cache_key", sql=f"SELECT url_id, {CACHE_SQL} AS key FROM url_cases")
def url_cache_key(t):
    return t.url_cases.select("url_id", U.cache_key(F.col("url")).alias("key"))


# Lookup service and the statuses of failed fetches that are looked up.
CACHE_SERVICE = "http://www.google.com"
CACHE_STATUSES = [410, 503, 504]


@query(
    "url_cache_links",
    sql=f"""SELECT req_id, {NETLOC} AS site, {PATH} AS path,
  'http://www.google.com/search?q=cache:' || replace(replace(url_encode('http://' || {NETLOC} || '/'), '~', '%7E'), '%20', '+') AS cache_site,
  'http://www.google.com/search?q=cache:' || replace(replace(url_encode('http://' || {NETLOC} || {PATH}), '~', '%7E'), '%20', '+') AS cache_path
  FROM requests WHERE status IN (410, 503, 504)""",
)
def url_cache_links(t):
    url = F.col("url")
    site, path = U.netloc(url), U.path(url)

    def link(*parts):
        return F.concat(F.lit(CACHE_SERVICE + "/search?q=cache:"), U.quote_plus(F.concat(F.lit("http://"), *parts)))

    return t.requests.where(F.col("status").isin(CACHE_STATUSES)).select(
        "req_id", site.alias("site"), path.alias("path"),
        link(site, F.lit("/")).alias("cache_site"), link(site, path).alias("cache_path"),
    )


SEGMENTS = f"list_filter(string_split({PATH}, '/'), lambda s: s <> '')"
RATING_SAFE_SQL = rf"""CASE WHEN {NETLOC} = '' OR NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN ''
  ELSE lower(regexp_extract(url, '^([^:]*)://', 1)) || '://' || {NETLOC} || '/' ||
  array_to_string(list_transform({SEGMENTS}, lambda s: regexp_replace(s, '(?i)[^a-z0-9_.!~*''(),+-]', '', 'g')), '/') END"""


@query("url_rating_safe", sql=f"SELECT url_id, {RATING_SAFE_SQL} AS safe FROM url_cases")
def url_rating_safe(t):
    return t.url_cases.select("url_id", U.rating_safe(F.col("url")).alias("safe"))


PREFIX_SQL = rf"""
SELECT url_id, CAST(row_number() OVER (PARTITION BY url_id ORDER BY k DESC) - 1 AS INTEGER) AS pos,
  base || CASE WHEN k >= 2 THEN '/' || array_to_string(segs[:k // 2], '/') ELSE '' END || CASE WHEN k % 2 = 1 THEN '/' ELSE '' END AS prefix
FROM (SELECT url_id, lower(regexp_extract(url, '^([^:]*)://', 1)) || '://' || {NETLOC} AS base, {SEGMENTS} AS segs,
      unnest(range(0, 1 + CASE WHEN len({SEGMENTS}) = 0 THEN 1 ELSE 2 * len({SEGMENTS}) END)) AS k
      FROM url_cases WHERE {NETLOC} <> '' AND regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://'))"""


@query("url_prefixes", sql=PREFIX_SQL)
def url_prefixes(t):
    return t.url_cases.select("url_id", F.posexplode(U.rating_prefixes(F.col("url"))).alias("pos", "prefix"))


@query(
    "url_overflow_flags",
    sql=r"""SELECT url_id, contains(url, '%%%%%%%%%%%') AS percents,
  contains(url, ':') AND lower(string_split(url, ':')[1]) <> 'javascript'
   AND contains(string_split(ltrim(substr(url, instr(url, ':') + 1), '/'), '/')[1], '---') AS dashes FROM url_cases""",
)
def url_overflow_flags(t):
    url = F.col("url")
    return t.url_cases.select("url_id", U.many_percents(url).alias("percents"), U.dashes_in_host(url).alias("dashes"))


@query(
    "url_length_class",
    sql="""SELECT doc_id, CASE WHEN n > 8192 THEN 'reject' WHEN n > 1024 THEN 'warn' ELSE 'ok' END AS class
  FROM (SELECT doc_id, len('http://' || source || '/?q=' || text) AS n FROM documents)""",
)
def url_length_class(t):
    url = F.concat(F.lit("http://"), "source", F.lit("/?q="), "text")
    return t.documents.select("doc_id", U.length_class(url).alias("class"))


@query(
    "url_redirect_target",
    sql="""SELECT url_id, CASE WHEN w <> '' THEN url_decode(w) ELSE url END AS target
  FROM (SELECT url_id, url, regexp_extract(url, '[?&;](?:location|url)=(https?(?::|%3[aA])[^&;#]*)', 1) AS w FROM url_cases)""",
)
def url_redirect_target(t):
    return t.url_cases.select("url_id", U.redirect_target(F.col("url")).alias("target"))


# Link forms resolved against every page URL.
LINKS = ["http://other.example/x", "//cdn.example/y.js", "/root/../r.html", "sub/./page.html?q=1", "../up", "?only=q", "#frag", ""]


def _resolve_sql() -> str:
    values = ", ".join(f"'{x}'" for x in LINKS)
    lp = "string_split(string_split(link, '#')[1], '?')[1]"
    tail = f"link[len({lp}) + 1:]"
    folder = f"coalesce(nullif(regexp_extract({PATH}, '^(.*/)', 1), ''), '/')"
    root = f"regexp_extract(url, '^[A-Za-z]+://[^/?#]*')"
    return f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN regexp_matches(link, '^[a-z]+:') THEN link
      WHEN starts_with(link, '//') THEN {SCHEME} || ':' || link WHEN link = '' THEN url
      WHEN link[1] = '/' THEN {root} || {sql_collapse(lp)} || {tail}
      WHEN link[1] = '?' THEN {root} || {PATH} || link WHEN link[1] = '#' THEN string_split(url, '#')[1] || link
      ELSE {root} || {sql_collapse(f'{folder} || {lp}')} || {tail} END AS target
      FROM (SELECT page_id, url, unnest([{values}]) AS link, unnest(range(1, {len(LINKS) + 1})) AS i FROM pages)"""


@query("url_rel_resolve", sql=_resolve_sql())
def url_rel_resolve(t):
    links = t.pages.select("page_id", "url", F.posexplode(F.array(*map(F.lit, LINKS))).alias("pos", "link"))
    return links.select("page_id", "pos", U.resolve(F.col("url"), F.col("link")).alias("target"))
