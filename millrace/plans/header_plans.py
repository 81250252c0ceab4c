"""Header queries over messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import policy as P
from millrace.functions.rules import handler_takes_mime
from millrace.operators import headers as A
from millrace.plans.http_plans import _handler_sql
from millrace.plans.loaded import rule_set
from millrace.plans.registry import query


def rows(messages, *columns):
    return messages.select("req_id", F.inline(columns[0] if len(columns) == 1 else F.concat(*columns)))


@query("header_first", sql="""SELECT req_id, pos, stage, name, value FROM headers
  QUALIFY lower(name) NOT IN ('content-length', 'age', 'date', 'host') OR row_number() OVER (PARTITION BY req_id, stage, lower(name) ORDER BY pos) = 1""")
def header_first(t):
    return rows(t.messages, A.first_of_single(F.col("request")), A.first_of_single(F.col("response")))


@query("header_multiplicity", sql="""SELECT req_id, stage, lower(name) AS name, count(*) AS n FROM headers
  WHERE lower(name) IN ('content-length', 'age', 'date', 'host') GROUP BY ALL HAVING count(*) > 1""")
def header_multiplicity(t):
    def stage(name):
        return F.transform(
            A.multiplicity(F.col(name)), lambda c: F.struct(F.lit(name).alias("stage"), c["name"].alias("name"), c["n"].alias("n"))
        )

    return rows(t.messages, stage("request"), stage("response"))


@query("headers_hop_by_hop", sql="""WITH h AS (SELECT *, string_agg(lower(value), ',') FILTER (stage = 'request' AND lower(name) IN ('connection', 'proxy-connection'))
    OVER (PARTITION BY req_id) AS listed FROM headers)
  SELECT * EXCLUDE (listed) FROM h
  WHERE NOT (stage = 'request' AND (lower(name) IN ('proxy-connection', 'connection', 'keep-alive', 'upgrade', 'trailer', 'te')
      OR coalesce(list_contains(list_transform(string_split(listed, ','), lambda x: trim(x)), lower(name)), false)))
    AND NOT (stage = 'response' AND lower(name) IN ('connection', 'proxy-authenticate', 'keep-alive', 'upgrade', 'trailer'))""")
def headers_hop_by_hop(t):
    return rows(t.messages, A.drop_hop_by_hop(F.col("request"), "request"), A.drop_hop_by_hop(F.col("response"), "response"))


@query("headers_warning_dates", sql="""WITH h AS (SELECT *, max(value) FILTER (name = 'Date') OVER (PARTITION BY req_id) AS date FROM headers)
  SELECT * EXCLUDE (date) FROM h WHERE stage = 'response' AND (name <> 'Warning' OR
    (regexp_matches(value, '^[0-9]+ ') AND (NOT contains(value, '"') OR coalesce(string_split(value, '"')[4] = date, false))))""")
def headers_warning_dates(t):
    return rows(t.messages, A.drop_dated_warnings(F.col("response")))


@query("headers_trailer", sql="""SELECT * FROM headers WHERE stage = 'response'
  AND NOT (name = 'Trailer' AND lower(value) IN ('transfer-encoding', 'content-length', 'trailer'))""")
def headers_trailer(t):
    return rows(t.messages, A.drop_forbidden_trailers(F.col("response")))


def rewriting(mime):
    needed = F.lit(False)
    for handler in P.HANDLERS:
        if handler.rewrites:
            needed = needed | handler_takes_mime(mime, handler.mimes)
    return needed


REWRITING_SQL = " OR ".join(_handler_sql(h.mimes) for h in P.HANDLERS if h.rewrites)


@query("headers_encoding", sql=f"""
WITH f AS (SELECT *, bool_or(name = 'Transfer-Encoding') OVER w AS te, bool_or(name = 'Content-Encoding') OVER w AS ce, bool_or(name = 'Content-Length') OVER w AS cl,
    bool_or(name = 'Cache-Control' AND value = 'No-Transform') OVER w AS nt, max(CASE WHEN name = 'Content-Type' THEN value END) OVER w AS m, min(pos) OVER w AS least
    FROM headers WHERE stage = 'response' WINDOW w AS (PARTITION BY req_id)),
g AS (SELECT *, cl AND NOT te AND NOT ({REWRITING_SQL}) AS keeps_length FROM f),
made AS (SELECT req_id, unnest(list_filter([
    CASE WHEN name NOT IN ('Transfer-Encoding', 'Content-Encoding') AND (name <> 'Content-Length' OR (keeps_length AND NOT ce)) AND NOT (ce AND nt AND name = 'Cache-Control')
      AND NOT (name = 'Connection' AND NOT keeps_length) AND NOT (ce AND name = 'Warning') THEN {{'pos': pos, 'name': name, 'value': value}} END,
    CASE WHEN pos = least AND NOT keeps_length THEN {{'pos': 100, 'name': 'Connection', 'value': 'close'}} END,
    CASE WHEN pos = least AND ce THEN {{'pos': 101, 'name': 'Warning', 'value': '214 Transformation applied'}} END], lambda x: x IS NOT NULL)) AS h FROM g)
SELECT req_id, h.pos AS pos, 'response' AS stage, h.name AS name, h.value AS value FROM made""")
def headers_encoding(t):
    rewrite = rewriting(A.last_value(F.col("response"), "content-type"))
    return rows(t.messages, A.decoded(F.col("response"), rewrite))


@query("headers_defaults", sql="""
WITH f AS (SELECT r.req_id, r.mime AS expected, r.req_id % 3 = 0 AS wanted, bool_or(name = 'Date') AS dated, max(CASE WHEN name = 'Content-Type' THEN value END) AS declared
    FROM requests r JOIN headers h USING (req_id) WHERE stage = 'response' GROUP BY ALL),
g AS (SELECT *, wanted AND NOT coalesce(starts_with(declared, expected), false) AS replaced FROM f)
SELECT h.* FROM headers h JOIN g USING (req_id) WHERE stage = 'response' AND NOT (replaced AND name = 'Content-Type')
UNION ALL SELECT req_id, 100, 'response', 'Via', '1.1 unknown' FROM g
UNION ALL SELECT req_id, 101, 'response', 'Date', 'Wed, 01 Jan 2025 00:00:00 GMT' FROM g WHERE NOT dated
UNION ALL SELECT req_id, 102, 'response', 'Content-Type', expected FROM g WHERE replaced""")
def headers_defaults(t):
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    expected = F.when(F.col("req_id") % 3 == 0, F.array("mime"))
    return rows(t.messages, A.with_defaults(F.col("response"), now, expected))


@query("header_rules", sql="""
WITH c AS (SELECT req_id, max_by(value, pos) AS host FROM headers WHERE stage = 'request' AND name = 'Host' GROUP BY req_id),
m AS (SELECT h.*, r.url, c.host FROM headers h JOIN requests r USING (req_id) JOIN c USING (req_id)),
k AS (SELECT * FROM m WHERE NOT (stage = 'request' AND regexp_matches(name, '(?i)^X-H')) AND NOT regexp_matches(name, '(?i)^(via|warn)')
    AND NOT (stage = 'response' AND starts_with(url, 'https') AND regexp_matches(name, '(?i)^age'))),
s AS (SELECT DISTINCT req_id, url, host, stage FROM m)
SELECT req_id, pos, stage, name, value FROM k WHERE name <> 'X-Origin' AND NOT (stage = 'response' AND name = 'Cache-Control' AND contains(url, '/en/'))
  AND NOT (stage = 'request' AND name = 'User-Agent')
UNION ALL SELECT req_id, 103, stage, 'X-Origin', host FROM s
UNION ALL SELECT req_id, 104, stage, 'Cache-Control', 'no-cache' FROM s WHERE stage = 'response' AND contains(url, '/en/')
UNION ALL SELECT DISTINCT req_id, 105, stage, 'User-Agent', 'Plain/1.0 for ' || host FROM k WHERE stage = 'request' AND name = 'User-Agent'""")
def header_rules(t):
    host = A.last_value(F.col("request"), "host")

    def stage(name):
        return A.apply_rules(F.col(name), name, F.col("url"), host, rule_set(t).header_rules)

    return rows(t.messages, stage("request"), stage("response"))
