"""Name, network, cache and manifest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import net as N
from millrace.functions import urls as U
from millrace.operators import dns as D
from millrace.operators.manifest import manifest_diff as diff_manifest
from millrace.operators.ranking import with_row_number
from millrace.plans.http_plans import LONG_SQL
from millrace.plans.registry import query

NETS = ["10.0.0.5", " 10.0.0.64/27", "10.0.0.128/255.255.255.192", "10.0.0.1/99", "host.example"]


@query("host_in_nets", sql=f"""SELECT req_id FROM (SELECT req_id, client_ip, {LONG_SQL} AS n FROM requests)
  WHERE client_ip = '10.0.0.5' OR n BETWEEN 167772224 AND 167772255 OR n BETWEEN 167772288 AND 167772351""")
def host_in_nets(t):
    entries = t.spark.createDataFrame([(e,) for e in NETS], "entry string")
    return D.in_networks(t.requests.select("req_id", "client_ip"), "client_ip", entries).select("req_id")


HOST_FORMS = "CASE req_id % 4 WHEN 0 THEN client_ip WHEN 1 THEN replace(host, '.', '..') WHEN 2 THEN ' ' || host || ' ' ELSE host END"
HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query("host_enrich", sql=f"""WITH r AS (SELECT req_id, {HOST_FORMS} AS raw, CASE WHEN req_id % 4 = 0 THEN client_ip ELSE host END AS clean, client_ip
    FROM (SELECT *, {HOST_SQL} AS host FROM requests)),
  k AS (SELECT name, min(rdata) AS rdata FROM dns_records WHERE rdtype = 'A' GROUP BY name)
  SELECT req_id, clean, CASE WHEN req_id % 4 = 0 THEN client_ip ELSE rdata END AS address FROM r LEFT JOIN k ON k.name = r.clean""")
def host_enrich(t):
    rows = t.requests.withColumn("host", U.host(F.col("url"))).select("req_id", F.expr(HOST_FORMS).alias("raw"))
    known = t.dns_records.where(F.col("rdtype") == "A")
    return D.enrich(rows, "raw", known).select("req_id", "clean", "address")


@query("lookup_asof", sql="""WITH f AS (SELECT *, lag(at_us) OVER w AS before_us, lag(kind) OVER w AS before_kind FROM lookups WINDOW w AS (PARTITION BY host ORDER BY at_us, req_id))
  SELECT req_id, host, CASE WHEN before_kind IS DISTINCT FROM 'found' THEN 'miss' WHEN at_us - before_us < 1800000000 THEN 'hit' ELSE 'stale' END AS state FROM f""")
def lookup_asof(t):
    return D.cache_state(t.lookups).select("req_id", "host", "state")


SEARCH = ["example.com", "example.net"]


@query("host_expand", sql=f"""WITH n AS (SELECT DISTINCT CASE req_id % 3 WHEN 0 THEN regexp_replace({HOST_SQL}, '[.]example[.].*$', '') WHEN 1 THEN {HOST_SQL} ELSE 'no..such' || (req_id % 5)::VARCHAR END AS name FROM requests),
  c AS (SELECT name, replace(name, '..', '.') AS clean FROM n), k AS (SELECT DISTINCT name FROM dns_records WHERE rdtype = 'A'),
  a AS (SELECT name, clean, CASE WHEN clean IN (FROM k) THEN clean WHEN clean || '.example.com' IN (FROM k) THEN clean || '.example.com' WHEN clean || '.example.net' IN (FROM k) THEN clean || '.example.net' END AS answer FROM c)
  SELECT name, CASE WHEN answer IS NULL THEN 'error' WHEN answer = clean THEN 'found' ELSE 'redirect' END AS kind, answer FROM a""")
def host_expand(t):
    host = U.host(F.col("url"))
    r = F.col("req_id") % 3
    name = F.when(r == 0, F.regexp_replace(host, "[.]example[.].*$", "")).when(r == 1, host).otherwise(
        F.concat(F.lit("no..such"), (F.col("req_id") % 5).cast("string")))
    return D.expand_hosts(t.requests.select(name.alias("name")), t.dns_records.where(F.col("rdtype") == "A"), SEARCH)


@query("dns_deepest_match", sql="""WITH n AS (SELECT DISTINCT name FROM dns_records), d AS (SELECT DISTINCT name AS domain FROM dns_records WHERE rdtype IN ('A', 'NS'))
  SELECT n.name, coalesce(max_by(d.domain, len(d.domain)), '') AS domain FROM n LEFT JOIN d ON n.name = d.domain OR n.name LIKE '%.' || d.domain GROUP BY n.name""")
def dns_deepest_match(t):
    domains = t.dns_records.where(F.col("rdtype").isin("A", "NS")).select(F.col("name").alias("domain"))
    return D.deepest_match(t.dns_records.select("name"), domains)


@query("cname_chase", sql="""WITH c AS (SELECT name, arg_min(rdata, seq) AS target, min(ttl) AS ttl FROM dns_records WHERE rdtype = 'CNAME' GROUP BY name),
  a AS (SELECT name, min(rdata) AS rdata, min(ttl) AS ttl FROM dns_records WHERE rdtype = 'A' GROUP BY name),
  walk(name, target, hops, ttl) AS (SELECT name, target, 1, ttl FROM c UNION ALL
    SELECT w.name, c.target, w.hops + 1, least(w.ttl, c.ttl) FROM walk w JOIN c ON c.name = w.target WHERE w.hops < 15),
  ends AS (SELECT w.name, w.target, w.hops, least(w.ttl, a.ttl) AS ttl, a.rdata FROM walk w JOIN a ON a.name = w.target WHERE w.hops < 15 AND w.target NOT IN (SELECT name FROM c))
  SELECT c.name, e.target, CAST(e.hops AS INTEGER) AS hops, e.ttl, e.rdata FROM c LEFT JOIN ends e USING (name)""")
def cname_chase(t):
    return D.chase_aliases(t.dns_records)


NEW_ZONE = "CASE WHEN rdtype = 'A' AND length(name) % 4 = 0 THEN rdata || '9' ELSE rdata END"


@query("zone_diff", sql=f"""WITH o AS (SELECT DISTINCT zone, name, rdclass, rdtype, rdata FROM dns_records),
  n AS (SELECT DISTINCT zone, name, rdclass, rdtype, {NEW_ZONE} AS rdata FROM dns_records WHERE name NOT LIKE 'alias.%')
  SELECT *, 'removed' AS side FROM (FROM o EXCEPT FROM n) UNION ALL SELECT *, 'added' FROM (FROM n EXCEPT FROM o)""")
def zone_diff(t):
    new = t.dns_records.where(~F.startswith("name", F.lit("alias."))).withColumn("rdata", F.expr(NEW_ZONE))
    return D.zone_diff(t.dns_records, new)


@query("dns_rrsets", sql="""WITH m AS (SELECT name, rdclass, rdtype, min(ttl) AS ttl, arg_max(rdata, (seq, rdata)) AS last FROM dns_records GROUP BY ALL)
  SELECT DISTINCT r.name, r.rdclass, r.rdtype, m.ttl, r.rdata FROM dns_records r JOIN m USING (name, rdclass, rdtype)
  WHERE r.rdtype NOT IN ('SOA', 'NXT', 'DNAME', 'NSEC') OR r.rdata = m.last""")
def dns_rrsets(t):
    return D.rrsets(t.dns_records)


NEW_VALUE = "CASE WHEN rdtype IN ('A', 'SOA') AND length(name) % 4 = 0 THEN rdata || '9' ELSE rdata END"
ONE_VALUE = "('SOA', 'NXT', 'DNAME', 'NSEC')"


@query("rrset_set_ops", sql=f"""WITH a AS (SELECT name, rdclass, rdtype, rdata, ttl, seq FROM dns_records),
  b AS (SELECT name, rdclass, rdtype, {NEW_VALUE} AS rdata, ttl - 7 AS ttl, seq FROM dns_records WHERE length(name) % 3 <> 0),
  la AS (SELECT name, rdclass, rdtype, arg_max(rdata, (seq, rdata)) AS last FROM a GROUP BY ALL), lb AS (SELECT name, rdclass, rdtype, arg_max(rdata, (seq, rdata)) AS last FROM b GROUP BY ALL),
  sa AS (SELECT DISTINCT name, rdclass, rdtype, rdata FROM a JOIN la USING (name, rdclass, rdtype) WHERE rdtype NOT IN {ONE_VALUE} OR rdata = last),
  sb AS (SELECT DISTINCT name, rdclass, rdtype, rdata FROM b JOIN lb USING (name, rdclass, rdtype) WHERE rdtype NOT IN {ONE_VALUE} OR rdata = last),
  t AS (SELECT name, rdclass, rdtype, min(ttl) AS ttl FROM (SELECT name, rdclass, rdtype, ttl FROM a UNION ALL SELECT name, rdclass, rdtype, ttl FROM b) GROUP BY ALL),
  o AS (SELECT 'union' AS operation, * FROM (FROM sb UNION SELECT * FROM sa WHERE rdtype NOT IN {ONE_VALUE} OR (name, rdclass, rdtype) NOT IN (SELECT (name, rdclass, rdtype) FROM sb))
    UNION ALL SELECT 'intersection', * FROM (FROM sa INTERSECT FROM sb))
  SELECT operation, name, rdclass, rdtype, rdata, ttl FROM o JOIN t USING (name, rdclass, rdtype)""")
def rrset_set_ops(t):
    a = t.dns_records
    b = a.where(F.length("name") % 3 != 0).withColumn("rdata", F.expr(NEW_VALUE)).withColumn("ttl", F.col("ttl") - 7)
    both = [D.rrset_operation(a, b, op).withColumn("operation", F.lit(op)) for op in ("union", "intersection")]
    return both[0].unionByName(both[1]).select("operation", *D.SET, "rdata", "ttl")


@query("zone_check", sql="""SELECT zone, bool_or(name = zone AND rdtype = 'SOA') AS has_soa, bool_or(name = zone AND rdtype = 'NS') AS has_ns FROM dns_records GROUP BY zone""")
def zone_check(t):
    return D.zone_check(t.dns_records)


@query("dns_canonical_sort", sql="""WITH n AS (SELECT DISTINCT CASE WHEN length(name) % 3 = 0 THEN upper(name) ELSE name END AS name FROM dns_records)
  SELECT name, row_number() OVER (ORDER BY array_to_string(list_reverse(string_split(lower(name), '.')), chr(1))) AS rank FROM n""")
def dns_canonical_sort(t):
    mixed = F.when(F.length("name") % 3 == 0, F.upper("name")).otherwise(F.col("name"))
    names = t.dns_records.select(mixed.alias("name")).distinct().withColumn("key", D.canonical_key("name"))
    return with_row_number(names, ["key"], out="rank").select("name", "rank")


RELATED = ["host", "'www.' || host", "regexp_replace(host, '^[^.]*[.]', '')", "'other.' || regexp_replace(host, '^[^.]*[.]', '')", "'nothing.test'", "upper(host)", "host || '.'"]


@query("dns_name_relation", sql=f"""WITH v AS (SELECT host, unnest([{', '.join(RELATED)}]) AS other FROM hosts),
  l AS (SELECT *, list_reverse(string_split(lower(host), '.')) AS a, list_reverse(string_split(lower(other), '.')) AS b FROM v),
  s AS (SELECT *, CASE WHEN other LIKE '%.' THEN 0 ELSE coalesce(list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])), 0) END AS shared FROM l)
  SELECT host, other, CAST(shared AS INTEGER) AS shared, CASE WHEN other LIKE '%.' OR shared = 0 THEN 'none' WHEN shared < least(len(a), len(b)) THEN 'common'
    WHEN len(a) < len(b) THEN 'super' WHEN len(a) > len(b) THEN 'sub' ELSE 'equal' END AS relation FROM s""")
def dns_name_relation(t):
    rows = t.hosts.select("host", F.explode(F.array(*[F.expr(e) for e in RELATED])).alias("other"))
    return rows.select("host", "other", N.name_relation(F.col("host"), F.col("other")).alias("r")).select("host", "other", "r.*")


@query("endpoint_load", sql="""WITH s AS (SELECT endpoint, version, start_us AS t_us, 1 AS d FROM transfers UNION ALL SELECT endpoint, version, end_us, -1 FROM transfers),
  g AS (SELECT endpoint, version, t_us, sum(d) AS d FROM s GROUP BY ALL),
  r AS (SELECT *, sum(d) OVER (PARTITION BY endpoint, version ORDER BY t_us) AS busy FROM g)
  SELECT endpoint, version, max(busy)::BIGINT AS peak, CASE version WHEN 'HTTP/1.1' THEN 40 ELSE 60 END AS allowed,
    max(busy) > CASE version WHEN 'HTTP/1.1' THEN 40 ELSE 60 END AS overloaded FROM r GROUP BY endpoint, version""")
def endpoint_load(t):
    return D.endpoint_load(t.transfers)


@query("manifest_diff", sql="""SELECT coalesce(f.filename, m.filename) AS filename, CASE WHEN m.filename IS NULL THEN 'local' WHEN f.filename IS NULL THEN 'new'
    WHEN md5(f.content) = m.md5sum THEN 'unchanged' ELSE 'changed' END AS state,
  CASE WHEN f.filename IS NOT NULL AND m.filename IS NOT NULL THEN f.version[1] = m.version[1] END AS compatible
  FROM local_files f FULL JOIN manifest m ON f.filename = m.filename""")
def manifest_diff(t):
    return diff_manifest(t.files, t.manifest)
