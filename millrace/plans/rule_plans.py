"""Rule catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import policy as P
from millrace.functions import rules as R
from millrace.operators import rules as G
from millrace.plans.http_plans import _handler_sql
from millrace.plans.loaded import scoped_rules
from millrace.plans.registry import query

ENABLED = ["allow", "block", "header", "htmlrewrite", "javascript", "nocomments", "rating", "replace", "xmlrewrite"]
REWRITING_KINDS = ["htmlrewrite", "image", "imagereduce", "nocomments", "replace", "xmlrewrite", "antivirus"]


def _in(items) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


def _url_test(rule) -> str:
    if rule.matchurls:
        return "(" + " OR ".join(f"regexp_matches(url, '{p}')" for p in rule.matchurls) + ")"
    return "NOT (" + (" OR ".join(f"regexp_matches(url, '{p}')" for p in rule.nomatchurls) or "false") + ")"


def _mime_test(rule) -> str:
    return "(" + " OR ".join(f"regexp_matches(mime, '{p}')" for p in rule.mimes) + ")" if rule.mimes else "true"


@query("rule_applies_url", sql=" UNION ALL ".join(f"SELECT req_id, '{r.sid}' AS sid FROM requests WHERE {_url_test(r)}" for r in P.SCOPED_RULES))
def rule_applies_url(t):
    hits = [F.when(R.applies_to_url(F.col("url"), r.matchurls, r.nomatchurls), F.lit(r.sid)) for r in scoped_rules(t)]
    return t.requests.select("req_id", F.explode(F.array_compact(F.array(*hits))).alias("sid"))


@query("rule_applies_mime", sql=" UNION ALL ".join(f"SELECT req_id, '{r.sid}' AS sid FROM requests WHERE {_mime_test(r)}" for r in P.SCOPED_RULES))
def rule_applies_mime(t):
    hits = [F.when(R.applies_to_mime(F.col("mime"), r.mimes), F.lit(r.sid)) for r in scoped_rules(t)]
    return t.requests.select("req_id", F.explode(F.array_compact(F.array(*hits))).alias("sid"))


def _matrix_sql() -> str:
    parts = []
    for stage in P.STAGES:
        for h in P.HANDLERS:
            reason = f"CASE WHEN {_handler_sql(h.mimes)} THEN '' ELSE 'mime' END" if stage in h.stages else "'stage'"
            for r in [r for r in P.SCOPED_RULES if r.handler == h.name] or [None]:
                why = "NULL::VARCHAR" if r is None else f"CASE WHEN NOT {_url_test(r)} THEN 'url' WHEN NOT {_mime_test(r)} THEN 'mime' ELSE '' END"
                sid = "NULL::VARCHAR" if r is None else f"'{r.sid}'"
                parts.append(f"SELECT url, mime, '{stage}' AS stage, '{h.name}' AS handler, {reason} AS reason, {sid} AS sid, {why} AS rule_reason FROM pairs")
    return ("WITH pairs AS (SELECT DISTINCT url, mime, mime AS m FROM requests), rows AS (" + " UNION ALL ".join(parts)
            + ") SELECT url, mime, stage, handler, reason = '' AS applies, reason, sid, rule_reason = '' AS rule_applies, rule_reason FROM rows")


@query("rule_matrix", sql=_matrix_sql())
def rule_matrix(t):
    return G.matrix(t.requests.select("url", "mime").distinct(), P.HANDLERS, P.STAGES, scoped_rules(t))


ACTIVE_SQL = f"SELECT * FROM rules WHERE NOT disable AND NOT folder_disable AND kind IN {_in(ENABLED)}"


@query("active_rules", sql=f"SELECT k, sid, folder_sid, kind FROM ({ACTIVE_SQL})")
def active_rules(t):
    return G.active(t.rules, ENABLED).select("k", "sid", "folder_sid", "kind")


@query("duplicate_single_rules", sql=f"""SELECT kind, count(*) AS n FROM rules WHERE NOT disable AND kind IN {_in(G.SINGLE_KINDS)} GROUP BY kind HAVING count(*) > 1""")
def duplicate_single_rules(t):
    enabled = t.rules.where(~F.col("disable") & F.col("kind").isin(G.SINGLE_KINDS))
    return enabled.groupBy("kind").agg(F.count("*").alias("n")).where("n > 1")


@query("duplicate_sids", sql="SELECT sid, count(*) AS n FROM rules WHERE sid IS NOT NULL GROUP BY sid HAVING count(*) > 1")
def duplicate_sids(t):
    return t.rules.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.count("*").alias("n")).where("n > 1")


@query("rewrite_mime_set", sql=f"SELECT DISTINCT mime FROM rules WHERE NOT disable AND NOT folder_disable AND kind IN {_in(REWRITING_KINDS)} AND mime IS NOT NULL")
def rewrite_mime_set(t):
    """MIME types that any active rewriting rule asks for."""
    return G.active(t.rules, REWRITING_KINDS).where(F.col("mime").isNotNull()).select("mime").distinct()


@query("rule_order", sql="""SELECT folder_sid, k, row_number() OVER w - 1 AS oid, lag(k) OVER w IS NOT NULL AS up, lead(k) OVER w IS NOT NULL AS down
  FROM rules WINDOW w AS (PARTITION BY folder_sid ORDER BY k)""")
def rule_order(t):
    return G.ordered(t.rules.select("folder_sid", "k"))


@query("generate_sids", sql="""WITH m AS (SELECT k, row_number() OVER (ORDER BY k) AS rn FROM rules WHERE sid IS NULL),
  f AS (SELECT n, row_number() OVER (ORDER BY n) AS rn FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM rules))) AS n)
        WHERE 'wc.' || n::VARCHAR NOT IN (SELECT sid FROM rules WHERE sid IS NOT NULL))
  SELECT k, 'wc.' || n::VARCHAR AS sid FROM m JOIN f USING (rn)""")
def generate_sids(t):
    return G.generate_sids(t.rules.select("k", "sid"))


@query("rules_sorted", sql="SELECT folder_oid, folder_sid, oid, kind, sid FROM rules ORDER BY folder_oid, folder_sid, oid")
def rules_sorted(t):
    return t.rules.select("folder_oid", "folder_sid", "oid", "kind", "sid").orderBy("folder_oid", "folder_sid", "oid")


def _merge_sql() -> str:
    parts = ["SELECT n.sid, 'insert' AS change, '' AS field, NULL::VARCHAR AS old, NULL::VARCHAR AS new FROM n LEFT JOIN c USING (sid) WHERE c.k IS NULL"]
    for f in G.MERGED_ATTRS:
        parts.append(f"SELECT n.sid, 'attr', '{f}', c.{f}, n.{f} FROM n JOIN c USING (sid) WHERE c.{f} IS DISTINCT FROM n.{f}")
    for f in G.MERGED_TITLES:
        parts.append(f"SELECT n.sid, 'title', '{f}', coalesce(c.{f}, ''), n.{f} FROM n JOIN c USING (sid) WHERE n.{f} IS NOT NULL AND c.{f} IS DISTINCT FROM n.{f}")
    return "WITH n AS (SELECT * FROM rules_incoming WHERE sid LIKE 'wc%'), c AS (SELECT * FROM rules WHERE sid IS NOT NULL) " + " UNION ALL ".join(parts)


@query("merge_folders", sql=_merge_sql())
def merge_folders(t):
    return G.merge_changes(t.rules, t.rules_incoming)
