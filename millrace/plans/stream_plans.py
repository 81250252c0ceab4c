"""Streaming queries: each runs its stream over files to the end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import policy as P
from millrace.plans import verdict_plans as V
from millrace.plans.registry import SQL, query
from millrace.plans.url_plans import HOST
from millrace.session import fresh_path
from millrace.streaming import jobs as J


def staged(t, rows, name, files_per_trigger=None, last=None):
    """The rows as a file stream, with rows that come after all others."""
    path = fresh_path(t.spark, name)
    rows.write.parquet(path)
    if last is not None:
        last.write.mode("append").parquet(path)
    return J.file_stream(t.spark, path, rows.schema, files_per_trigger)


@query("stream_verdict")
def stream_verdict(t):
    """Requests judged as they come, every batch against the lists as tables."""
    stream = staged(t, t.requests, "requests")
    return J.run_batches(stream, "verdicts", lambda batch: V.verdicts(t, batch).select("req_id", "verdict", "list_class", "sid", "document"))


SQL["stream_verdict"] = SQL["url_verdict"]


@query("stream_throughput", sql="""SELECT CAST(floor(epoch(ts) / 5) * 5 AS BIGINT) AS start, sum(bytes) / 5.0 AS bytes_per_second FROM requests GROUP BY 1""")
def stream_throughput(t):
    return J.run_updates(J.throughput(staged(t, t.requests.select("ts", "bytes"), "traffic")), "throughput", ["start"])


@query("stream_sessions", sql=f"""WITH r AS (SELECT {HOST} AS endpoint, epoch_us(ts) AS t_us FROM requests),
  g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER w < 300000000 THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY endpoint ORDER BY t_us)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY endpoint ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS n FROM g)
  SELECT endpoint, min(t_us) AS start_us, max(t_us) + 300000000 AS end_us, count(*) AS requests FROM s GROUP BY endpoint, n""")
def stream_sessions(t):
    rows = t.requests.select("ts", "url")
    return J.run_to_files(J.sessions(staged(t, rows, "visits", last=J.closing_row(rows, "ts"))), "sessions")


TTL_SQL = """WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY at_us, req_id) AS rn FROM lookups),
  walk(req_id, host, rn, state, kept, expires) AS (
    SELECT req_id, host, rn, 'miss', kind, at_us + CASE kind WHEN 'found' THEN 1800000000 ELSE 0 END FROM l WHERE rn = 1
    UNION ALL SELECT l.req_id, l.host, l.rn, CASE WHEN kept = 'found' AND at_us < expires THEN 'hit' WHEN kept = 'found' THEN 'stale' ELSE 'miss' END,
      CASE WHEN kept = 'found' AND at_us < expires THEN kept ELSE kind END,
      CASE WHEN kept = 'found' AND at_us < expires THEN expires ELSE at_us + CASE kind WHEN 'found' THEN 1800000000 ELSE 0 END END
    FROM walk w JOIN l ON l.host = w.host AND l.rn = w.rn + 1)
  SELECT req_id, host, state FROM walk"""


@query("stream_ttl_cache", sql=TTL_SQL)
def stream_ttl_cache(t):
    return J.run_ttl_cache(staged(t, t.lookups, "lookups"), "cache")


@query("stream_coalesce", sql="""SELECT host, req_id FROM (SELECT *, at_us - lag(at_us) OVER (PARTITION BY host ORDER BY at_us, req_id) AS gap FROM lookups)
  WHERE gap IS NULL OR gap >= 600000000""")
def stream_coalesce(t):
    rows = t.lookups
    return J.run_to_files(J.coalesce_lookups(staged(t, rows, "pending", last=J.closing_row(rows, "at_us", micros=True))), "coalesced")


@query("stream_overlap_scan", sql=f"SELECT doc_id AS stream_id, name FROM documents JOIN {V.values(P.SIGNATURES)} s(name, sig) ON contains(text, sig)")
def stream_overlap_scan(t):
    stream = staged(t, J.chunked(t.documents), "chunks")
    return J.run_to_files(J.chunk_hits(stream, P.SIGNATURES), "hits").distinct()


@query("stream_rule_reload", sql=f"""SELECT req_id, CASE WHEN req_id % 2 = 0 THEN 1 ELSE 2 END AS version,
  {HOST} IN (SELECT entry FROM lists WHERE kind = CASE WHEN req_id % 2 = 0 THEN 'blockdomains' ELSE 'allowdomains' END) AS blocked FROM requests""")
def stream_rule_reload(t):
    """Half of the requests come under the first version of the list, the rest after it has changed."""
    inbox, rules, out, checkpoint = (fresh_path(t.spark, n) for n in ("inbox", "versions", "judged", "judged-checkpoint"))
    rows = t.requests.select("req_id", "url")

    def newest(spark):
        versions = spark.read.parquet(rules)
        latest = versions.agg(F.max("version").alias("version"))
        return versions.join(F.broadcast(latest), "version", "left_semi")

    for version, kind in ((1, "blockdomains"), (2, "allowdomains")):
        entries = V.listed(t, kind).select("entry", F.lit(version).alias("version"))
        entries.write.mode("append").parquet(rules)
        rows.where(F.col("req_id") % 2 == version - 1).write.mode("append").parquet(inbox)
        J.reload_verdicts(J.file_stream(t.spark, inbox, rows.schema), newest, out, checkpoint)
    return t.spark.read.parquet(out).select("req_id", "version", "blocked")
