import random

import pytest
from pyspark.sql import functions as F

from millrace import policy as P
from millrace.operators import timeline
from millrace.operators.ttl import ttl_states
from millrace.session import fresh_path
from millrace.streaming import jobs as J


def in_files(spark, df, name, parts, per_trigger=1):
    path = fresh_path(spark, name)
    for part in parts:
        df.where(part).coalesce(1).write.mode("append").parquet(path)
    return J.file_stream(spark, path, df.schema, per_trigger)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_throughput_over_several_batches(tables, spark):
    rows = tables.requests.select("req_id", "ts", "bytes")
    stream = in_files(spark, rows, "t", ["req_id < 300", "req_id BETWEEN 300 AND 700", "req_id > 700"])
    got = J.run_updates(J.throughput(stream.select("ts", "bytes")), "t", ["start"])
    assert same(got, J.throughput(rows))


def test_sessions_over_several_batches(tables, spark):
    rows = tables.requests.select("req_id", "ts", "url")
    both = rows.unionByName(J.closing_row(rows, "ts"))
    parts = ["req_id < 300", "req_id BETWEEN 300 AND 700", "req_id > 700", "req_id IS NULL"]
    got = J.run_to_files(J.sessions(in_files(spark, both, "s", parts).select("ts", "url")), "s")
    assert got.count() > 0 and same(got, J.sessions(rows))


def test_lookups_under_way_whatever_the_batches(spark):
    day = 86_400_000_000
    rows = spark.createDataFrame([(k, "h", k * day, "found") for k in range(6)] + [(10 + k, "g", k * 300_000_000, "found") for k in range(6)], "req_id long, host string, at_us long, kind string")
    both = rows.unionByName(J.closing_row(rows, "at_us", micros=True))
    for parts in (["true"], ["at_us < 100000000000", "at_us >= 100000000000"]):
        got = J.run_to_files(J.coalesce_lookups(in_files(spark, both, "l", parts)), "l").collect()
        assert sorted(r.req_id for r in got) == [0, 1, 2, 3, 4, 5, 10]


def walked(rows, life=1800_000_000):
    """State of each lookup, one after the other."""
    kept, states = {}, {}
    for r in rows:
        kind, expires = kept.get(r.host, ("none", 0))
        if kind == "found" and r.at_us < expires:
            states[r.req_id] = "hit"
            continue
        states[r.req_id] = "stale" if kind == "found" else "miss"
        kept[r.host] = (r.kind, r.at_us + (life if r.kind == "found" else 0))
    return states


def in_order(rows):
    return sorted(rows, key=lambda r: (r.at_us, r.req_id))


def states(df):
    got = df.collect()
    found = {r.req_id: r.state for r in got}
    assert len(found) == len(got)
    return found


def test_cache_keeps_its_state_between_batches(tables, spark):
    rows = tables.lookups
    cut = rows.selectExpr("percentile(at_us, 0.5) AS m").first().m
    want = walked(in_order(rows.collect()))
    for parts in ([f"at_us < {cut}", f"at_us >= {cut}"], ["true"]):
        assert states(J.run_ttl_cache(in_files(spark, rows, "c", parts), "c")) == want


def dense_lookups(spark, n=3000):
    """A host with a third of all lookups, minutes apart, one with pauses, and late lookups of a third."""
    rng, minute, rows = random.Random(8), 60_000_000, []
    for i in range(n):
        host, step = ("hot", 1) if i % 3 == 0 else ("some", 9) if i % 3 == 1 else (f"h{rng.randrange(20)}", 5)
        rows.append((i, host, i * step * minute // 3 + rng.randrange(minute), rng.choice(["found", "found", "error"])))
    rows += [(n, "hot", rows[0][2], "found"), (n + 1, "twice", 5, "error"), (n + 2, "twice", 5, "found")]
    return spark.createDataFrame(rows, "req_id long, host string, at_us long, kind string")


@pytest.mark.parametrize("longest", [50, 500_000])
def test_dense_time_lines(spark, monkeypatch, longest):
    monkeypatch.setattr(timeline, "ROWS", longest)
    rows = dense_lookups(spark)
    got, after = ttl_states(rows)
    want = walked(in_order(rows.collect()))
    assert states(got) == want
    assert {"hit", "stale", "miss"} == set(want.values())
    assert after.where("host = 'hot'").count() <= 1
    empty, nothing = ttl_states(rows.limit(0))
    assert empty.count() == nothing.count() == 0


def test_late_lookups_and_many_batches(spark):
    rows = dense_lookups(spark, 600)
    parts = ["req_id % 4 = 1", "req_id % 4 = 3", "req_id % 4 IN (0, 2)"]
    one_by_one = [r for k in ([1], [3], [0, 2]) for r in in_order([r for r in rows.collect() if r.req_id % 4 in k])]
    assert states(J.run_ttl_cache(in_files(spark, rows, "late", parts), "late")) == walked(one_by_one)


def test_expired_answers_are_forgotten(spark):
    hour = 3600_000_000
    rows = spark.createDataFrame([(0, "a", 0, "found"), (1, "b", 30 * hour, "found"), (2, "a", 31 * hour, "found"), (3, "b", 31 * hour, "found")], "req_id long, host string, at_us long, kind string")
    parts = ["req_id = 0", "req_id = 1", "req_id > 1"]
    kept = states(J.run_ttl_cache(in_files(spark, rows, "keep", parts), "keep"))
    gone = states(J.run_ttl_cache(in_files(spark, rows, "gone", parts), "gone", forget=86_400))
    assert (kept[2], gone[2]) == ("stale", "miss") and kept[3] == gone[3] == "stale"


def test_signatures_across_chunk_borders(spark):
    sig = "SIGNATURE"
    docs = spark.createDataFrame([(1, "x" * (J.CHUNK_CHARS - 4) + sig + "y" * 50), (2, "z" * 9000), (3, sig)], "doc_id bigint, text string")
    chunks = J.chunked(docs)
    assert chunks.count() == 2 + 3 + 1
    got = sorted(r.stream_id for r in J.chunk_hits(chunks, [("S", sig)]).distinct().collect())
    assert got == [1, 3]
    stream = in_files(spark, chunks, "k", ["seq % 2 = 0", "seq % 2 = 1"])
    assert sorted(r.stream_id for r in J.run_to_files(J.chunk_hits(stream, [("S", sig)]), "k").distinct().collect()) == [1, 3]


def test_chunked_scan_equals_whole_text(tables):
    whole = None
    for name, sig in P.SIGNATURES:
        hit = tables.documents.where(F.contains("text", F.lit(sig))).select(F.col("doc_id").alias("stream_id"), F.lit(name).alias("name"))
        whole = hit if whole is None else whole.unionByName(hit)
    assert same(J.chunk_hits(J.chunked(tables.documents), P.SIGNATURES).distinct(), whole)
