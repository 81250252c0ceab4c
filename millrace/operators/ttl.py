"""State of a cache along the time line of each host, by jumps from refresh to refresh.

A found answer is kept ANSWER_TTL; a lookup within that time is a hit and changes nothing. The first lookup after it
refreshes: it is stale (the old answer is served meanwhile). An error is not kept, so the lookups after it miss until
one is found. Which found lookups refresh decides everything else, and follows from one jump: a refresh leads to the
first found lookup at or after its expiry. A found lookup with no other within the life before it refreshes whatever
came earlier, so it begins a run of its own; most time lines fall into such runs of one. For longer runs the jumps are
doubled by joins until none is left, each length only from where runs begin or shorter jumps end, and the refreshes
are marked from the longest jumps down. No host is walked through in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.dns import ANSWER_TTL
from millrace.operators.timeline import beside
from millrace.session import written

LIFE = ANSWER_TTL * 1_000_000
ORDER = ["at_us", "req_id", "kind", "_id"]


def refreshes(rows: DataFrame) -> DataFrame:
    """_id of the found lookups that refresh, of rows (_id, req_id, host, at_us, kind) of an empty cache."""
    found = rows.where(F.col("kind") == "found")
    before = beside(found, "host", ORDER, {"_prev": F.col("at_us")})
    first = F.col("_prev").isNull() | (F.col("_prev") <= F.col("at_us") - LIFE)
    found = written(before.withColumn("_first", first).drop("_prev"), "found")
    heads = found.where("_first").select("_id")
    if found.where("NOT _first").isEmpty():
        return heads
    # the next found lookup at or after the expiry: expiries stand in one time line with the lookups, before those of their time
    none = F.lit(None)
    probes = found.select("host", (F.col("at_us") + LIFE).alias("at_us"), none.cast("long").alias("req_id"), none.cast("string").alias("kind"), "_id", "_first", F.lit(True).alias("_probe"))
    line = probes.unionByName(found.select("host", "at_us", "req_id", "kind", "_id", "_first", F.lit(False).alias("_probe")))
    mark = F.when(~F.col("_probe"), F.struct(F.col("_id").alias("to"), F.col("_first").alias("new")))
    ahead = beside(line.withColumn("_row", F.when(F.col("_probe"), 0).otherwise(1)), "host", ["at_us", "_row", "req_id", "kind", "_id"], {"_next": mark}, after=True)
    # what begins a run is marked by itself, so jumps end before it
    jumps = ahead.where("_probe AND NOT _next.new").select("_id", F.col("_next.to").alias("to"), "_first")
    levels = [written(jumps, "jumps")]
    while True:
        jumps = levels[-1]
        ends = jumps.select(F.col("to").alias("_id")).distinct().withColumn("_end", F.lit(True))
        starts = jumps.join(ends, "_id", "left").where("_first OR _end").select("_id", "to", "_first")
        on = jumps.select(F.col("_id").alias("to"), F.col("to").alias("_far"))
        longer = written(starts.join(on, "to").select("_id", F.col("_far").alias("to"), "_first"), "jumps")
        if longer.isEmpty():
            break
        levels.append(longer)
    marked = levels[0].where("_first").select("_id")
    for jumps in reversed(levels):
        marked = written(marked.union(jumps.join(marked, "_id", "left_semi").select("to")), "marked")
    return heads.union(marked).distinct()


def ttl_states(lookups: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """States of lookups (req_id, host, at_us, kind) and what the cache holds after them.

    The first table has req_id, host, state (hit, stale, miss), the second host, expires of the hosts whose last answer
    was found. ``known`` is such a table of what the cache holds before; lookups until its expiry are hits.
    """
    rows = written(lookups.select("req_id", "host", "at_us", "kind").withColumn("_id", F.monotonically_increasing_id()), "lookups")
    if known is None:
        rows = rows.withColumn("_held", F.lit(None).cast("long"))
    else:
        rows = written(rows.join(known.select(F.col("host").alias("_host"), F.col("expires").alias("_held")), F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host"), "lookups")
    early = F.coalesce(F.col("at_us") < F.col("_held"), F.lit(False))
    open_rows = rows.where(~early)
    path = refreshes(open_rows.drop("_held")).withColumn("_new", F.lit(True))
    flagged = open_rows.join(path, "_id", "left")
    marks = {"_from": F.when(F.col("_new"), F.col("at_us")), "_last": F.col("at_us")}
    placed = beside(flagged, "host", ORDER, marks)
    expiry = F.col("_from") + LIFE
    state = (
        F.when(F.col("at_us") < expiry, "hit")
        .when(F.col("_last") < expiry, "stale")
        # the first lookup that is not answered from what was held before
        .when(F.col("_last").isNull() & F.col("_held").isNotNull(), "stale")
        .otherwise("miss")
    )
    told = written(placed.withColumn("state", state).withColumn("_expires", F.when(F.col("_new"), F.col("at_us") + LIFE).when(F.col("state") == "hit", expiry)), "states")
    after = told.groupBy("host").agg(F.max(F.struct(*ORDER, F.col("_expires").alias("expires")))["expires"].alias("expires"))
    if known is not None:
        rest = known.select("host", "expires").join(after.select(F.col("host").alias("_host")), F.col("host").eqNullSafe(F.col("_host")), "left_anti")
        after = after.unionByName(rest)
    hits = rows.where(early).select("req_id", "host", F.lit("hit").alias("state"))
    return told.select("req_id", "host", "state").union(hits), after.where("expires IS NOT NULL")
