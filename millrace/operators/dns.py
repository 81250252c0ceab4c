"""Names, records and networks as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import net as N
from millrace.operators import timeline
from millrace.session import ensure_checkpoint_dir

# Life of a found answer in seconds, hops followed along aliases, types with one value.
ANSWER_TTL = 1800
MAX_HOPS = 15
SINGLETONS = ["SOA", "NXT", "DNAME", "NSEC"]
# Open connections per endpoint, by protocol version.
CONNECTIONS = {"HTTP/1.1": 40, "HTTP/1.0": 60}


def in_networks(rows: DataFrame, ip: str, entries: DataFrame) -> DataFrame:
    """Rows whose address is a listed host or lies in a listed network.

    An address without the bits that a network leaves open equals the network, so every mask in use makes an
    equi-join key (33 with plain masks; any others are those the list names). Only distinct addresses are tested.
    """
    addresses = rows.select(F.col(ip).alias("_ip")).distinct().withColumn("_n", N.ip_to_long(F.col("_ip")))
    ranges = entries.select(F.trim("entry").alias("entry")).select("entry", N.net_range(F.col("entry")).alias("r"))
    nets = ranges.where(F.col("r").isNotNull()).select(F.col("r.lo").alias("_net"), (F.col("r.hi") - F.col("r.lo")).alias("_size")).distinct()
    hosts = ranges.where(N.is_valid_ip(F.col("entry"))).select(F.col("entry").alias("_ip"))
    masks = F.array(*[F.lit(r["_size"]) for r in nets.select("_size").distinct().collect()]).cast("array<bigint>")
    probes = addresses.where(F.col("_n").isNotNull()).select("_ip", "_n", F.explode(masks).alias("_size"))
    probes = probes.withColumn("_net", F.col("_n").bitwiseAND(F.lit(4294967295) - F.col("_size")))
    by_net = probes.join(nets, ["_net", "_size"], "left_semi")
    found = by_net.select("_ip").union(addresses.join(hosts, "_ip", "left_semi").select("_ip")).distinct()
    return rows.join(found, rows[ip] == found["_ip"], "left_semi")


def enrich(rows: DataFrame, host: str, known: DataFrame) -> DataFrame:
    """Add ``address``: the known address of the cleaned host name; an address stands for itself."""
    cleaned = rows.withColumn("clean", N.clean_host(F.col(host)))
    table = known.groupBy(F.col("name").alias("clean")).agg(F.min("rdata").alias("_address"))
    joined = cleaned.join(table, "clean", "left")
    return joined.withColumn("address", F.when(N.is_valid_ip(F.col("clean")), F.col("clean")).otherwise(F.col("_address"))).drop("_address")


def cache_state(lookups: DataFrame) -> DataFrame:
    """Add ``state`` by the latest earlier answer for the host.

    hit: found less than ANSWER_TTL ago; stale: found longer ago; miss: none, or the answer was an error,
    which is never cached and also replaces an older found answer.
    """
    rows = timeline.last_before(lookups, "host", "at_us", "req_id", F.col("kind"), "_before")
    age = F.col("at_us") - F.col("_before.at_us")
    state = (
        F.when(F.coalesce(F.col("_before.value") != "found", F.lit(True)), "miss")
        .when(age < ANSWER_TTL * 1_000_000, "hit")
        .otherwise("stale")
    )
    return rows.withColumn("state", state).drop("_before")


def expand_hosts(names: DataFrame, answers: DataFrame, search: Sequence[str]) -> DataFrame:
    """name, kind, answer: the first of the name and the name in each search domain that is known."""
    candidates = F.array(F.col("clean"), *[F.concat("clean", F.lit("." + d)) for d in search])
    rows = names.select("name", N.clean_host(F.col("name")).alias("clean")).distinct()
    tried = rows.select("name", "clean", F.posexplode(candidates).alias("pos", "candidate"))
    known = answers.select(F.col("name").alias("candidate")).distinct().withColumn("found", F.lit(True))
    best = tried.join(known, "candidate", "left").groupBy("name", "clean").agg(
        F.min_by("candidate", F.when(F.col("found"), F.col("pos"))).alias("answer")
    )
    kind = F.when(F.col("answer").isNull(), "error").when(F.col("answer") == F.col("clean"), "found").otherwise("redirect")
    return best.select("name", kind.alias("kind"), "answer")


def deepest_match(names: DataFrame, domains: DataFrame) -> DataFrame:
    """name, domain: the longest listed domain that is the name or a parent of it; empty when none is."""
    rows = names.select("name").distinct().select("name", F.explode(N.name_suffixes(F.lower("name"))).alias("domain"))
    hits = rows.join(domains.select("domain").distinct(), "domain")
    best = hits.groupBy("name").agg(F.max_by("domain", F.length("domain")).alias("domain"))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.coalesce("domain", F.lit("")).alias("domain"))


def chase_aliases(records: DataFrame) -> DataFrame:
    """name, target, hops, ttl, rdata of every alias: where it ends, at most MAX_HOPS - 1 aliases away.

    Each round joins the table of jumps with itself, so the jump length doubles: four joins reach
    sixteen hops. The table is checkpointed after a round, or every round would run all rounds before it
    twice. Chains that are longer, run in a circle or end nowhere have null rdata.
    """
    ensure_checkpoint_dir(records.sparkSession)
    jumps = records.where(F.col("rdtype") == "CNAME").groupBy("name").agg(
        F.min(F.struct("seq", "rdata"))["rdata"].alias("target"), F.min("ttl").alias("ttl")
    )
    jumps = jumps.withColumn("hops", F.lit(1)).checkpoint()
    reach, longest = 1, 0
    while reach < MAX_HOPS:
        nxt = jumps.select(F.col("name").alias("target"), F.col("target").alias("_t"), F.col("ttl").alias("_ttl"), F.col("hops").alias("_h"))
        jumps = jumps.join(nxt, "target", "left").select(
            "name", F.coalesce("_t", "target").alias("target"), F.least("ttl", "_ttl").alias("ttl"),
            (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"),
        ).checkpoint()
        reach *= 2
        # one number: when no chain has grown, all have ended
        grown = jumps.agg(F.max("hops").alias("h")).first().h
        if grown == longest:
            break
        longest = grown
    answers = records.where(F.col("rdtype") == "A").groupBy(F.col("name").alias("target")).agg(
        F.min("rdata").alias("rdata"), F.min("ttl").alias("_ttl")
    )
    rows = jumps.join(answers, "target", "left")
    ok = F.col("rdata").isNotNull() & (F.col("hops") < MAX_HOPS)
    return rows.select(
        "name", F.when(ok, F.col("target")).alias("target"), F.when(ok, F.col("hops")).alias("hops"),
        F.when(ok, F.least("ttl", "_ttl")).alias("ttl"), F.when(ok, F.col("rdata")).alias("rdata"),
    )


NODE = ["zone", "name", "rdclass", "rdtype", "rdata"]


def zone_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """The records that only one side of two versions of zones has, with ``side``."""
    a = old.select(*NODE).distinct().withColumn("_old", F.lit(True))
    b = new.select(*NODE).distinct().withColumn("_new", F.lit(True))
    rows = a.join(b, NODE, "full_outer").where(F.col("_old").isNull() | F.col("_new").isNull())
    return rows.select(*NODE, F.when(F.col("_old").isNull(), "added").otherwise("removed").alias("side"))


SET = ["name", "rdclass", "rdtype"]


def rrsets(records: DataFrame) -> DataFrame:
    """name, rdclass, rdtype, ttl, rdata: the values of each set with its smallest TTL; single types keep the last.

    Values stay rows, so a set of any size is no single cell.
    """
    values = records.groupBy(*SET, "rdata").agg(F.min("ttl").alias("_ttl"), F.max("seq").alias("_seq"))
    sets = values.groupBy(*SET).agg(F.min("_ttl").alias("ttl"), F.max_by("rdata", F.struct("_seq", "rdata")).alias("_last"))
    rows = values.join(sets, SET)
    return rows.where(~F.col("rdtype").isin(SINGLETONS) | (F.col("rdata") == F.col("_last"))).select(*SET, "ttl", "rdata")


def rrset_operation(left: DataFrame, right: DataFrame, operation: str) -> DataFrame:
    """Union or intersection of the sets of two record tables, with the smaller TTL of both.

    Types with one value have the last one of their side; in a union that of ``right`` replaces that of ``left``.
    """
    a, b = (rrsets(side).select(*SET, "rdata") for side in (left, right))
    if operation == "union":
        single = F.col("rdtype").isin(SINGLETONS)
        stay = a.where(~single).unionByName(a.where(single).join(b.select(*SET).distinct(), SET, "left_anti"))
        rows = stay.unionByName(b).distinct()
    else:
        rows = a.intersect(b)
    ttl = left.select(*SET, "ttl").unionByName(right.select(*SET, "ttl")).groupBy(*SET).agg(F.min("ttl").alias("ttl"))
    return rows.join(ttl, SET)


def zone_check(records: DataFrame) -> DataFrame:
    """zone, has_soa, has_ns at the zone's origin."""
    origin = F.col("name") == F.col("zone")
    return records.groupBy("zone").agg(
        F.bool_or(origin & (F.col("rdtype") == "SOA")).alias("has_soa"), F.bool_or(origin & (F.col("rdtype") == "NS")).alias("has_ns")
    )


def canonical_key(column: str):
    """Sort key that orders names label by label from the right, without case."""
    return F.array_join(N.name_labels(F.col(column)), "\x01")


def endpoint_load(transfers: DataFrame) -> DataFrame:
    """endpoint, version, peak, allowed, overloaded: the most connections open at once against the limit."""
    peaks = timeline.peak_overlap(transfers, ["endpoint", "version"], "start_us", "end_us")
    limit = F.when(F.col("version") == "HTTP/1.1", CONNECTIONS["HTTP/1.1"]).otherwise(CONNECTIONS["HTTP/1.0"])
    return peaks.select("endpoint", "version", "peak", limit.alias("allowed"), (F.col("peak") > limit).alias("overloaded"))
