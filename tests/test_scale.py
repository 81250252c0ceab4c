"""Skewed and large inputs: every distributed way gives what the plain way gives."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import dns as D
from millrace.operators import timeline as L
from millrace.operators import verdict as V
from millrace.operators.ranking import with_row_number
from millrace.operators.rules import apply_merge, generate_sids


def entries(spark, rows):
    return spark.createDataFrame([(i, f"s{i}", e) for i, e in enumerate(rows)], "rank int, sid string, entry string")


def test_anchored_substrings_equal_plain(tables, spark):
    listed = entries(spark, ["utm_source", "/fr/8", "a", "example.org/en", "://m.", "nothing-like-it", "com", "page=2&ref=x"])
    rows = tables.requests.select("req_id", "url")
    plain = V.first_substring(rows, "url", listed, "sid").select("req_id", "sid")
    anchored = V.first_substring(rows, "url", listed, "sid", limit=2).select("req_id", "sid")
    assert plain.exceptAll(anchored).count() == 0 and anchored.exceptAll(plain).count() == 0


def test_repeated_keys_nulls_and_empty_entries(spark):
    rows = spark.createDataFrame([(1, "aaaa"), (1, "bbbb"), (None, "xaaaa"), (2, None), (3, "")], "req_id int, url string")
    listed = entries(spark, ["", "aaaa", "b", "cc", "ddd", "eeeee", "ffffff", "ggggggg", "hhhhhhhh", "iiiiiiiii"])
    for limit in (2, 100):
        got = V.first_substring(rows, "url", listed, "sid", limit=limit).collect()
        assert sorted((str(r.req_id), str(r.url), r.sid) for r in got) == [("1", "aaaa", "s1"), ("1", "bbbb", "s2"), ("2", "None", None), ("3", "", None), ("None", "xaaaa", "s1")]
        pairs = V.substring_pairs(rows, "url", listed, limit).collect()
        assert sorted((r.url, r.sid) for r in pairs) == [("aaaa", "s1"), ("bbbb", "s2"), ("xaaaa", "s1")]


def test_long_list_of_entries(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 12)))
    listed = list({word() for _ in range(100_000)})
    urls = [f"http://{word()}.example/{word()}?{word()}" for _ in range(400)] + ["http://hot.example/" + listed[0]] * 200 + [None, ""]
    rows = spark.createDataFrame(list(enumerate(urls)), "req_id int, url string")
    table = entries(spark, listed)
    got = {r.req_id: r.sid for r in V.first_substring(rows, "url", table, "sid").collect()}
    by_size = {}
    for i, e in enumerate(listed):
        by_size.setdefault(len(e), {})[e] = i
    for i, url in enumerate(urls):
        held = [by_size[n][url[a : a + n]] for n in by_size for a in range(len(url or "") - n + 1) if url[a : a + n] in by_size[n]]
        assert got[i] == (f"s{min(held)}" if held else None)


def test_anchored_patterns_equal_plain(tables, spark):
    texts = ["utm_source=f.*d", "https?://blog", "example.net$", "/(en|de)/", "^http://m", "spam-far[m]", "xample.o+rg", "nothing.*here"]
    listed = entries(spark, texts).withColumnRenamed("entry", "pattern")
    rows = tables.requests.select("req_id", "url")
    plain = V.pattern_matches(rows, "req_id", "url", listed)
    anchored = V.pattern_matches(rows, "req_id", "url", listed, limit=2)
    assert plain.count() > 0
    assert plain.exceptAll(anchored).count() == 0 and anchored.exceptAll(plain).count() == 0


def test_literal_anchor(evaluate):
    got = evaluate(["abc.*defgh", "abcd?ef", "longword+x", "(abcd)", "ab.cd", "(?i)abcde", "abcdef$"], V.literal_anchor)
    assert got == ["defgh", None, "longword", None, None, None, "abcdef"]


def test_exempt_hosts_both_ways(tables, spark):
    listed = spark.createDataFrame([(".example.net",), ("spam-farm.example.org",), (".thther.example.org",)], "entry string")
    rows = tables.requests.select("req_id", F.regexp_extract("url", "//([^/]*)", 1).alias("host"))
    a, b = V.exempt_hosts(rows, "host", listed), V.exempt_hosts(rows, "host", listed, limit=1)
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_allow_never_blocks(tables):
    from millrace.plans.verdict_plans import listed, verdicts

    allowed = listed(tables, "allowdomains").select(F.col("entry").alias("host"))
    assert verdicts(tables).where("verdict = 'block'").join(allowed, "host", "left_semi").count() == 0


def test_row_numbers_of_a_hot_group(spark):
    rows = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("g"), (F.col("id") * 7919 % 3001).alias("o"))
    got = with_row_number(rows, ["o"], ["g"], "rn", "n").collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r.g, []).append(r)
    assert len(got) == 3000
    for group in by_group.values():
        group.sort(key=lambda r: r.o)
        assert [r.rn for r in group] == list(range(1, len(group) + 1))
        assert {r.n for r in group} == {len(group)}


def test_row_numbers_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("o"), F.lit("x").alias("extra"))
        ranked = with_row_number(rows, ["o"], total="n")
        got = ranked.orderBy("o").collect()
        assert [r.rn for r in got] == list(range(1, 5001)) and {r.n for r in got} == {5000}
        hot = with_row_number(rows.withColumn("g", F.when(F.col("o") % 3 == 0, F.col("o") % 5).otherwise(99)), ["o"], ["g"]).where("g = 99").orderBy("o").collect()
        assert [r.rn for r in hot] == list(range(1, len(hot) + 1))
        assert with_row_number(rows.limit(0), ["o"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


HOUR_US = 3_600_000_000


def random_lookups(n=2000):
    rng = random.Random(5)
    return [(i, "hot" if rng.random() < 0.4 else f"h{rng.randrange(9)}", rng.randrange(20 * HOUR_US), rng.choice(["found", "found", "error"])) for i in range(n)]


@pytest.mark.parametrize("longest", [100, 500_000])
def test_cache_state_equals_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(L, "ROWS", longest)
    # half of the rows come within a second of a year
    data = random_lookups() + [(5000 + i, "burst", 365 * 24 * HOUR_US + i * 500, "found" if i % 5 else "error") for i in range(2000)]
    got = {r.req_id: r.state for r in D.cache_state(spark.createDataFrame(data, "req_id bigint, host string, at_us bigint, kind string")).collect()}
    last = {}
    for req, host, at, kind in sorted(data, key=lambda r: (r[2], r[0])):
        before = last.get(host)
        state = "miss" if before is None or before[1] != "found" else "hit" if at - before[0] < 1800 * 1_000_000 else "stale"
        assert got[req] == state
        last[host] = (at, kind)


@pytest.mark.parametrize("longest", [100, 500_000])
def test_peak_overlap_equals_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(L, "ROWS", longest)
    rng = random.Random(6)
    spans = []
    for i in range(800):
        start = rng.randrange(10 * HOUR_US)
        spans.append(("hot" if i % 2 else f"e{i % 5}", start, start + rng.randrange(3 * HOUR_US)))
    got = {r.k: r.peak for r in L.peak_overlap(spark.createDataFrame(spans, "k string, s bigint, e bigint"), ["k"], "s", "e").collect()}
    for key in {s[0] for s in spans}:
        own = [s for s in spans if s[0] == key]
        assert got[key] == max(sum(1 for _, s, e in own if s <= t < e) for _, t, _ in own)


def test_alias_chains(spark):
    chain = [(f"n{i}", "CNAME", f"n{i + 1}", 100 - i, i) for i in range(20)] + [("n20", "A", "1.2.3.4", 500, 99)]
    loop = [("l1", "CNAME", "l2", 5, 1), ("l2", "CNAME", "l1", 5, 2)]
    records = spark.createDataFrame(chain + loop, "name string, rdtype string, rdata string, ttl bigint, seq int")
    got = {r.name: r for r in D.chase_aliases(records).collect()}
    # fourteen aliases and the answer are fifteen steps
    assert got["n6"].hops == 14 and got["n6"].rdata == "1.2.3.4" and got["n6"].ttl == 81
    assert got["n5"].rdata is None and got["l1"].rdata is None
    assert got["n19"].hops == 1


def test_networks_with_many_masks(spark):
    rows = spark.createDataFrame([("10.0.0.5",), ("10.0.1.9",), ("11.0.0.1",), ("host",), ("10.7.5.3",), ("10.7.9.3",)], "ip string")
    nets = [("10.0.0.0/24",), ("11.0.0.1",), ("10.0.1.8/30",), ("10.0.5.0/255.0.255.0",)]
    many = nets + [(f"192.168.0.0/255.{i}.{j}.0",) for i in range(8) for j in range(16)]
    for entries in (nets, many):
        got = D.in_networks(rows, "ip", spark.createDataFrame(entries, "entry string")).collect()
        assert sorted(r.ip for r in got) == ["10.0.0.5", "10.0.1.9", "10.7.5.3", "11.0.0.1"]


def test_generated_ids_are_fresh(tables):
    rules = tables.rules.select("k", "sid")
    made = generate_sids(rules)
    assert made.count() == rules.where("sid IS NULL").count() == made.select("sid").distinct().count()
    assert made.join(rules.where("sid IS NOT NULL"), "sid", "left_semi").count() == 0


def test_merge_applied(spark):
    schema = "sid string, kind string, url string, mime string, title_en string, title_de string"
    current = spark.createDataFrame([("wc.1", "block", "a", None, "T", "D"), ("lc.9", "allow", "l", None, "L", None)], schema)
    new = spark.createDataFrame([("wc.1", "block", "b", None, "T2", None), ("wc.2", "allow", "c", None, "N", None), ("lc.9", "x", "x", None, "x", None)], schema)
    got = {r.sid: (r.url, r.title_en, r.title_de) for r in apply_merge(current, new).collect()}
    assert got == {"wc.1": ("b", "T2", "D"), "wc.2": ("c", "N", None), "lc.9": ("l", "L", None)}


def test_row_numbers_with_nulls(spark):
    rows = spark.createDataFrame([(1, None), (1, 5), (1, 3), (2, None), (None, 7)], "g int, o int")
    got = sorted((str(r.g), str(r.o), r.rn) for r in with_row_number(rows, ["o"], ["g"]).collect())
    assert got == [("1", "3", 2), ("1", "5", 3), ("1", "None", 1), ("2", "None", 1), ("None", "7", 1)]


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from millrace.session import shared_dir

    class Named:
        def __init__(self, master):
            self.master, self.conf, self.sparkContext, self.applicationId = master, self, self, "app"

        def get(self, *args):
            return None

        def set(self, *args):
            pass

        def getConf(self):
            return self

    with pytest.raises(RuntimeError):
        shared_dir(Named("spark://host:7077"))
    assert shared_dir(Named("local[4]"))


def test_entities_and_long_header_names(spark, evaluate):
    from millrace.functions.text import resolve_entities
    from millrace.operators.ratings import from_headers

    assert evaluate(["&#128512;&#x1F600;&#65;", "&#1114112;&#xD800;"], resolve_entities) == ["😀😀A", ""]
    headers = F.array(F.struct(F.lit("X-Rating-" + "n" * 130).alias("name"), F.lit("v").alias("value")))
    assert spark.range(1).select(from_headers(headers)[0]["name"]).first()[0] == "n" * 130


def test_sets_with_one_value(spark):
    schema = "name string, rdclass string, rdtype string, rdata string, ttl long, seq int"
    left = spark.createDataFrame([("a", "IN", "SOA", "old", 9, 1), ("a", "IN", "SOA", "older", 8, 0), ("a", "IN", "A", "1", 5, 2), ("b", "IN", "SOA", "x", 4, 3)], schema)
    right = spark.createDataFrame([("a", "IN", "SOA", "new", 7, 1), ("a", "IN", "A", "2", 6, 2), ("b", "IN", "SOA", "x", 3, 3)], schema)
    union = sorted((r.name, r.rdtype, r.rdata, r.ttl) for r in D.rrset_operation(left, right, "union").collect())
    assert union == [("a", "A", "1", 5), ("a", "A", "2", 5), ("a", "SOA", "new", 7), ("b", "SOA", "x", 3)]
    both = sorted((r.name, r.rdtype, r.rdata) for r in D.rrset_operation(left, right, "intersection").collect())
    assert both == [("b", "SOA", "x")]


@pytest.mark.parametrize("longest", [7, 500_000])
def test_looking_ahead_reads_no_frame_anew(spark, monkeypatch, longest):
    """A frame to the end of a line is read again for each row: quadratic in the rows of a host."""
    monkeypatch.setattr(L, "ROWS", longest)
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "a", "b", None]), rng.randrange(40), rng.choice([None, None, k])) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, host string, at int, mark int")
    ahead = L.beside(df, "host", ["at", "id"], {"next": F.col("mark")}, after=True)
    assert "unboundedfollowing" not in ahead._jdf.queryExecution().toString().lower()
    line = sorted(rows, key=lambda r: (r[2], r[0]))
    want = {r[0]: next((x[3] for x in line[n + 1 :] if x[1] == r[1] and x[3] is not None), None) for n, r in enumerate(line)}
    assert {r.id: r.next for r in ahead.collect()} == want
