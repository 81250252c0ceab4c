"""Allow/block verdicts: exact domains, URL substrings and patterns, allow before block."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.functions.let import let
from millrace.functions.rules import first_pattern
from millrace.policy import PatternRule
from millrace.session import written

# Up to this many entries a substring list is folded into the expression; beyond it the anchor join runs.
FOLD_LIMIT = 2000
GRAM = 8


def domain_hits(df: DataFrame, entries: DataFrame, out: str) -> DataFrame:
    """Left join the first sid per listed domain as ``out``; ``entries`` holds (sid, entry).

    The list side is one row per domain, so a hot host never multiplies rows; Catalyst broadcasts it
    when its size is below the threshold and AQE splits a hot host in a sort-merge join otherwise.
    """
    policy = entries.groupBy(F.col("entry").alias("_host")).agg(F.min("sid").alias(out))
    return df.join(policy, F.col("host") == F.col("_host"), "left").drop("_host")


def substring_hits(url: Column, entries: Sequence[tuple[str, str]]) -> Column:
    """First (sid, entry) contained in the URL, in list order: struct or null."""
    table = F.array(*[F.struct(F.lit(s).alias("sid"), F.lit(e).alias("entry")) for s, e in entries])
    return F.get(F.filter(table, lambda r: F.contains(url, r["entry"])), F.lit(0))


def bounded_rows(entries: DataFrame, limit: int = FOLD_LIMIT) -> list[tuple[str, str]] | None:
    """The (sid, entry) rows in rank order when there are at most ``limit``, else None; empty entries match nothing and are left out."""
    rows = entries.where(F.length("entry") > 0).select("rank", "sid", "entry").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return [(r.sid, r.entry) for r in sorted(rows, key=lambda r: r.rank)]


def bounded_lists(lists: Sequence[DataFrame], limit: int = FOLD_LIMIT) -> list[list[tuple[str, str]] | None]:
    """``bounded_rows`` of several lists, read in one job."""
    parts = [e.where(F.length("entry") > 0).select(F.lit(i).alias("i"), "rank", "sid", "entry").limit(limit + 1) for i, e in enumerate(lists)]
    rows = reduce(DataFrame.unionByName, parts).collect()
    own = [[r for r in rows if r.i == i] for i in range(len(lists))]
    return [None if len(o) > limit else [(r.sid, r.entry) for r in sorted(o, key=lambda r: r.rank)] for o in own]


def first_substring(df: DataFrame, text: str, entries: DataFrame, out: str, limit: int = FOLD_LIMIT) -> DataFrame:
    """Add ``out``: sid of the first entry (lowest rank) contained in ``text``; null when none.

    A short list becomes an array literal, tested without any shuffle. A long one is anchored: each
    entry is looked up by the rarest of its grams in an equi-join of hashes, and the candidates are
    verified. Both ways give the same rows.
    """
    return first_of(df, text, entries, bounded_rows(entries, limit), out)


def first_of(df: DataFrame, text: str, entries: DataFrame, rows: list[tuple[str, str]] | None, out: str) -> DataFrame:
    """``first_substring`` with the rows of the list where it is short."""
    if rows is not None:
        return df.withColumn(out, substring_hits(F.col(text), rows)["sid"] if rows else F.lit(None).cast("string"))
    best = anchored_substrings(df, text, entries).groupBy(text).agg(F.min_by("sid", "rank").alias(out))
    best = written(best.select(*_id(F.col(text)), F.col(text).alias("_text"), out), "hits")
    known = df.select("*", *_id(F.col(text)))
    may_hit = filter_of(best, "_a")(F.col("_a"))
    # rows without a hit stay where they are
    hit = known.where(may_hit).join(best, (known["_a"] == best["_a"]) & (known["_b"] == best["_b"]) & (F.col(text) == F.col("_text")), "left")
    rest = known.where(~may_hit).select(*df.columns, F.lit(None).cast("string").alias(out))
    return hit.select(*df.columns, out).unionByName(rest)


def substring_pairs(df: DataFrame, text: str, entries: DataFrame, limit: int = FOLD_LIMIT) -> DataFrame:
    """text, sid of every entry contained in a distinct text, the same two ways."""
    rows = bounded_rows(entries, limit)
    if rows is None:
        return anchored_substrings(df, text, entries).select(text, "sid")
    table = F.array(*[F.struct(F.lit(s).alias("sid"), F.lit(e).alias("entry")) for s, e in rows]) if rows else F.expr("cast(array() as array<struct<sid:string,entry:string>>)")
    texts = df.select(text).distinct()
    return texts.select(text, F.inline(F.filter(table, lambda r: F.contains(F.col(text), r["entry"])))).select(text, "sid")


def filter_of(hashes: DataFrame, name: str, least: int = 1 << 14, most: int = 1 << 23):
    """A Bloom filter of a column of hashes: a function that says of a hash column whether it may be among them.

    About sixteen bits for each hash, a megabyte at most; with more hashes it lets more through, nothing is lost. The
    bits are made in Spark and stand in the plan as the value of a subquery, so rows are tested where they are read.
    """
    wanted = hashes.select(F.col(name).alias("h")).distinct()
    size = least
    held = wanted.count()
    while size < min(most, held * 16):
        size *= 2
    places = lambda h: [F.pmod(h, F.lit(size)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(size))]
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))
    marks = wanted.select(F.explode(F.array(*places(F.col("h")))).alias("p"))
    words = marks.groupBy(F.floor(F.col("p") / 64).alias("id")).agg(F.bit_or(bit(F.col("p"))).alias("bits"))
    every = hashes.sparkSession.range(size // 64).join(words, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    table = every.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"])).scalar()

    def may_hold(h: Column) -> Column:
        inside = [F.get(table, F.floor(p / 64).cast("int")).bitwiseAND(bit(p)) != 0 for p in places(h)]
        return inside[0] & inside[1]

    return may_hold


def _grams(text: Column, size: Column) -> Column:
    """Hashes of the distinct substrings of the given length."""
    last = F.length(text) - size + 1
    cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(text.substr(i, size)))
    return F.array_distinct(F.when(last >= 1, cut).otherwise(F.array().cast("array<bigint>")))


def _id(text: Column) -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b")]


def anchored_substrings(df: DataFrame, text: str, entries: DataFrame) -> DataFrame:
    """text, rank, sid with the entry contained in the text, for distinct texts, through an equi-join on anchor grams.

    Only hashes travel: grams that a Bloom filter of the list's grams rules out are dropped where the texts are read; of
    each entry the gram that is rarest in the texts is its anchor; texts that share an anchor with an entry are fetched
    by their hashes (others are ruled out by a filter again) and verified.
    """
    texts = df.select(text).where(F.length(text) > 0)
    sized = entries.where(F.length("entry") > 0).select("rank", "sid", "entry", F.least(F.length("entry"), F.lit(GRAM)).alias("size"))
    candidates = sized.select("rank", "sid", "entry", "size", F.explode(_grams(F.col("entry"), F.col("size"))).alias("gram"))
    used = [r.size for r in sized.select("size").distinct().collect()]  # 1 to GRAM
    if not used:
        return df.sparkSession.createDataFrame([], df.select(text).schema).crossJoin(sized.select("rank", "sid").limit(0))
    lengths = F.array(*[F.lit(int(n)) for n in sorted(used)])
    grams = F.flatten(F.transform(lengths, lambda n: _grams(F.col(text), n)))

    def kept_grams(may_hold) -> DataFrame:
        return texts.select(*_id(F.col(text)), F.explode(grams).alias("gram")).where(may_hold(F.col("gram")))

    # how often each candidate gram occurs; counted before it is shuffled
    frequency = kept_grams(filter_of(candidates, "gram")).groupBy("gram").count()
    anchors = (
        candidates.join(frequency, "gram")
        .groupBy("rank", "sid", "entry")
        .agg(F.min_by("gram", F.struct("count", "gram")).alias("gram"))
    )
    anchors = written(anchors, "anchors")
    near = kept_grams(filter_of(anchors, "gram")).distinct().join(anchors, "gram").select("_a", "_b", "rank", "sid", "entry")
    near = written(near, "near")
    fetched = texts.select(*_id(F.col(text)), text).where(filter_of(near, "_a")(F.col("_a"))).distinct()
    return fetched.join(near, ["_a", "_b"]).where(F.contains(F.col(text), F.col("entry"))).select(text, "rank", "sid")


def literal_anchor(pattern: Column, minimum: int = 4) -> Column:
    """A text that every match of the pattern must contain, or null when that is not certain.

    Patterns with groups, classes, alternatives, counts or escapes get none. Of the others the longest
    run between optional characters, wildcards and line anchors is taken.
    """
    runs = F.split(pattern, r".[*?]|[.^$+]")
    sized = F.array_sort(F.transform(runs, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r"))))
    longest = F.get(sized, F.lit(0))["r"]
    return F.when(~pattern.rlike(r"[|()\[\]{}\\]") & (F.length(longest) >= minimum), longest)


def pattern_matches(df: DataFrame, key: str, text: str, patterns: DataFrame, limit: int = 200) -> DataFrame:
    """All (key, rank, sid) whose pattern is found in the text; ``patterns`` holds (rank, sid, pattern).

    A short list is folded into the expression, each pattern compiled once. Of a long one the patterns
    with an anchor meet the texts in an equi-join on the anchor and are verified; only the others are
    compared with every text.
    """
    rows = patterns.select("rank", "sid", "pattern").limit(limit + 1).collect()
    if len(rows) <= limit:
        hits = [F.when(F.col(text).rlike(r.pattern), F.struct(F.lit(r.rank).alias("rank"), F.lit(r.sid).alias("sid"))) for r in rows]
        return df.select(key, F.inline(F.array_compact(F.array(*hits))))
    anchored = patterns.withColumn("entry", literal_anchor(F.col("pattern")))
    sure = anchored.where(F.col("entry").isNotNull())
    near = anchored_substrings(df, text, sure).join(sure.select("rank", "sid", "pattern"), ["rank", "sid"])
    verified = near.where(F.expr(f"{text} rlike pattern")).join(df.select(key, text), text).select(key, "rank", "sid")
    loose = anchored.where(F.col("entry").isNull()).select("rank", "sid", "pattern")
    compared = df.select(key, text).join(loose, F.expr(f"{text} rlike pattern")).select(key, "rank", "sid")
    return verified.unionByName(compared)


def exempt_hosts(df: DataFrame, host: str, entries: DataFrame, limit: int = FOLD_LIMIT) -> DataFrame:
    """The rows whose host equals an entry, or ends in an entry that starts with a dot.

    A short list is tested in place. With a long one the host and its dotted suffixes meet the entries
    in an equi-join, for distinct hosts only.
    """
    rows = entries.select("entry").limit(limit + 1).collect()
    if len(rows) <= limit:
        table = F.array(*[F.lit(r.entry) for r in rows]).cast("array<string>")
        suffix = lambda e: F.startswith(e, F.lit(".")) & F.endswith(F.col(host), e)
        return df.where(F.exists(table, lambda e: (e == F.col(host)) | suffix(e)))
    hosts = df.select(F.col(host).alias("_host")).distinct()
    labels = F.split("_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("."), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")),
    )
    forms = hosts.select("_host", F.explode(F.array_append(suffixes, F.col("_host"))).alias("entry"))
    found = forms.join(entries.select("entry").distinct(), "entry", "left_semi").select("_host").distinct()
    return df.join(found, df[host] == found["_host"], "left_semi")


def url_verdict(
    df: DataFrame,
    allow_domains: DataFrame,
    block_domains: DataFrame,
    allow_urls: DataFrame,
    block_urls: DataFrame,
    allow_patterns: Sequence[PatternRule],
    block_patterns: Sequence[PatternRule],
    port: int = 8080,
) -> DataFrame:
    """Add verdict, list_class, sid and document to rows with ``url`` and ``mime``.

    Domain lists hold (sid, entry), URL lists (rank, sid, entry). Domains join, and so do long URL lists;
    short ones and patterns are tested in place, cheapest first.
    """
    url = F.col("url")
    allowed, blocked = bounded_lists([allow_urls, block_urls])
    rows = first_of(first_of(df, "url", allow_urls, allowed, "_allow_url"), "url", block_urls, blocked, "_block_url")
    rows = rows.withColumn("host", U.host(url))
    rows = domain_hits(domain_hits(rows, allow_domains, "_allow"), block_domains, "_block")

    def decision(verdict: str, domain: str, listed: str, patterns) -> list[tuple[Column, Column]]:
        def value(kind: str, sid: Column, replacement: Column | None = None) -> Column:
            return F.struct(
                F.lit(verdict).alias("verdict"), F.lit(kind).alias("list_class"), sid.alias("sid"),
                (replacement if replacement is not None else F.lit(None).cast("string")).alias("replacement"),
            )

        by_pattern = let(
            first_pattern(url, patterns),
            lambda p: F.when(p.isNotNull(), value("pattern", p["sid"], p["replacement"])),
        )
        return [
            F.when(F.col(domain).isNotNull(), value("domain", F.col(domain))),
            F.when(F.col(listed).isNotNull(), value("url", F.col(listed))),
            by_pattern,
        ]

    nothing = F.struct(
        F.lit("pass").alias("verdict"), F.lit("").alias("list_class"),
        F.lit(None).cast("string").alias("sid"), F.lit(None).cast("string").alias("replacement"),
    )
    steps = decision("allow", "_allow", "_allow_url", allow_patterns) + decision("block", "_block", "_block_url", block_patterns)
    rows = rows.withColumn("_d", F.coalesce(*steps, nothing)).withColumn("media", U.media_class(url, F.coalesce("mime", F.lit("text/html"))))
    local = F.lit(f"http://localhost:{port}")
    stand_in = (
        F.when(F.col("media") == "image", "/blocked.png")
        .when(F.col("media") == "flash", "/blocked.swf")
        .when(F.col("media") == "javascript", "/blocked.js")
        .otherwise(F.concat(F.lit("/blocked.html?rule="), F.col("_d.sid"), F.lit("&blockurl="), U.quote_plus(url)))
    )
    doc = F.coalesce(F.col("_d.replacement"), stand_in)
    doc = F.when(F.startswith(doc, F.lit("http://")), doc).otherwise(F.concat(local, doc))
    return rows.select(
        *df.columns, "host", "media", "_d.verdict", "_d.list_class", "_d.sid",
        F.when(F.col("_d.verdict") == "block", doc).alias("document"),
    )
