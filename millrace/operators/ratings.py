"""Rating tables: lookup by longest prefix, check against limits, merge, decision."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import ratings as R
from millrace.functions import urls as U
from millrace.functions.let import let
from millrace.operators import headers as A
from millrace.operators import html as M


def lookup(urls: DataFrame, ratings: DataFrame) -> DataFrame:
    """The url rows with ``rating``: the stored rating of the longest prefix, null when there is none.

    Only distinct URLs are taken apart and joined, so a URL asked for by a third of all rows counts once.
    """
    stored = ratings.select(F.col("url").alias("prefix"), F.struct(*ratings.columns).alias("r"))
    safe = urls.select("url").distinct().select("url", U.rating_safe(F.col("url")).alias("safe"))
    prefixes = safe.select("url", F.explode(U.rating_prefixes(F.col("safe"))).alias("prefix"))
    best = prefixes.join(stored, "prefix").groupBy("url").agg(F.max_by("r", F.length("prefix")).alias("rating"))
    return urls.join(best, "url", "left")


def check(values: Mapping[str, Column], limits: Mapping[str, Mapping[str, str]]) -> Column:
    """array<struct<sid,allowed,reason>>, one entry per limit rule."""
    entries = []
    for sid, limit in limits.items():
        entries.append(F.struct(F.lit(sid).alias("sid"), R.deny_reason(dict(values), dict(limit)).alias("reason")))
    return F.transform(
        F.array(*entries),
        lambda e: F.struct(e["sid"].alias("sid"), e["reason"].isNull().alias("allowed"), e["reason"].alias("reason")),
    )


def columns(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in R.CATEGORIES}


def with_defaults(ratings: DataFrame) -> DataFrame:
    """Missing limits become the strictest ones; ranges are parsed into age_min and age_max."""
    age = F.when(F.col("age").isNull(), F.struct(F.lit(None).cast("int").alias("lo"), F.lit(0).alias("hi"))).otherwise(
        R.parse_range(F.col("age"))
    )
    degrees = [F.coalesce(c, F.lit(R.DEGREES[0])).alias(c) for c in R.ORDINAL]
    return ratings.select("url", age["lo"].alias("age_min"), age["hi"].alias("age_max"), *degrees)


def merge(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Of every URL the rating modified last; the incoming one wins a tie."""
    both = store.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = F.max_by(F.struct(*[c for c in store.columns if c != "url"]), F.struct("modified", "_new"))
    return both.groupBy("url").agg(newest.alias("r")).select("url", "r.*")


def long_form(ratings: DataFrame) -> DataFrame:
    """url, category, value for every value present."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("value")) for c in R.CATEGORIES])
    return ratings.select("url", F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


def from_headers(headers: Column) -> Column:
    """array<struct<name,value>> of the X-Rating-* headers, names in lower case without the prefix."""
    own = F.filter(headers, lambda h: F.startswith(F.lower(h["name"]), F.lit("x-rating-")))
    return F.transform(own, lambda h: F.struct(F.substr(F.lower(h["name"]), F.lit(10)).alias("name"), h["value"].alias("value")))


def from_meta(pages: DataFrame) -> DataFrame:
    """page_id, name, value of the rating meta tags; the service itself has the empty name."""
    metas = M.meta_tags(pages).where(F.startswith(F.lower("name"), F.lit("x-rating")))
    return metas.select(
        "page_id", "pos", F.regexp_replace(F.lower("name"), "^x-rating-?", "").alias("name"), F.coalesce("content", F.lit("")).alias("value")
    )


def page_values(pages: DataFrame) -> DataFrame:
    """One row per page that names the rating service in its meta tags, with a column per category."""
    rows = from_meta(pages).groupBy("page_id")
    aggs = [F.max_by(F.when(F.col("name") == c, F.col("value")), F.when(F.col("name") == c, F.col("pos"))).alias(c) for c in R.CATEGORIES]
    service = F.max_by(F.when(F.col("name") == "", F.col("value")), F.when(F.col("name") == "", F.col("pos"))).alias("service")
    return rows.agg(service, *aggs).where(F.col("service") == R.SERVICE).drop("service")


def decide(messages: DataFrame, ratings: DataFrame, pages: DataFrame, limits: Mapping[str, str]) -> DataFrame:
    """req_id, source, allowed, reason: the store decides first, then headers, then the page, else deny."""
    service = A.last_value(F.col("response"), "x-rating")

    def header(c: str) -> Column:
        own = F.filter(from_headers(F.col("response")), lambda r: r["name"] == c)
        return F.try_element_at(own, F.lit(-1))["value"]

    rows = lookup(messages.select("req_id", "url", "page_id", (service == R.SERVICE).alias("by_header"), *[header(c).alias("h_" + c) for c in R.CATEGORIES]), ratings)
    page = page_values(pages).select("page_id", F.lit(True).alias("by_page"), *[F.col(c).alias("p_" + c) for c in R.CATEGORIES])
    rows = rows.join(page, "page_id", "left")
    source = (
        F.when(F.col("rating").isNotNull(), "store").when(F.col("by_header"), "header").when(F.col("by_page"), "page").otherwise("none")
    )
    chosen = {
        c: F.when(F.col("source") == "store", F.col("rating")[c]).when(F.col("source") == "header", F.col("h_" + c)).when(
            F.col("source") == "page", F.col("p_" + c))
        for c in R.CATEGORIES
    }
    rows = rows.withColumn("source", source)
    values = F.struct(*[v.alias(c) for c, v in chosen.items()])
    denied = let(values, lambda v: R.deny_reason({c: v[c] for c in R.CATEGORIES}, dict(limits)))
    reason = F.when(F.col("source") == "none", "no rating data").otherwise(denied)
    return rows.select("req_id", "source", reason.alias("reason")).select(
        "req_id", "source", F.col("reason").isNull().alias("allowed"), "reason"
    )
