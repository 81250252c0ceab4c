"""Rule catalogues: activation, order, ids, merging, and which rule applies where."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.rules import applies_to_mime, applies_to_url, handler_takes_mime
from millrace.operators.ranking import with_row_number
from millrace.policy import Handler, ScopedRule

# Kinds of rules that make sense once only.
SINGLE_KINDS = ["javascript", "rating", "antivirus", "nocomments"]
MERGED_ATTRS = ["kind", "url", "mime"]
MERGED_TITLES = ["title_en", "title_de"]


def active(rules: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Rules that are enabled, in enabled folders and of an enabled kind."""
    rows = rules.where(~F.col("disable") & ~F.col("folder_disable"))
    return rows if kinds is None else rows.where(F.col("kind").isin(list(kinds)))


def ordered(rules: DataFrame) -> DataFrame:
    """oid counted per folder, and whether a rule can move up or down."""
    rows = with_row_number(rules, ["k"], ["folder_sid"], "rn", "total")
    return rows.select(
        "folder_sid", "k", (F.col("rn") - 1).alias("oid"), (F.col("rn") > 1).alias("up"), (F.col("rn") < F.col("total")).alias("down")
    )


def generate_sids(rules: DataFrame, prefix: str = "wc") -> DataFrame:
    """k, sid for the rules without id: the lowest unused numbers, in rule order."""
    missing = with_row_number(rules.where(F.col("sid").isNull()).select("k"), ["k"])
    used = rules.select(F.regexp_extract("sid", rf"^{prefix}[.]([0-9]+)$", 1).try_cast("bigint").alias("n"))
    used = used.where(F.col("n").isNotNull()).distinct()
    need = rules.agg(F.count_if(F.col("sid").isNull()).alias("m"), F.count("sid").alias("u")).first()
    free = rules.sparkSession.range(1, need.m + need.u + 1).toDF("n").join(used, "n", "left_anti")
    numbered = with_row_number(free, ["n"])
    return missing.join(numbered, "rn").select("k", F.concat(F.lit(prefix + "."), F.col("n").cast("string")).alias("sid"))


def merge_changes(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """sid, change, field, old, new for what the incoming rules would change; only ids starting with wc count.

    An attribute changes to whatever comes in; a title only when the incoming rule has one.
    """
    fields = MERGED_ATTRS + MERGED_TITLES
    new = incoming.where(F.startswith("sid", F.lit("wc"))).select("sid", *[F.col(f).alias("new_" + f) for f in fields])
    old = current.where(F.col("sid").isNotNull()).select(F.col("sid").alias("old_sid"), *[F.col(f).alias("old_" + f) for f in fields])
    rows = new.join(old, F.col("sid") == F.col("old_sid"), "left")
    known = F.col("old_sid").isNotNull()

    def row(when: Column, change: str, field: str, before: Column, after: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(change).alias("change"), F.lit(field).alias("field"), before.alias("old"), after.alias("new")))

    none = F.lit(None).cast("string")
    changes = [row(~known, "insert", "", none, none)]
    for f in MERGED_ATTRS:
        o, n = F.col("old_" + f), F.col("new_" + f)
        changes.append(row(known & ~o.eqNullSafe(n), "attr", f, o, n))
    for f in MERGED_TITLES:
        o, n = F.col("old_" + f), F.col("new_" + f)
        changes.append(row(known & n.isNotNull() & ~o.eqNullSafe(n), "title", f, F.coalesce(o, F.lit("")), n))
    return rows.select("sid", F.inline(F.array_compact(F.array(*changes))))


def apply_merge(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The catalogue after the merge: sid and the merged fields."""
    new = incoming.where(F.startswith("sid", F.lit("wc"))).select("sid", F.lit(True).alias("_in"), *[F.col(f).alias("new_" + f) for f in MERGED_ATTRS + MERGED_TITLES])
    old = current.select("sid", *MERGED_ATTRS, *MERGED_TITLES)
    rows = old.join(new, "sid", "full_outer")
    attrs = [F.when(F.col("_in"), F.col("new_" + f)).otherwise(F.col(f)).alias(f) for f in MERGED_ATTRS]
    titles = [F.coalesce("new_" + f, f).alias(f) for f in MERGED_TITLES]
    return rows.select("sid", *attrs, *titles)


def matrix(pairs: DataFrame, handlers: Sequence[Handler], stages: Sequence[str], rules: Sequence[ScopedRule]) -> DataFrame:
    """url, mime, stage, handler, applies, reason, sid, rule_applies, rule_reason for every pair.

    The rules are part of the expression, so a pair turns into its rows without any join.
    """
    url, mime = F.col("url"), F.col("mime")
    entries = []
    for stage in stages:
        for handler in handlers:
            at_stage = stage in handler.stages
            takes = handler_takes_mime(mime, handler.mimes)
            reason = F.when(takes, "").otherwise("mime") if at_stage else F.lit("stage")
            own = sorted((r for r in rules if r.handler == handler.name), key=lambda r: (r.folder_oid, r.oid))
            for rule in own or [None]:
                if rule is None:
                    sid, why = F.lit(None).cast("string"), F.lit(None).cast("string")
                else:
                    sid = F.lit(rule.sid)
                    why = F.when(~applies_to_url(url, rule.matchurls, rule.nomatchurls), "url").when(
                        ~applies_to_mime(mime, rule.mimes), "mime").otherwise("")
                entries.append(F.struct(
                    F.lit(stage).alias("stage"), F.lit(handler.name).alias("handler"), (reason == "").alias("applies"),
                    reason.alias("reason"), sid.alias("sid"), (why == "").alias("rule_applies"), why.alias("rule_reason")))
    return pairs.select("url", "mime", F.inline(F.array(*entries)))


def localised(texts: Column, lang: str) -> Column:
    """Text in a language, else in English, else in any language, else empty."""
    return F.coalesce(F.try_element_at(texts, F.lit(lang)), F.try_element_at(texts, F.lit("en")), F.get(F.map_values(texts), F.lit(0)), F.lit(""))
