"""From loaded rule rows to the typed rules that the operators take, and from typed rules to folder files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.feeds import FeedRule
from millrace.policy import DEFAULT_MINIMAL_SIZE, DEFAULT_QUALITY, HeaderRule, ImageRule, PatternRule, QualityRule, RatingRule, ScopedRule, TagRule, TextRule

# The handler that takes rules of a kind.
HANDLER_OF = {
    "allow": "Blocker", "allowdomains": "Blocker", "allowurls": "Blocker", "block": "Blocker", "blockdomains": "Blocker", "blockurls": "Blocker",
    "header": "Header", "htmlrewrite": "HtmlRewriter", "imagereduce": "ImageReducer", "rating": "Rating", "replace": "Replacer", "xmlrewrite": "XmlRewriter",
}


@dataclass(frozen=True)
class RuleSet:
    """Enabled rules by kind, in order of folder and place."""

    allow_patterns: tuple[PatternRule, ...] = ()
    block_patterns: tuple[PatternRule, ...] = ()
    header_rules: tuple[HeaderRule, ...] = ()
    text_rules: tuple[TextRule, ...] = ()
    tag_rules: tuple[TagRule, ...] = ()
    image_rules: tuple[ImageRule, ...] = ()
    quality_rules: tuple[QualityRule, ...] = ()
    rating_rules: tuple[RatingRule, ...] = ()
    feed_rules: tuple[FeedRule, ...] = ()

    def limits(self) -> dict[str, dict[str, str]]:
        """Rating limits by rule."""
        return {r.sid: dict(r.limits) for r in self.rating_rules}


def enabled_rows(rules: DataFrame, limit: int) -> list:
    """The enabled rules in order of folder and place, on the driver; more than ``limit`` are an error."""
    rows = rules.where(~F.col("disable") & ~F.col("folder_disable")).orderBy("folder_oid", "folder_sid", "oid").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rules")
    return rows


def compile_scopes(rules: DataFrame, limit: int = 10_000) -> tuple[ScopedRule, ...]:
    """The enabled rules of ``parse_folders`` with their handler, place and scopes, whatever else they do."""
    return tuple(
        ScopedRule(r.sid, r.folder_oid, r.oid, HANDLER_OF[r.kind], tuple(r.mimes), tuple(r.matchurls), tuple(r.nomatchurls))
        for r in enabled_rows(rules, limit) if r.kind in HANDLER_OF
    )


def compile_rules(rules: DataFrame, limit: int = 10_000) -> RuleSet:
    """The enabled rules of ``parse_folders`` as typed rules, to be folded into expressions.

    They are read on the driver, so a set of more than ``limit`` rules is an error: lists of domains and URLs are
    tables and are joined instead.
    """
    rows = enabled_rows(rules, limit)
    text = lambda v: v or ""
    of = lambda *kinds: [r for r in rows if r.kind in kinds]
    scope = lambda r: {"matchurls": tuple(r.matchurls), "nomatchurls": tuple(r.nomatchurls)}
    return RuleSet(
        tuple(PatternRule(r.sid, r.url) for r in of("allow")),
        tuple(PatternRule(r.sid, r.url, text(r.replacement)) for r in of("block")),
        tuple(HeaderRule(r.sid, r.action or "add", text(r.name), text(r.replacement), r.filterstage or "both", tuple(r.matchurls)) for r in of("header")),
        tuple(TextRule(r.sid, text(r.search), text(r.replacement), tuple(r.mimes), **scope(r)) for r in of("replace")),
        tuple(
            TagRule(r.sid, r.tag or "a", r.part or "complete", tuple((a.name, a.pattern) for a in r.attrs), text(r.replacement), text(r.content), **scope(r))
            for r in of("htmlrewrite")
        ),
        tuple(ImageRule(r.sid, r.width, r.height, tuple(x for x in text(r.formats).split(",") if x)) for r in of("image")),
        tuple(
            QualityRule(r.sid, DEFAULT_QUALITY if r.quality is None else r.quality, DEFAULT_MINIMAL_SIZE if r.minimal_size_bytes is None else r.minimal_size_bytes, **scope(r))
            for r in of("imagereduce")
        ),
        tuple(RatingRule(r.sid, tuple((x.name, x.value) for x in r.limits), **scope(r)) for r in of("rating")),
        tuple(FeedRule(r.sid, text(r.selector), r.replacetype or "rsshtml", **scope(r)) for r in of("xmlrewrite")),
    )


def element(kind: str, attrs: dict[str, object], children: Sequence[tuple[str, dict[str, object], str]]) -> str:
    told = lambda pairs: "".join(f" {k}={quoteattr(str(v))}" for k, v in pairs.items() if v not in (None, ""))
    inner = "".join(f"<{name}{told(own)}>{escape(text)}</{name}>" for name, own, text in children)
    return f"<{kind}{told(attrs)}>{inner}</{kind}>"


def rule_xml(rule, kind: str) -> str:
    """One typed rule as an element of a folder file."""
    attrs: dict[str, object] = {"sid": rule.sid}
    children: list[tuple[str, dict[str, object], str]] = [("title", {"lang": "en"}, rule.sid)]
    children += [(n, {}, v) for n, many in (("matchurl", "matchurls"), ("nomatchurl", "nomatchurls"), ("mime", "mimes")) for v in getattr(rule, many, ())]
    if isinstance(rule, PatternRule):
        attrs["url"] = rule.pattern
        children += [("replacement", {}, rule.replacement)] if rule.replacement else []
    elif isinstance(rule, HeaderRule):
        attrs |= {"name": rule.header, "action": rule.action, "filterstage": rule.filterstage}
        children += [("replacement", {}, rule.value)] if rule.value else []
    elif isinstance(rule, TextRule):
        attrs["search"] = rule.search
        children += [("replacement", {}, rule.replace)] if rule.replace else []
    elif isinstance(rule, TagRule):
        attrs["tag"] = rule.tag
        children += [("attr", {"name": n}, p) for n, p in rule.attrs]
        children += [("matchcontent", {}, rule.content)] if rule.content else []
        children.append(("replacement", {"part": rule.part}, rule.replacement))
    elif isinstance(rule, QualityRule):
        attrs |= {"quality": rule.quality, "minimal_size_bytes": rule.minimal_size}
    elif isinstance(rule, RatingRule):
        children += [("limit", {"name": n}, v) for n, v in rule.limits]
    elif isinstance(rule, FeedRule):
        attrs |= {"selector": rule.selector, "replacetype": rule.action}
    elif isinstance(rule, ImageRule):
        attrs |= {"width": rule.width, "height": rule.height, "formats": ",".join(rule.formats)}
    return element(kind, attrs, children)


def folder_of(body: str, sid: str, oid: int) -> str:
    return f'<?xml version="1.0" encoding="iso-8859-1"?><folder sid={quoteattr(sid)} oid="{oid}"><title lang="en">{escape(sid)}</title>{body}</folder>'


def folder_xml(rules: RuleSet, sid: str, oid: int) -> str:
    kinds = (
        ("allow", rules.allow_patterns), ("block", rules.block_patterns), ("header", rules.header_rules), ("replace", rules.text_rules), ("htmlrewrite", rules.tag_rules),
        ("image", rules.image_rules), ("imagereduce", rules.quality_rules), ("rating", rules.rating_rules), ("xmlrewrite", rules.feed_rules),
    )
    return folder_of("".join(rule_xml(r, kind) for kind, many in kinds for r in many), sid, oid)


def write_scopes(spark: SparkSession, rules: Sequence[ScopedRule], path: str) -> None:
    """Folder files with rules that have scopes only, one for each folder number, in order of their places."""
    kinds = {handler: kind for kind, handler in HANDLER_OF.items()}
    for oid in sorted({r.folder_oid for r in rules}):
        own = sorted((r for r in rules if r.folder_oid == oid), key=lambda r: r.oid)
        write_file(spark, folder_of("".join(rule_xml(r, kinds[r.handler]) for r in own), f"own.{oid}", oid), path)


def write_file(spark: SparkSession, xml: str, path: str) -> None:
    spark.range(1).select(F.lit(xml.replace("\n", "&#10;")).alias("value")).write.mode("append").option("encoding", "iso-8859-1").text(path)


def write_rule_set(spark: SparkSession, rules: RuleSet, path: str, sid: str = "own.1", oid: int = 0) -> None:
    """One folder file with all rules of a set."""
    write_file(spark, folder_xml(rules, sid, oid), path)
