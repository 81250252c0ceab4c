"""Feeds: elements selected by path are removed or their embedded HTML is cleaned."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.let import let
from millrace.functions.rules import applies_to_url
from millrace.operators import html as M
from millrace.policy import TagRule

XML_TOKEN = rf"(?s)<!\[CDATA\[.*?(?:\]\]>|\z)|<!--.*?(?:-->|\z)|<\?.*?(?:\?>|\z)|<[A-Za-z_/!]{M.INSIDE}(?:>|\z)|[^<]++|<"
#: Tags of one inner fold. A fold copies its state at each step, so the ranges of a long feed are kept out of it.
CHUNK = 256


@dataclass(frozen=True)
class FeedRule:
    """Selector such as ``/rss/channel/item[kind=x]/description``; action is rsshtml or remove."""

    sid: str
    selector: str
    action: str = "rsshtml"
    matchurls: tuple[str, ...] = ()
    nomatchurls: tuple[str, ...] = ()

    def steps(self) -> tuple[bool, list[tuple[str, list[tuple[str, str]]]]]:
        """Whether the path starts at the root, and its steps with attribute conditions."""
        parts = self.selector.split("/")
        rooted = parts[0] == ""
        out = []
        for part in parts[1:] if rooted else parts:
            m = re.match(r"([a-zA-Z:]+)\[(.+)\]$", part)
            conditions = [tuple(c.split("=", 1)) for c in m.group(2).split(",")] if m else []
            out.append((m.group(1) if m else part, conditions))
        return rooted, out


# Selectors of the usual feed formats.
FEED_RULES = [
    FeedRule("wc.41", "/rdf:RDF/item/description"),
    FeedRule("wc.42", "/rss/channel/item/description"),
    FeedRule("wc.80", "/rss/channel/item/content:encoded"),
    FeedRule("wc.86", "/feed/entry/content"),
]


def _selected(stack: Column, rule: FeedRule) -> Column:
    rooted, steps = rule.steps()
    n = len(steps)
    ok = (F.size(stack) == n) if rooted else (F.size(stack) >= n)
    for i, (tag, conditions) in enumerate(steps):
        element = F.get(stack, F.size(stack) - n + i)
        ok = ok & (element["tag"] == tag)
        for name, value in conditions:
            ok = ok & F.exists(M.attributes(element["text"]), _is(name, value))
    return F.coalesce(ok, F.lit(False))


def _is(name: str, value: str):
    return lambda a: (a["name"] == name) & (a["value"] == value)


def selected_ranges(tags: Column, size: Column, url: Column, rules: Sequence[FeedRule]) -> Column:
    """array<struct<s,e,action>>: where the elements lie that a rule selects, outermost only, in order.

    A fold over the tags (pos, tag, text, opens): its state is the path to the open element and the ranges found. It
    runs chunk by chunk; only between chunks the ranges are added to those before. An element that never closes reaches
    to the end.
    """
    element, span = "struct<tag:string,text:string>", "struct<s:int,e:int,action:string>"
    none = F.array().cast(f"array<{span}>")

    def state(stack: Column, depth: Column, begin: Column, action: Column, spans: Column) -> Column:
        return F.struct(stack.alias("stack"), depth.alias("depth"), begin.alias("begin"), action.alias("action"), spans.alias("spans"))

    def found(s: Column, e: Column) -> Column:
        return F.struct(s["begin"].alias("s"), e.cast("int").alias("e"), s["action"].alias("action"))

    def step(s: Column, t: Column) -> Column:
        pushed = F.array_append(s["stack"], F.struct(t["tag"].alias("tag"), t["text"].alias("text")))
        action = F.lit("")
        for rule in reversed(rules):
            action = F.when(_selected(pushed, rule) & applies_to_url(url, rule.matchurls, rule.nomatchurls), rule.action).otherwise(action)
        free = s["action"] == ""
        # where no action follows, depth and begin say nothing
        opened = state(
            pushed, F.when(free, F.size(pushed)).otherwise(s["depth"]), F.when(free, t["pos"]).otherwise(s["begin"]),
            F.when(free, action).otherwise(s["action"]), s["spans"],
        )
        popped = F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0)))
        leaves = ~free & (F.size(s["stack"]) == s["depth"])
        left = state(popped, F.lit(0), F.lit(0), F.lit(""), F.array_append(s["spans"], found(s, t["pos"])))
        closed = F.when(leaves, left).otherwise(state(popped, s["depth"], s["begin"], s["action"], s["spans"]))
        return F.when(t["opens"], opened).otherwise(closed)

    def chunk_step(s: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, state(s["stack"], s["depth"], s["begin"], s["action"], none), step)
        return let(inner, lambda r: state(r["stack"], r["depth"], r["begin"], r["action"], F.concat(s["spans"], r["spans"])))

    start = state(F.array().cast(f"array<{element}>"), F.lit(0), F.lit(0), F.lit(""), none)
    rest = lambda s: F.when(s["action"] != "", F.array(found(s, size - 1))).otherwise(none)
    chunks = let(tags, lambda all_tags: F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_tags), F.lit(1)) - 1) / CHUNK).cast("int")),
        lambda i: F.slice(all_tags, i * CHUNK + 1, F.lit(CHUNK)),
    ))
    return F.aggregate(chunks, start, chunk_step, lambda s: F.concat(s["spans"], rest(s)))


def rewrite_feed(xml: Column, url: Column, rules: Sequence[FeedRule], drop: Sequence[TagRule] = ()) -> Column:
    """The feed with the rules applied; ``drop`` are HTML rules whose elements vanish from embedded HTML.

    The ranges of the selected elements are found first, then the texts between them, those of cleaned elements and
    nothing of removed ones are put together once.
    """
    fixed = F.regexp_replace(xml, r"&(?!#?[A-Za-z0-9]+;)", "&amp;")
    toks = F.regexp_extract_all(fixed, F.lit(XML_TOKEN), F.lit(0))

    def cleaned(text: Column) -> Column:
        plain = F.when(text.rlike(r"^<!\[CDATA\["), F.regexp_extract(text, r"(?s)^<!\[CDATA\[(.*?)(?:\]\]>)?$", 1)).otherwise(X.resolve_entities(text))
        subset = M.feed_subset(plain, url, drop)
        wrap = lambda h: F.when(F.contains(h, F.lit("]]>")), F.replace(F.replace(h, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))).otherwise(
            F.concat(F.lit("<![CDATA["), h, F.lit("]]>")))
        return let(subset, wrap)

    def put_together(toks: Column, ranges: Column) -> Column:
        is_data = lambda x: ~x.rlike(r"^<([A-Za-z_/?]|!--|![A-Za-z])")
        action = M.covered(ranges, F.size(toks), lambda r: F.when(r["action"] == "remove", 2).otherwise(1))
        shown = lambda x, a: F.when(a == 2, "").when((a == 1) & is_data(x), cleaned(x)).otherwise(x)
        return F.array_join(F.zip_with(toks, action, shown), "")

    def rewrite(toks: Column) -> Column:
        def tag(x: Column, i: Column) -> Column:
            return F.struct(
                i.alias("pos"), F.regexp_extract(x, r"^</?([^\s/>]+)", 1).alias("tag"), x.alias("text"), x.rlike("^<[A-Za-z_]").alias("opens"),
                (x.rlike("^</") | (x.rlike("(?s)^<[A-Za-z_].*>$") & ~F.endswith(x, F.lit("/>")))).alias("is_tag"),
            )

        tags = F.filter(F.transform(toks, tag), lambda t: t["is_tag"])
        return let(selected_ranges(tags, F.size(toks), url, rules), lambda ranges: put_together(toks, ranges))

    return F.regexp_replace(let(toks, rewrite), r'^(<\?xml[^>]*encoding=)"[^"]*"', '$1"UTF-8"')
