"""Pages as token lists: tokenise, read attributes, pair tags, clean and put together again.

A page stays one row: every step, the rewriting of whole elements too, is an expression on its token
list, so cleaning pages needs no exchange. Tokens are exploded only where a table of tokens is the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import tags as T
from millrace.functions import text as X
from millrace.functions import urls as U
from millrace.functions.let import let
from millrace.functions.rules import applies_to_url, expand, numbered_groups
from millrace.policy import TagRule

# What a tag holds up to its ``>``: a quoted value after ``=`` may hold any sign; a quote that is never closed is one sign
# of its own. All of it is possessive, so nothing is read twice.
INSIDE = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+"""
# Script and style elements are one match, so nothing inside them is taken for a tag. What is never closed (a comment, a
# script, a tag) reaches to the end of the page, as browsers read it; each page is so read once from left to right.
TOKEN = (
    rf"(?is)<script\b{INSIDE}>.*?(?:</script\s*+>|\z)|<style\b{INSIDE}>.*?(?:</style\s*+>|\z)|<!--.*?(?:-->|\z)"
    rf"|<[a-z/!?]{INSIDE}(?:>|\z)|[^<]++|<"
)
RAW_ELEMENT = rf"(?is)^(<(?:script|style)\b{INSIDE}>)(.*?)(</(?:script|style)\s*>)?$"
TAG_NAME = r"^</?([A-Za-z][^\s/>]*)"
ATTRIBUTE = r"""([^\s=<>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def _token(text: Column, raw: bool = False) -> Column:
    name = F.lower(F.regexp_extract(text, TAG_NAME, 1))
    if raw:
        kind = F.lit("data")
    else:
        kind = (
            F.when(~F.endswith(text, F.lit(">")), "data")
            .when(F.startswith(text, F.lit("<!--")) & F.endswith(text, F.lit("-->")), "comment")
            .when(text.rlike("(?i)^<!doctype"), "doctype")
            .when(text.rlike(r"^<\?"), "pi")
            .when(text.rlike("(?s)^</[A-Za-z].*>$"), "end")
            .when(text.rlike("(?s)^<[A-Za-z].*/>$"), "startend")
            .when(text.rlike("(?s)^<[A-Za-z].*>$"), "start")
            .otherwise("data")
        )
    tag = F.lit("") if raw else let(kind, lambda k: F.when(k.isin("start", "end", "startend"), name).otherwise(""))
    return F.struct(kind.alias("kind"), tag.alias("tag"), text.alias("text"))


def tokens(html: Column) -> Column:
    """array<struct<kind,tag,text>>; the texts joined give the page again."""

    def pieces(text: Column) -> Column:
        body = F.regexp_extract(text, RAW_ELEMENT, 2)
        element = F.array(
            _token(F.regexp_extract(text, RAW_ELEMENT, 1)), _token(body, raw=True), _token(F.regexp_extract(text, RAW_ELEMENT, 3))
        )
        whole = F.filter(element, lambda e: e["text"] != "")
        return F.when(text.rlike(rf"(?is)^<(script|style)\b{INSIDE}>"), whole).otherwise(F.array(_token(text)))

    cleaned = F.translate(html, "\x00", " ")
    return F.flatten(F.transform(F.regexp_extract_all(cleaned, F.lit(TOKEN), F.lit(0)), pieces))


def attributes(text: Column) -> Column:
    """array<struct<name,value>> of a start tag, names in lower case, value null when there is none."""
    inner = F.regexp_replace(F.regexp_replace(text, r"^<[A-Za-z][^\s/>]*", ""), r"/?>$", "")
    found = F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(0))

    def one(item: Column) -> Column:
        raw = F.regexp_extract(item, r"(?s)^[^=]*=\s*(.*)$", 1)
        bare = F.regexp_replace(raw, r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2")
        return F.struct(
            F.lower(F.regexp_extract(item, r"""^([^\s=<>"'/]+)""", 1)).alias("name"),
            F.when(F.contains(item, F.lit("=")), X.resolve_entities(bare)).alias("value"),
        )

    return F.transform(found, one)


def quote_value(value: Column) -> Column:
    """Attribute value fit for double quotes: ``&``, ``"`` and non-ASCII become references."""
    basic = F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))

    def referenced(v: Column) -> Column:
        chars = F.transform(
            F.split(v, ""), lambda c: F.when(c.rlike(r"^[^\x00-\x7F]"), F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c)
        )
        return F.when(v.rlike(r"[^\x00-\x7F]"), F.array_join(chars, "")).otherwise(v)

    return let(basic, referenced)


def render_attributes(attrs: Column) -> Column:
    return F.array_join(
        F.transform(
            attrs,
            lambda a: F.concat(
                F.lit(" "), a["name"],
                F.when(a["value"].isNull(), "").otherwise(F.concat(F.lit('="'), quote_value(a["value"]), F.lit('"'))),
            ),
        ),
        "",
    )


def render(token: Column) -> Column:
    """Text of a token, tags in normal form."""
    opened = F.concat(F.lit("<"), token["tag"], render_attributes(attributes(token["text"])))
    return (
        F.when(token["kind"] == "start", F.concat(opened, F.lit(">")))
        .when(token["kind"] == "startend", F.concat(opened, F.lit("/>")))
        .when(token["kind"] == "end", F.concat(F.lit("</"), token["tag"], F.lit(">")))
        .otherwise(token["text"])
    )


def explode_tokens(pages: DataFrame, *keep: str, partitioned: bool = False) -> DataFrame:
    """page_id, pos, kind, tag, text; ``partitioned`` puts a page's tokens into one partition for windows.

    The token list is exploded as an expression: as a column of its own, Catalyst would infer a filter
    on its size, push it to the scan and tokenise every page twice.
    """
    rows = pages.select("page_id", *keep, "html")
    if partitioned:
        # the compact page moves, not its tokens; windows and groups by page need no exchange after it
        rows = rows.repartition("page_id")
    rows = rows.select("page_id", *keep, F.posexplode(tokens(F.col("html"))).alias("pos", "t"))
    return rows.select("page_id", *keep, "pos", "t.*")


def explode_attributes(token_rows: DataFrame, *keep: str) -> DataFrame:
    starts = token_rows.where(F.col("kind").isin("start", "startend"))
    attrs = starts.select("page_id", *keep, "pos", "tag", F.posexplode(attributes(F.col("text"))).alias("apos", "a"))
    return attrs.select("page_id", *keep, "pos", "tag", "apos", "a.*")


def pair_tags(token_rows: DataFrame) -> DataFrame:
    """Add depth (nesting of the same tag) and, on start tags, match: position of the end tag or null."""
    by_tag = Window.partitionBy("page_id", "tag").orderBy("pos")
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    rows = token_rows.withColumn("_after", F.sum(step).over(by_tag))
    rows = rows.withColumn("depth", F.when(F.col("kind") == "end", F.col("_after") + 1).otherwise(F.col("_after")))
    paired = F.col("kind").isin("start", "end")
    by_level = Window.partitionBy("page_id", "tag", "depth", paired).orderBy("pos")
    follower = F.lead(F.struct("kind", "pos")).over(by_level)
    match = F.when((F.col("kind") == "start") & (follower["kind"] == "end"), follower["pos"])
    return rows.withColumn("match", match).drop("_after")


def rule_tag_matches(tag: Column, rule: TagRule) -> Column:
    return tag == rule.tag if rule.literal_tag else tag.rlike(f"^(?:{rule.tag})$")


def rule_attrs_match(attrs: Column, rule: TagRule) -> Column:
    """Every attribute of the rule occurs, and all its values fit."""
    ok = F.lit(True)
    for name, pattern in rule.attrs:
        same = _attrs_named(attrs, name)
        ok = ok & (F.size(same) > 0) & F.forall(same, _value_fits(pattern))
    return ok


def _attrs_named(attrs: Column, name: str) -> Column:
    return F.filter(attrs, lambda a: a["name"] == name)


def _value_fits(pattern: str):
    return lambda a: F.coalesce(a["value"], F.lit("")).rlike(numbered_groups(pattern)[0])


def rule_matches(tag: Column, attrs: Column, url: Column, rule: TagRule) -> Column:
    return rule_tag_matches(tag, rule) & applies_to_url(url, rule.matchurls, rule.nomatchurls) & rule_attrs_match(attrs, rule)


# Rule parts that change the start tag at once, and parts that wait for the end tag.
START_PARTS = ("tag", "tagname", "attr", "attrval", "attrname")
BLOCK_PARTS = ("complete", "enclosed", "matched")


def rewrite_start_tags(token_array: Column, url: Column, rules: Sequence[TagRule]) -> Column:
    """Apply the start tag rules in order; a rule that changes the kind or the name of a tag is the last one.

    The end tag of a changed element follows its start tag; where a rule asks for no attributes, also one without start.
    """
    rules = [r for r in rules if r.part in START_PARTS or (r.part == "complete" and r.tag in T.NO_CLOSE_TAGS)]

    def changed(state: Column, rule: TagRule) -> Column:
        if rule.part == "complete":
            return _state(F.lit("data"), state["tag"], state["attrs"], F.lit(""), F.lit(True))
        if rule.part == "tag":
            return _state(F.lit("data"), state["tag"], state["attrs"], F.lit(rule.replacement), F.lit(True))
        if rule.part == "tagname":
            return _state(state["kind"], F.lit(rule.replacement), state["attrs"], state["text"], F.lit(True))
        return _state(state["kind"], state["tag"], _rewrite_attrs(state["attrs"], rule), state["text"], F.lit(False))

    def apply(rule: TagRule):
        return lambda state: F.when(
            ~state["done"] & rule_matches(state["tag"], state["attrs"], url, rule), changed(state, rule)
        ).otherwise(state)

    def rewritten(token: Column) -> Column:
        state = _state(token["kind"], token["tag"], attributes(token["text"]), token["text"], F.lit(False))
        for rule in rules:
            state = let(state, apply(rule))
        return let(state, _close_state)

    def close_end(token: Column) -> Column:
        out = token
        for rule in rules:
            if rule.part in ("tag", "tagname") and not rule.attrs:
                text = rule.replacement if rule.part == "tag" else f"</{rule.replacement}>"
                new = F.struct(
                    F.lit("data" if rule.part == "tag" else "end").alias("kind"),
                    F.lit("" if rule.part == "tag" else rule.replacement).alias("tag"), F.lit(text).alias("text"),
                )
                hit = rule_tag_matches(token["tag"], rule) & applies_to_url(url, rule.matchurls, rule.nomatchurls)
                out = F.when(hit, new).otherwise(out)
        return out

    def one(token: Column) -> Column:
        touched = F.lit(False)
        for rule in rules:
            touched = touched | rule_tag_matches(token["tag"], rule)
        return (
            F.when(token["kind"].isin("start", "startend") & touched, rewritten(token))
            .when(token["kind"] == "end", close_end(token))
            .otherwise(token)
        )

    bound = [r for r in rules if r.part in ("tag", "tagname") and r.attrs]
    if not bound:
        return F.transform(token_array, one)

    def followed(toks: Column, out: Column) -> Column:
        touched = lambda tag: reduce(lambda a, b: a | b, [rule_tag_matches(tag, r) for r in bound])
        indexed = F.transform(toks, lambda t, i: F.struct(i.alias("pos"), t["kind"].alias("kind"), t["tag"].alias("tag")))
        pairs = element_ranges(F.filter(indexed, lambda t: t["kind"].isin("start", "end") & touched(t["tag"])))
        ends = F.transform(pairs, lambda p: F.struct(p["e"].alias("s"), p["e"].alias("e"), (p["s"] + 1).alias("start")))
        starts = covered(ends, F.size(toks), lambda r: r["start"])

        def closed(t: Column, start: Column) -> Column:
            def after(new: Column) -> Column:
                text = F.when(new["kind"] == "data", new["text"]).otherwise(F.concat(F.lit("</"), new["tag"], F.lit(">")))
                kind = F.when(new["kind"] == "data", "data").otherwise("end")
                made = F.struct(kind.alias("kind"), new["tag"].alias("tag"), text.alias("text"))
                return F.when(new["tag"] != F.get(toks, start - 1)["tag"], made).otherwise(t)

            return F.when(start > 0, let(F.get(out, start - 1), after)).otherwise(t)

        return F.zip_with(out, starts, closed)

    return let(token_array, lambda toks: let(F.transform(toks, one), lambda out: followed(toks, out)))


def _state(kind: Column, tag: Column, attrs: Column, text: Column, done: Column) -> Column:
    return F.struct(kind.alias("kind"), tag.alias("tag"), attrs.alias("attrs"), text.alias("text"), done.alias("done"))


def _close_state(state: Column) -> Column:
    end = F.when(state["kind"] == "startend", "/>").otherwise(">")
    text = F.when(state["kind"] == "data", state["text"]).otherwise(
        F.concat(F.lit("<"), state["tag"], render_attributes(state["attrs"]), end)
    )
    tag = F.when(state["kind"] == "data", "").otherwise(state["tag"])
    return F.struct(state["kind"].alias("kind"), tag.alias("tag"), text.alias("text"))


def _rewrite_attrs(attrs: Column, rule: TagRule) -> Column:
    patterns = dict(rule.attrs)

    def one(a: Column) -> Column:
        out = F.array(a)
        for name, pattern in patterns.items():
            value = F.coalesce(a["value"], F.lit(""))
            filled = expand(value, pattern, rule.replacement)
            plain, names = numbered_groups(pattern)
            if rule.part == "attrval":
                # a group of this name holds a quoted address
                filled = U.unmark(U.unquote(filled)) if "url" in names else filled
                new = F.array(F.struct(a["name"].alias("name"), filled.alias("value")))
            elif rule.part == "attrname":
                new = F.array(F.struct(filled.alias("name"), a["value"].alias("value")))
            else:
                items = [f.split("=", 1) if "=" in f else [f, None] for f in rule.replacement.split()]
                new = F.array(*[
                    F.struct(
                        F.lit(k).alias("name"),
                        (expand(value, pattern, v.strip('"')) if v is not None else F.lit(None).cast("string")).alias("value"),
                    )
                    for k, v in items
                ])
            out = F.when((a["name"] == name) & value.rlike(plain), new).otherwise(out)
        return out

    return F.flatten(F.transform(attrs, one))


def element_ranges(few: Column) -> Column:
    """array<struct<s,e>>: positions of start and end tag of every closed element among indexed tags.

    An end tag closes the last open start of the same name; elements never closed give no range. The
    fold only sees the tags that rules ask for.
    """
    open_tag = "array<struct<tag:string,pos:int>>"

    def step(state: Column, t: Column) -> Column:
        stack, pairs = state["stack"], state["pairs"]
        top = F.try_element_at(F.filter(stack, lambda e: e["tag"] == t["tag"]), F.lit(-1))["pos"]
        pushed = F.struct(
            F.array_append(stack, F.struct(t["tag"].alias("tag"), t["pos"].alias("pos"))).alias("stack"), pairs.alias("pairs")
        )
        popped = F.struct(
            F.filter(stack, lambda e: e["pos"] != top).alias("stack"),
            F.array_append(pairs, F.struct(top.alias("s"), t["pos"].alias("e"))).alias("pairs"),
        )
        return F.when(t["kind"] == "start", pushed).when(top.isNotNull(), popped).otherwise(state)

    start = F.struct(
        F.array().cast(open_tag).alias("stack"), F.array().cast("array<struct<s:int,e:int>>").alias("pairs")
    )
    return F.aggregate(few, start, step, lambda s: s["pairs"])


def covered(ranges: Column, size: Column, code) -> Column:
    """array<int> with one entry for each token: ``code(range)`` inside the ranges (s, e; in order, apart), else 0.

    Runs are laid end to end, so the cost is that of the tokens; a slice of a long array would copy all of it.
    """

    def run(r: Column, i: Column) -> Column:
        before = F.coalesce(F.get(ranges, i - 1)["e"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(0), r["s"] - before - 1), F.array_repeat(code(r), r["e"] - r["s"] + 1))

    end = F.coalesce(F.try_element_at(ranges, F.lit(-1))["e"], F.lit(-1))
    return F.concat(F.flatten(F.transform(ranges, run)), F.array_repeat(F.lit(0), size - end - 1))


def _texts(token_array: Column) -> Column:
    return F.array_join(F.transform(token_array, lambda x: x["text"]), "")


def rewrite_blocks(token_array: Column, url: Column, rules: Sequence[TagRule], replace_matched: bool = False) -> Column:
    """Page text after the element rules: complete, enclosed and matched parts.

    An element without end tag never fires; of nested hits the outer one decides. All of it happens
    inside the page row, so a page is never exploded and nothing is shuffled.
    """
    rules = [r for r in rules if r.part in BLOCK_PARTS]
    if not rules:
        return _texts(token_array)

    def touched(tag: Column) -> Column:
        hit = F.lit(False)
        for rule in rules:
            hit = hit | rule_tag_matches(tag, rule)
        return hit

    def content(toks: Column, r: Column) -> Column:
        return _texts(F.slice(toks, r["s"] + 2, r["e"] - r["s"] - 1))

    def deciding(toks: Column):
        def rule_of(r: Column) -> Column:
            tag = F.get(toks, r["s"])["tag"]

            def chain(attrs: Column) -> Column:
                out = None
                for i, rule in enumerate(rules):
                    ok = rule_matches(tag, attrs, url, rule)
                    if rule.content:
                        ok = ok & content(toks, r).rlike(rule.content)
                    out = F.when(ok, i) if out is None else out.when(ok, i)
                return F.when(out.isNotNull(), F.struct(r["s"].alias("s"), r["e"].alias("e"), out.alias("rule")))

            return let(attributes(F.get(toks, r["s"])["text"]), chain)

        return rule_of

    def shown(toks: Column, r: Column) -> Column:
        first, last = F.get(toks, r["s"])["text"], F.get(toks, r["e"])["text"]
        out = F.lit("")
        for i, rule in enumerate(rules):
            text = F.lit(rule.replacement)
            if rule.part == "matched":
                new = rule.replacement.replace("\\", "\\\\").replace("$", "\\$") if replace_matched else ""
                text = F.regexp_replace(content(toks, r), f"(?s)^(.*?)(?:{rule.content})", "$1" + new) if rule.content else content(toks, r)
            if rule.part != "complete":
                text = F.concat(first, text, last)
            out = F.when(r["rule"] == i, text).otherwise(out)
        return out

    def assemble(toks: Column, tops: Column) -> Column:
        def piece(r: Column, i: Column) -> Column:
            before = F.coalesce(F.get(tops, i - 1)["e"], F.lit(-1))
            return F.concat(_texts(F.slice(toks, before + 2, r["s"] - before - 1)), shown(toks, r))

        end = F.coalesce(F.try_element_at(tops, F.lit(-1))["e"], F.lit(-1))
        tail = _texts(F.slice(toks, end + 2, F.size(toks)))
        return F.concat(F.array_join(F.transform(tops, piece), ""), tail)

    def outermost(fired: Column) -> Column:
        return F.filter(fired, lambda f: ~F.exists(fired, lambda g: (g["s"] < f["s"]) & (f["s"] < g["e"])))

    def rewrite(toks: Column) -> Column:
        indexed = F.transform(
            toks, lambda t, i: F.struct(i.alias("pos"), t["kind"].alias("kind"), t["tag"].alias("tag"))
        )
        few = F.filter(indexed, lambda t: t["kind"].isin("start", "end") & touched(t["tag"]))
        fired = F.array_sort(F.array_compact(F.transform(element_ranges(few), deciding(toks))))
        return let(let(fired, outermost), lambda tops: assemble(toks, tops))

    return let(token_array, rewrite)


def drop_comments(token_array: Column, url: Column, matchurls: Sequence[str]) -> Column:
    """Drop empty comments always, all comments where the rule applies."""
    applies = applies_to_url(url, matchurls, ())
    return F.filter(token_array, lambda t: (t["kind"] != "comment") | (~applies & (t["text"] != "<!---->")))


def add_img_titles(token_array: Column) -> Column:
    """Give images with alternative text but no title the first line of that text as title."""

    def titled(token: Column) -> Column:
        attrs = attributes(token["text"])

        def body(a: Column) -> Column:
            alt = F.try_element_at(_attrs_named(a, "alt"), F.lit(-1))["value"]
            missing = (F.size(_attrs_named(a, "alt")) > 0) & (F.size(_attrs_named(a, "title")) == 0)
            line = F.when(F.contains(alt, F.lit("\n")), F.trim(F.regexp_extract(alt, r"^([^\n]*)", 1))).otherwise(alt)
            title = F.struct(F.lit("title").alias("name"), F.coalesce(line, F.lit("")).alias("value"))
            end = F.when(token["kind"] == "startend", "/>").otherwise(">")
            text = F.concat(F.lit("<img"), render_attributes(F.array_append(a, title)), end)
            new = F.struct(token["kind"].alias("kind"), token["tag"].alias("tag"), text.alias("text"))
            return F.when(missing, new).otherwise(token)

        return let(attrs, body)

    return F.transform(
        token_array, lambda t: F.when((t["tag"] == "img") & t["kind"].isin("start", "startend"), titled(t)).otherwise(t)
    )


def first_attr(attrs: Column, name: str) -> Column:
    return F.try_element_at(_attrs_named(attrs, name), F.lit(-1))["value"]


def page_base(token_array: Column, url: Column) -> Column:
    """The base of relative links: the last ``<base href>``, else the page URL."""
    bases = F.filter(token_array, lambda t: (t["tag"] == "base") & t["kind"].isin("start", "startend"))
    href = F.transform(bases, lambda t: first_attr(attributes(t["text"]), "href"))
    found = F.try_element_at(F.filter(href, lambda h: h.isNotNull()), F.lit(-1))
    absolute = F.when(found.rlike("^[A-Za-z]+:"), found).otherwise(F.concat(U.scheme(url), F.lit("://"), found))
    return F.when(found.isNull(), url).otherwise(absolute)


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, tag, attr, target: resolved href and src links, redirects unwrapped."""
    rows = pages.select("page_id", "url", tokens(F.col("html")).alias("tokens"))
    rows = rows.select("page_id", page_base(F.col("tokens"), F.col("url")).alias("base"), "tokens")
    # the outer form keeps Catalyst from inferring a filter that would tokenise twice
    rows = rows.select("page_id", "base", F.posexplode_outer("tokens").alias("pos", "t"))
    tags = rows.where(F.col("pos").isNotNull()).select("page_id", "base", "pos", "t.*")
    attrs = explode_attributes(tags, "base").where(F.col("name").isin("href", "src") & F.col("value").isNotNull() & (F.col("tag") != "base"))
    target = U.redirect_target(U.resolve(F.col("base"), F.col("value")))
    return attrs.select("page_id", "pos", "tag", F.col("name").alias("attr"), target.alias("target"))


def _feed_allowed() -> Column:
    """Literal map from each tag allowed in feeds to its allowed attributes."""
    pairs = (f"'{tag}', array({', '.join(repr(n) for n in names)})" if names else f"'{tag}', cast(array() as array<string>)" for tag, names in T.FEED_ALLOWED.items())
    return F.expr(f"map({', '.join(pairs)})")


def feed_subset(html: Column, url: Column | None = None, drop: Sequence[TagRule] = ()) -> Column:
    """Only the tags and attributes allowed in feeds; an unlisted element goes with all it holds.

    So does an element that matches one of the ``drop`` rules. A fold over the tags finds the ranges that
    go; its state is the stack of open tags of the element being dropped.
    """
    span = "array<struct<s:int,e:int>>"

    def listed(t: Column) -> Column:
        ok = t["tag"].isin(list(T.FEED_ALLOWED))
        for rule in drop:
            ok = ok & ~rule_matches(t["tag"], attributes(t["text"]), url, rule)
        return ok

    def state(stack: Column, begin: Column, spans: Column) -> Column:
        return F.struct(stack.alias("stack"), begin.alias("begin"), spans.alias("spans"))

    def step(s: Column, t: Column) -> Column:
        stack = s["stack"]
        valid = F.size(stack) == 0
        top_is = F.coalesce(F.try_element_at(stack, F.lit(-1)) == t["tag"], F.lit(False))
        popped = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        done = F.array_append(s["spans"], F.struct(s["begin"].alias("s"), t["pos"].alias("e")))
        closed = state(popped, s["begin"], F.when(F.size(popped) == 0, done).otherwise(s["spans"]))
        return (
            F.when(valid & (t["kind"] == "start") & ~listed(t), state(F.array(t["tag"]), t["pos"], s["spans"]))
            .when(~valid & (t["kind"] != "end"), state(F.array_append(stack, t["tag"]), s["begin"], s["spans"]))
            .when(~valid & top_is, closed)
            .otherwise(s)
        )

    def shown(t: Column) -> Column:
        def render_listed(names: Column) -> Column:
            kept = F.filter(attributes(t["text"]), lambda a: F.array_contains(names, a["name"]))
            kept = F.transform(kept, lambda a: F.struct(a["name"].alias("name"), F.coalesce(a["value"], F.lit("")).alias("value")))
            end = F.when(t["kind"] == "startend", "/>").otherwise(">")
            return F.when(names.isNotNull(), F.concat(F.lit("<"), t["tag"], render_attributes(kept), end)).otherwise("")

        opened = let(F.try_element_at(_feed_allowed(), t["tag"]), render_listed)
        return (
            F.when(t["kind"].isin("start", "startend"), opened)
            .when(t["kind"] == "end", F.concat(F.lit("</"), t["tag"], F.lit(">")))
            .when(t["kind"] == "data", t["text"])
            .otherwise("")
        )

    def assemble(toks: Column, spans: Column) -> Column:
        gone = covered(spans, F.size(toks), lambda r: F.lit(1))
        return F.array_join(F.zip_with(toks, gone, lambda t, g: F.when(g == 0, shown(t)).otherwise("")), "")

    def clean(toks: Column) -> Column:
        indexed = F.transform(
            toks, lambda t, i: F.struct(i.alias("pos"), t["kind"].alias("kind"), t["tag"].alias("tag"), t["text"].alias("text"))
        )
        tags = F.filter(indexed, lambda t: t["tag"] != "")
        start = state(F.array().cast("array<string>"), F.lit(-1), F.array().cast(span))
        # an element that is still open at the end takes the rest of the text with it
        folded = F.aggregate(
            tags, start, step,
            lambda s: F.when(
                F.size(s["stack"]) > 0,
                F.array_append(s["spans"], F.struct(s["begin"].alias("s"), (F.size(toks) - 1).alias("e"))),
            ).otherwise(s["spans"]),
        )
        return let(folded, lambda spans: assemble(toks, spans))

    return let(corrected(tokens(html)), clean)


def corrected_tag(tag: Column) -> Column:
    """Known tags and names of other namespaces stay; else the first known tag one edit away; else the sound start."""
    dictionary = sorted(set(T.HTML_TAGS + T.MATH_TAGS + T.OLD_TAGS))
    near = F.filter(F.expr("array('" + "', '".join(dictionary) + "')"), lambda d: F.levenshtein(d, tag, 1) == 1)
    known = tag.isin(dictionary + T.KNOWN_INVALID_TAGS) | tag.rlike("^[-a-z_.]+:")
    sound = F.regexp_extract(tag, r"^([a-z][-a-z0-9.:_]*)", 1)
    return F.when(known, tag).otherwise(F.coalesce(F.get(near, F.lit(0)), F.when(sound != "", sound), tag))


def corrected(token_array: Column) -> Column:
    """Tokens with the names of tags corrected; most names are known and cost a look into the list only."""
    name = r"^(</?)[A-Za-z][^\s/>]*"

    def one(t: Column) -> Column:
        def renamed(tag: Column) -> Column:
            new = F.struct(t["kind"].alias("kind"), tag.alias("tag"), F.concat(F.regexp_extract(t["text"], name, 1), tag, F.regexp_replace(t["text"], name, "")).alias("text"))
            return F.when(tag != t["tag"], new).otherwise(t)

        return F.when(t["tag"] != "", let(corrected_tag(t["tag"]), renamed)).otherwise(t)

    return F.transform(token_array, one)


def without_script_comments(token_array: Column, url: Column, matchurls: Sequence[str] = ()) -> Column:
    """Bodies of script elements without comments, where the URL fits. ``token_array`` is a column that is there."""
    fits = applies_to_url(url, matchurls, ())

    def one(t: Column, i: Column) -> Column:
        before = F.get(token_array, i - 1)
        inside = (t["kind"] == "data") & (before["tag"] == "script") & (before["kind"] == "start")
        return F.when(inside & fits, t.withField("text", X.strip_script_comments(t["text"]))).otherwise(t)

    return F.transform(token_array, one)


def meta_tags(pages: DataFrame) -> DataFrame:
    """page_id, pos, name, http_equiv, content, charset of every meta tag, with the XHTML flag of its page."""
    rows = pages.select("page_id", tokens(F.col("html")).alias("tokens"))
    xhtml = F.exists("tokens", lambda t: (t["kind"] == "doctype") & F.contains(t["text"], F.lit("XHTML")))
    indexed = F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), t["kind"].alias("kind"), t["tag"].alias("tag"), t["text"].alias("text")))
    metas = F.filter(indexed, lambda t: (t["tag"] == "meta") & t["kind"].isin("start", "startend"))
    rows = rows.select("page_id", xhtml.alias("xhtml"), F.explode(metas).alias("m"))
    rows = rows.select("page_id", "xhtml", "m.pos", attributes(F.col("m.text")).alias("a")).where(F.size("a") > 0)
    named = {"name": "name", "http_equiv": "http-equiv", "content": "content", "charset": "charset"}
    return rows.select("page_id", "pos", "xhtml", *[first_attr(F.col("a"), n).alias(k) for k, n in named.items()])
