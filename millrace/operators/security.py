"""Security scan of tags: one finding per failed check, and the attributes that remain after repair.

Everything happens inside the page row. Object nesting and help controls are carried by one fold over
the few object tags of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.functions.let import let
from millrace.operators import html as P

# Limits of the checks.
MAX_ATTRS = 200
MAX_OBJECT_DEPTH = 3
BLOCKED_CLASSID = "EC444CB6-3E7E-4865-B1C3-0DE72EF39B3F"
SIZE_CAPS = [
    ("embed", "src", 1024), ("embed", "name", 1024), ("font", "size", 4), ("frame", "src", 1024), ("frame", "name", 1024),
    ("hr", "align", 50), ("iframe", "src", 1024), ("iframe", "name", 1024),
]
URL_ATTRS = [("a", "href"), ("iframe", "src"), ("img", "src"), ("img", "lowsrc")]


def stripped_length(value: Column) -> Column:
    """Length attribute without blanks and with a doubled percent sign repaired."""
    return F.regexp_replace(F.trim(value), "%%$", "%")


def bad_length(value: Column) -> Column:
    number = F.regexp_replace(F.lower(stripped_length(value)), "(px|em|%)$", "")
    whole = F.regexp_replace(number, r"^([1-9][0-9]*)\.[0-9]+$", "$1")
    return (value != "") & ~whole.rlike("^[0-9]{1,4}$")


def bad_refresh(content: Column) -> Column:
    """A refresh target that is neither http, https nor ftp."""
    targets = F.split(F.regexp_replace(F.lower(content), r"\s+", ""), ";url=")
    bare = F.transform(targets, lambda u: F.regexp_replace(u, r"""^(["'])(.*)\1$""", "$2"))
    return F.exists(bare, lambda u: ~u.rlike("^(https?|ftp)://") & F.contains(u, F.lit(":")))


def object_states(token_array: Column) -> Column:
    """struct(dropped, helped): positions of objects nested too deep, and of parameters inside a help control."""
    indexed = F.transform(token_array, lambda t, i: F.struct(i.alias("pos"), t["kind"].alias("kind"), t["tag"].alias("tag"), t["text"].alias("text")))
    few = F.filter(indexed, lambda t: t["tag"].isin("object", "param"))
    empty = F.array().cast("array<int>")

    def state(level: Column, helper: Column, dropped: Column, helped: Column) -> Column:
        return F.struct(level.alias("level"), helper.alias("helper"), dropped.alias("dropped"), helped.alias("helped"))

    def step(s: Column, t: Column) -> Column:
        opens = t["kind"].isin("start", "startend")
        codebase = P.first_attr(P.attributes(t["text"]), "codebase")
        helper = F.when(codebase.isNotNull(), codebase.rlike("(?i)^hhctrl[.]ocx")).otherwise(s["helper"])
        return (
            F.when((t["tag"] == "param") & opens & s["helper"], state(s["level"], s["helper"], s["dropped"], F.array_append(s["helped"], t["pos"])))
            .when(t["tag"] == "param", s)
            .when(opens & (s["level"] == MAX_OBJECT_DEPTH), state(s["level"], s["helper"], F.array_append(s["dropped"], t["pos"]), s["helped"]))
            .when(opens, state(s["level"] + 1, helper, s["dropped"], s["helped"]))
            .when(t["kind"] == "end", state(F.when(s["level"] > 1, s["level"] - 1).otherwise(s["level"]), F.lit(False), s["dropped"], s["helped"]))
            .otherwise(s)
        )

    start = state(F.lit(0), F.lit(False), empty, empty)
    return F.when(F.size(few) > 0, F.aggregate(few, start, step)).otherwise(start)


def tag_findings(tag: Column, attrs: Column, helped: Column) -> Column:
    """array<struct<attr,check>> of one start tag."""

    def value(name: str) -> Column:
        return F.coalesce(P.first_attr(attrs, name), F.lit(""))

    def present(name: str) -> Column:
        return F.exists(attrs, lambda a: a["name"] == name)

    checks: list[tuple[Column, str, str]] = [(F.size(F.array_distinct(F.transform(attrs, lambda a: a["name"]))) > MAX_ATTRS, "", "attr_number")]
    for name, attr in URL_ATTRS:
        checks.append(((tag == name) & U.many_percents(value(attr)), attr, "percent_overflow"))
        checks.append(((tag == name) & U.dashes_in_host(value(attr)), attr, "dashes_in_host"))
    for attr in ("src", "lowsrc"):
        checks.append(((tag == "img") & F.contains(F.lower(value(attr)), F.lit("javascript:")), attr, "javascript_url"))
    icon = F.lower(F.trim(value("rel"))) == "icon"
    checks.append(((tag == "link") & icon & F.contains(F.lower(value("href")), F.lit("javascript:")), "href", "javascript_url"))
    checks.append(((tag == "applet") & bad_length(value("hspace")), "hspace", "length_format"))
    checks.append(((tag == "body") & value("onload").rlike(r"window\s*\(\s*\)"), "onload", "window_crash"))
    for name, attr, cap in SIZE_CAPS:
        checks.append(((tag == name) & (F.length(value(attr)) > cap), attr, "attr_size"))
    file_ending = F.regexp_extract(F.regexp_extract(value("src"), r"^([^?]*)", 1), r"(\.[^./]*)$", 1)
    too_big = F.length(value("src")) > 1024
    checks.append(((tag == "embed") & ~too_big & (F.length(file_ending) > 10), "src", "filename_overflow"))
    checks.append(((tag == "fieldset") & F.contains(value("style"), F.lit("position")), "style", "fieldset_style"))
    checks.append(((tag == "input") & present("type") & (value("type") == ""), "type", "input_type"))
    refresh = F.lower(F.when(value("http-equiv") != "", value("http-equiv")).otherwise(value("name"))) == "refresh"
    checks.append(((tag == "meta") & refresh & bad_refresh(value("content")), "content", "refresh_scheme"))
    checks.append(((tag == "object") & value("type").rlike("/.*/"), "type", "object_type"))
    unquoted = U.unmark(U.unquote(value("data")))
    checks.append(((tag == "object") & unquoted.rlike(r"(?i)^(its|mk|ms-its|ms-itss):.*!"), "data", "its_zone"))
    checks.append(((tag == "object") & F.contains(F.upper(value("classid")), F.lit(BLOCKED_CLASSID)), "classid", "blocked_classid"))
    checks.append(((tag == "param") & helped & (F.length(value("value")) > 50), "value", "winhelp_overflow"))
    icq = (tag == "table") & (value("width") == "-1")
    checks.append((icq, "width", "table_width"))
    checks.append((~icq & bad_length(value("width")), "width", "length_format"))
    checks.append((bad_length(value("height")), "height", "length_format"))
    found = [F.when(c, F.struct(F.lit(a).alias("attr"), F.lit(n).alias("check"))) for c, a, n in checks]
    return F.array_compact(F.array(*found))


def _with_states(token_array: Column, body) -> Column:
    return let(
        token_array, lambda toks: let(object_states(toks), lambda s: body(toks, s))
    )


def page_findings(token_array: Column) -> Column:
    """array<struct<pos,tag,attr,check>> of a page."""

    def scan(toks: Column, states: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            dropped = F.array_contains(states["dropped"], i)
            found = let(P.attributes(t["text"]), lambda a: tag_findings(t["tag"], a, F.array_contains(states["helped"], i)))
            depth = F.array(F.struct(F.lit("").alias("attr"), F.lit("object_depth").alias("check")))
            every = F.when(dropped, depth).otherwise(found)
            rows = F.transform(
                every, lambda f: F.struct(i.alias("pos"), t["tag"].alias("tag"), f["attr"].alias("attr"), f["check"].alias("check"))
            )
            none = F.array().cast("array<struct<pos:int,tag:string,attr:string,check:string>>")
            return F.when(t["kind"].isin("start", "startend"), rows).otherwise(none)

        return F.flatten(F.transform(toks, one))

    return _with_states(token_array, scan)


def findings(pages: DataFrame) -> DataFrame:
    """page_id, pos, tag, attr, check for every failed check."""
    return pages.select("page_id", F.inline(page_findings(P.tokens(F.col("html")))))


def repaired(token_array: Column) -> Column:
    """Tokens with unsafe attributes removed or mended and too deep objects dropped."""

    def mend(attrs: Column, bad: Column) -> Column:
        def one(a: Column) -> Column:
            hit = F.filter(bad, lambda f: f["attr"] == a["name"])
            check = F.get(hit, F.lit(0))["check"]
            mended = (
                F.when(check == "object_type", F.regexp_replace(a["value"], "/(?=.*/)", ""))
                .when(check == "its_zone", F.regexp_extract(U.unmark(U.unquote(a["value"])), "^([^!]*)", 1))
            )
            stripped = F.when(a["name"].isin("width", "height", "hspace") & a["value"].isNotNull(), stripped_length(a["value"])).otherwise(a["value"])
            value = F.when(check.isNull(), stripped).otherwise(mended)
            gone = check.isNotNull() & ~check.isin("object_type", "its_zone")
            return F.when(~gone, F.struct(a["name"].alias("name"), value.alias("value")))

        capped = F.slice(attrs, 1, MAX_ATTRS)
        return F.array_compact(F.transform(capped, one))

    def fix(toks: Column, states: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            def rebuild(a: Column) -> Column:
                def with_findings(bad: Column) -> Column:
                    end = F.when(t["kind"] == "startend", "/>").otherwise(">")
                    text = F.concat(F.lit("<"), t["tag"], P.render_attributes(mend(a, bad)), end)
                    new = F.struct(t["kind"].alias("kind"), t["tag"].alias("tag"), text.alias("text"))
                    return F.when(F.size(bad) == 0, t).otherwise(new)

                return let(tag_findings(t["tag"], a, F.array_contains(states["helped"], i)), with_findings)

            fixed = F.when(t["text"].rlike(r"^<[A-Za-z][^\s/>]*[\s/]+[^\s/>]"), let(P.attributes(t["text"]), rebuild)).otherwise(t)
            return F.when(t["kind"].isin("start", "startend"), F.when(~F.array_contains(states["dropped"], i), fixed)).otherwise(t)

        return F.array_compact(F.transform(toks, one))

    return _with_states(token_array, fix)
