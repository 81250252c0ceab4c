"""Scope tests and pattern rules folded into expressions: literal patterns are compiled once."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.policy import PatternRule


def any_match(text: Column, patterns: Iterable[str]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | text.rlike(pattern)
    return found


def applies_to_url(url: Column, matchurls: Sequence[str], nomatchurls: Sequence[str]) -> Column:
    """A match list decides alone when present; otherwise a no-match hit excludes."""
    if matchurls:
        return any_match(url, matchurls)
    return ~any_match(url, nomatchurls)


def applies_to_mime(mime: Column, mimes: Sequence[str]) -> Column:
    return F.coalesce(any_match(mime, mimes), F.lit(False)) if mimes else F.lit(True)


def handler_takes_mime(mime: Column, mimes: Sequence[str]) -> Column:
    """Handler scope: the whole MIME type, optionally with parameters."""
    if not mimes:
        return F.lit(True)
    return F.coalesce(any_match(mime, [f"(?i)^{m}(;.+)?$" for m in mimes]), F.lit(False))


#: An escaped sign, a class, or the start of a group: what matters when groups are counted.
GROUP_START = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P<(\w+)>|\(\?P=(\w+)\)|\((?!\?)", re.S)


def numbered_groups(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern with named groups (``(?P<name>``, ``(?P=name)``) as numbered ones, and the number of each name."""
    names: dict[str, int] = {}
    count = 0

    def one(m: re.Match) -> str:
        nonlocal count
        if m[2]:
            # a blank group keeps a following digit apart
            return f"\\{names[m[2]]}(?:)"
        if m[1] or m[0] == "(":
            count += 1
            if m[1]:
                names[m[1]] = count
            return "("
        return m[0]

    return GROUP_START.sub(one, pattern), names


def expand(match_of: Column, pattern: str, template: str) -> Column:
    """Template with ``\\n``, ``\\g<n>`` and ``\\g<name>`` replaced by the groups of the first match."""
    plain, names = numbered_groups(pattern)
    parts = re.split(r"\\(\d|g<\w+>)", template)
    number = lambda p: names.get(p[2:-1]) or int(p[2:-1]) if p[0] == "g" else int(p)
    columns = [
        F.regexp_extract(match_of, plain, number(p)) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2
    ]
    return F.concat(*columns) if columns else F.lit("")


def pattern_hits(url: Column, rules: Sequence[PatternRule]) -> Column:
    """array<struct<rank,sid>> of all matching rules, in rule order."""
    hits = [F.when(url.rlike(r.pattern), F.struct(F.lit(i).alias("rank"), F.lit(r.sid).alias("sid"))) for i, r in enumerate(rules)]
    return F.array_compact(F.array(*hits))


def first_pattern(url: Column, rules: Sequence[PatternRule]) -> Column:
    """struct(sid, replacement) of the first matching rule; replacement null when the rule has none."""
    chain = None
    for rule in rules:
        filled = expand(url, rule.pattern, rule.replacement) if rule.replacement else F.lit(None).cast("string")
        value = F.struct(F.lit(rule.sid).alias("sid"), filled.alias("replacement"))
        chain = F.when(url.rlike(rule.pattern), value) if chain is None else chain.when(url.rlike(rule.pattern), value)
    return chain
