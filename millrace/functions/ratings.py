"""Rating expressions: ranges, ordinal categories and the check against limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.let import let

# The degrees of an ordinal category, the categories and the widest age range.
DEGREES = ["none", "mild", "heavy"]
ORDINAL = ["language", "sex", "violence"]
CATEGORIES = ["age", *ORDINAL]
SERVICE = "http://rating.example/service"


def parse_range(text: Column) -> Column:
    """``""``, ``n``, ``n-``, ``-m`` and ``n-m`` as struct(lo, hi) with null for an open end; else null."""
    lo = F.regexp_extract(text, "^([0-9]*)-[0-9]*$", 1).try_cast("int")
    hi = F.regexp_extract(text, "^[0-9]*-([0-9]*)$", 1).try_cast("int")
    none = F.lit(None).cast("int")

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("lo"), b.alias("hi"))

    return (
        F.when(F.coalesce(text, F.lit("")) == "", pair(none, none))
        .when(text.rlike("^[0-9]+$"), pair(text.try_cast("int"), none))
        .when(text.rlike("^[0-9]*-[0-9]*$"), pair(lo, F.when(hi.isNotNull(), F.greatest(hi, lo))))
    )


def contains_value(outer: Column, value: Column) -> Column:
    """An open end, of the range or of the value, always fits."""
    above = outer["lo"].isNull() | (value >= outer["lo"])
    below = outer["hi"].isNull() | (value <= outer["hi"])
    return value.isNull() | (above & below)


def contains_range(outer: Column, inner: Column) -> Column:
    return contains_value(outer, inner["lo"]) & contains_value(outer, inner["hi"])


def degree(value: Column) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DEGREES]), value)


def exceeded(category: str, value: Column, limit: str) -> Column:
    """True when a present value goes beyond the limit; a missing one is skipped."""
    if category == "age":
        wanted = parse_range(F.lit(limit))
        over = let(parse_range(value), lambda page: ~contains_range(page, wanted))
    else:
        over = degree(value) > DEGREES.index(limit) + 1
    return F.coalesce(value.isNotNull() & over, F.lit(False))


def deny_reason(values: dict[str, Column], limits: dict[str, str]) -> Column:
    """The first category, in fixed order, whose limit is exceeded; null when all fit."""
    hits = [F.when(exceeded(c, values[c], limits[c]), F.lit(c)) for c in CATEGORIES if c in limits]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def is_valid(category: Column, value: Column) -> Column:
    """Known category with a readable value: a degree, or a range."""
    ordinal = F.lower(category).isin(ORDINAL) & value.isin(DEGREES)
    return ordinal | ((F.lower(category) == "age") & parse_range(value).isNotNull())
