"""Binary content: type by signature, preferred type, image size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.let import let
from millrace.policy import ImageRule
from millrace.signatures import WIDTH, Signature

# How many leading bytes are looked at, and how many are needed at least.
SNIFF_BYTES, MIN_BYTES = 1024, 5


def _number(content: Column, offset: int, kind: str) -> Column:
    width = WIDTH[kind]
    order = range(width) if kind.startswith("be") else range(width - 1, -1, -1)
    digits = F.concat(*[F.hex(F.substring(content, offset + 1 + i, 1)) for i in order])
    return F.when(F.length(content) >= offset + width, F.conv(digits, 16, 10).cast("bigint"))


def _ordered(piece: Column, test: str, value: str) -> Column:
    """A text test by order, one sign for each byte."""
    if test == ">":
        return (F.lit(value == "\0")) & (piece != "") & (F.substring(piece, 1, 1) != F.lit("\0"))
    lower = [F.coalesce(F.nullif(F.substring(piece, i + 1, 1), F.lit("")) < F.lit(c), F.lit(False)) for i, c in enumerate(value)]
    none_lower = F.lit(True)
    for is_lower in lower:
        none_lower = none_lower & ~is_lower
    return (piece != "") & none_lower


def _holds(content: Column, s: Signature) -> Column:
    base = s.kind.split("/")[0]
    if base == "string":
        if s.test == "x":
            return F.length(content) > s.offset
        if s.test in "<>":
            return _ordered(F.decode(F.substring(content, s.offset + 1, max(1, len(s.value))), "ISO-8859-1"), s.test, s.value.decode("latin-1"))
        piece = F.substring(content, s.offset + 1, len(s.value))
        if s.fold_case:
            return F.lower(F.decode(piece, "ISO-8859-1")) == s.value.decode("latin-1").lower()
        return piece == F.lit(s.value)
    value = _number(content, s.offset, base)
    if s.mask is not None:
        value = value.bitwiseAND(s.mask) if s.mask_by == "&" else value.bitwiseXOR(s.mask)
    tests = {
        "=": lambda: value == s.value, ">": lambda: value > s.value, "<": lambda: value < s.value,
        "&": lambda: value.bitwiseAND(s.value) == s.value, "^": lambda: value.bitwiseXOR(s.value) == 0, "x": lambda: value.isNotNull(),
    }
    return F.coalesce(tests[s.test](), F.lit(False))


def sniff(content: Column, signatures: Sequence[Signature]) -> Column:
    """MIME type of the first matching signature and its refinements, first word only; null when none.

    The table is part of the expression: groups of rows are tried in order, and a deeper row counts when
    the nearest row above it of the next lower level does.
    """
    groups = _groups(signatures)

    def text(c: Column, group: list[Signature]) -> Column:
        open_at: dict[int, Column] = {0: F.lit(True)}
        words = [F.lit(group[0].mime)]
        for s in group[1:]:
            ok = open_at.get(s.level - 1, F.lit(False)) & _holds(c, s)
            open_at[s.level] = ok
            words.append(F.when(ok, s.mime))
        return _first_word(F.concat_ws(" ", *words))

    def chain(c: Column) -> Column:
        out = None
        for group in groups:
            out = F.when(_holds(c, group[0]), text(c, group)) if out is None else out.when(_holds(c, group[0]), text(c, group))
        return F.nullif(out, F.lit(""))

    return F.when(F.length(content) >= MIN_BYTES, let(F.substring(content, 1, SNIFF_BYTES), chain))


def _first_word(joined: Column) -> Column:
    """The first of the joined words; a word that begins with a backspace belongs to the one before."""
    return F.regexp_extract(F.replace(F.regexp_replace(joined, "^\x08+", ""), F.lit(" \b"), F.lit("")), r"^\s*(\S*)", 1)


def _groups(signatures: Sequence[Signature]) -> list[list[Signature]]:
    """Each row of level 0 with the rows that refine it."""
    groups: list[list[Signature]] = []
    for s in signatures:
        if s.level == 0:
            groups.append([s])
        elif groups:
            groups[-1].append(s)
    return groups


def _probe(s: Signature) -> tuple | None:
    """What a test of equality reads from a content: tests that read the same are one lookup. None for other tests."""
    if s.test != "=":
        return None
    if s.kind.split("/")[0] == "string":
        return ("string", s.offset, len(s.value), s.fold_case)
    return (s.kind, s.offset, s.mask, s.mask_by)


def _read(content: Column, probe: tuple) -> Column:
    if probe[0] == "string":
        piece = F.decode(F.substring(content, probe[1] + 1, probe[2]), "ISO-8859-1")
        return F.lower(piece) if probe[3] else piece
    value = _number(content, probe[1], probe[0])
    if probe[2] is not None:
        value = value.bitwiseAND(probe[2]) if probe[3] == "&" else value.bitwiseXOR(probe[2])
    return value.cast("string")


def _told(s: Signature) -> str:
    if s.kind.split("/")[0] != "string":
        return str(s.value)
    text = s.value.decode("latin-1")
    return text.lower() if s.fold_case else text


def sniff_all(df: DataFrame, key: str, content: str, signatures: Sequence[Signature]) -> DataFrame:
    """key, sniffed of every content: as ``sniff``, with the signatures as a table, for long signature files.

    Every kind of read in use (offset and length or width, mask, case) makes one key of a content, and the keys meet the
    tests of equality in one equi-join; the few other tests of level 0 are part of the expression. The first group that
    holds decides. Its refinements are rows too: each names the rows it depends on, all of which must hold. ``key`` names
    each content once.
    """
    spark, groups = df.sparkSession, _groups(signatures)
    probes = list(dict.fromkeys(p for g in groups if (p := _probe(g[0])) is not None))
    last = len(groups)
    heads = df.select(F.col(key).alias("_key"), F.when(F.length(content) >= MIN_BYTES, F.substring(content, 1, SNIFF_BYTES)).alias("_head"))
    told = [F.struct(F.lit(i).alias("probe"), _read(F.col("_head"), p).alias("value")) for i, p in enumerate(probes)]
    # one key that all contents have keeps those that nothing matches
    told.append(F.struct(F.lit(-1).alias("probe"), F.lit("").alias("value")))
    tests = [(probes.index(_probe(g[0])), _told(g[0]), n) for n, g in enumerate(groups) if _probe(g[0]) is not None]
    table = spark.createDataFrame([*tests, (-1, "", last)], "probe int, value string, grp int")
    table = table.groupBy("probe", "value").agg(F.min("grp").alias("grp"))
    others = [F.when(_holds(F.col("_head"), g[0]), n) for n, g in enumerate(groups) if _probe(g[0]) is None]
    rows = heads.select("_key", "_head", F.inline(F.array(*told))).join(table, ["probe", "value"])
    rows = rows.withColumn("grp", F.least("grp", *others)) if others else rows
    first = rows.groupBy("_key").agg(F.min(F.struct("grp", "_head")).alias("f")).select("_key", "f.*")

    parts, spec = [], "grp int, place int, needs array<int>, mime string, test int"
    bodies: dict[tuple, int] = {}
    for n, group in enumerate(groups):
        above: dict[int, tuple[int, ...]] = {0: ()}
        for place, s in enumerate(group):
            if place and s.level - 1 not in above:
                continue
            needs = (*above[s.level - 1], place) if place else ()
            above[s.level] = needs
            body = bodies.setdefault((s.kind, s.offset, s.test, s.value, s.mask, s.mask_by), len(bodies)) if place else -1
            parts.append((n, place, list(needs), s.mime, body))
    refined = spark.createDataFrame(parts, spec)
    by_body = {i: Signature(1, b[1], b[0], b[2], b[3], "", b[4], b[5]) for b, i in bodies.items()}
    holds = F.when(F.coalesce("test", F.lit(-1)) < 0, True)
    for i, s in by_body.items():
        holds = holds.when(F.col("test") == i, _holds(F.col("_head"), s))
    tried = first.join(refined, "grp", "left").withColumn("ok", holds)
    whole = tried.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("place", "needs", "mime", "ok"))).alias("parts"))
    held = F.transform(F.filter("parts", lambda p: p["ok"]), lambda p: p["place"])
    words = F.transform("parts", lambda p: F.when(F.size(F.array_except(p["needs"], held)) == 0, p["mime"]))
    return whole.select(F.col("_key").alias(key), F.nullif(_first_word(F.concat_ws(" ", words)), F.lit("")).alias("sniffed"))


def preferred(sniffed: Column, declared: Column) -> Column:
    """True when the sniffed type shall replace the declared one."""
    html_like = F.startswith(declared, F.lit("text/html")) & sniffed.rlike("^(text/plain|application/rss[+]xml|text/xml)")
    keep = (
        (sniffed == declared) | F.startswith(declared, F.lit("application/"))
        | F.startswith(declared, F.concat(sniffed, F.lit(";"))) | html_like
    )
    return F.coalesce(~keep, F.lit(False))


def image_size(content: Column) -> Column:
    """struct(format, width, height) of GIF, PNG and BMP heads, else null."""

    def size(c: Column) -> Column:
        def of(name: str, w: Column, h: Column) -> Column:
            return F.struct(F.lit(name).alias("format"), w.alias("width"), h.alias("height"))

        return (
            F.when(F.substring(c, 1, 3) == F.lit(b"GIF"), of("gif", _number(c, 6, "leshort"), _number(c, 8, "leshort")))
            .when(F.substring(c, 1, 4) == F.lit(b"\x89PNG"), of("png", _number(c, 16, "belong"), _number(c, 20, "belong")))
            .when(F.substring(c, 1, 2) == F.lit(b"BM"), of("bmp", _number(c, 18, "lelong"), _number(c, 22, "lelong")))
        )

    return let(F.substring(content, 1, 32), size)


def blocked_size(size: Column, rules: Sequence[ImageRule]) -> Column:
    """sid of the first rule that lists the image's size and format; null when none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        hit = (size["width"] == rule.width) & (size["height"] == rule.height)
        if rule.formats:
            hit = hit & size["format"].isin(list(rule.formats))
        out = F.when(hit, rule.sid).otherwise(out)
    return out
