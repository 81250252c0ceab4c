"""Text and script expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.let import let

# Binary characters and the ASCII characters that replace them.
BINARY_CHARS = "\x00\x84\x91\x92\x93\x94"
ASCII_CHARS = " \"`'\"\""

# One literal map of all named entities; built as text, so it is one expression and not five hundred.
NAMED_ENTITIES = "map(" + ", ".join(f"'{n}', '\\u{c:04x}'" for n, c in sorted(name2codepoint.items())) + ")"
ENTITY = r"&(?:#[xX]?)?[0-9A-Za-z]+;"


def fix_chars(text: Column, charset: Column) -> Column:
    """Replace binary quote characters unless the text is UTF-8."""
    utf8 = F.coalesce(charset == "utf-8", F.lit(False)) | text.rlike(r"(?i)text/html;\s*charset=utf-8")
    return F.when(utf8, text).otherwise(F.translate(text, BINARY_CHARS, ASCII_CHARS))


def resolve_entities(text: Column) -> Column:
    """Named, decimal and hex entities become characters, unknown ones vanish."""
    named = F.expr(NAMED_ENTITIES)

    def char(code: Column) -> Column:
        ok = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        # beyond the basic plane a character is two units of UTF-16
        pair = (F.lit(0xD800) + F.shiftright(code - 0x10000, 10)) * 0x10000 + F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        digits = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(F.hex(pair))
        return F.when(ok, F.decode(F.unhex(digits), "UTF-16BE")).otherwise("")

    def resolved(entity: Column) -> Column:
        hexed = F.regexp_extract(entity, r"^&#[xX]([0-9A-Fa-f]{1,6});$", 1)
        decimal = F.regexp_extract(entity, r"^&#([0-9]{1,7});$", 1)
        name = F.regexp_extract(entity, r"^&([0-9A-Za-z]+);$", 1)
        return (
            F.when(hexed != "", char(F.conv(hexed, 16, 10).cast("bigint")))
            .when(decimal != "", char(decimal.cast("bigint")))
            .otherwise(F.coalesce(F.try_element_at(named, name), F.lit("")))
        )

    def joined(value: Column) -> Column:
        entities = F.regexp_extract_all(value, F.lit(ENTITY), F.lit(0))
        pieces = F.zip_with(
            F.split(value, ENTITY), entities, lambda s, e: F.concat(s, F.when(e.isNull(), "").otherwise(resolved(e)))
        )
        return F.array_join(pieces, "")

    return let(text, lambda v: F.when(F.contains(v, F.lit("&")), joined(v)).otherwise(v))


def remove_markup(text: Column) -> Column:
    """Delete every ``<...>``; a deletion cannot form a new tag, so one pass is enough."""
    return F.regexp_replace(text, r"(?s)<.*?>", "")


# A break starts at a line end and holds at least one more line end of the same kind.
PARAGRAPH_BREAK = r"\r(?:\r\s*)+|\n(?:\n\s*)+|\r\n(?:\r\n\s*)+"


def paragraphs(text: Column) -> Column:
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(text, PARAGRAPH_BREAK))


def strip_script_comments(script: Column, keep_line_comments: bool = False) -> Column:
    """Script without HTML comment wrappers, blank lines and ``//`` lines; inner end tags are split up."""
    lines = F.transform(F.split(script, r"\r\n|\r|\n"), lambda s: F.rtrim(F.regexp_replace(s, r"\s+$", "")))
    kept = F.filter(lines, lambda s: (s != "") & (F.lit(keep_line_comments) | ~s.rlike(r"^\s*//")))

    def unwrap(rows: Column) -> Column:
        opened = F.coalesce(F.get(rows, F.lit(0)).rlike(r"^(<!--|//<!\[CDATA\[)"), F.lit(False))
        return F.when(opened, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)

    def close(rows: Column) -> Column:
        last = F.get(rows, F.size(rows) - 1)
        cut = F.regexp_replace(last, r"(?://[^/]*)?(?:-->|\]\]>)$", "")
        head = F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0)))
        return F.when(F.size(rows) == 0, rows).otherwise(F.array_append(head, cut))

    body = let(let(kept, unwrap), lambda rows: F.array_join(close(rows), "\n"))
    in_double = F.regexp_replace(body, r'(?i)("[^"\n]*)</script>', '$1</scr"+"ipt>')
    in_single = F.regexp_replace(in_double, r"(?i)('[^'\n]*)</script>", "$1</scr'+'ipt>")
    return F.regexp_replace(in_single, r"(?i)</script>", "")


def script_language(type_attr: Column, language_attr: Column) -> Column:
    """struct(is_javascript, version) from the type and language attributes."""
    kind, lang = F.lower(F.coalesce(type_attr, F.lit(""))), F.lower(F.coalesce(language_attr, F.lit("")))
    is_js = (
        (kind == "text/javascript")
        | F.startswith(kind, F.lit("javascript"))
        | F.startswith(lang, F.lit("javascript"))
        | ((kind == "") & (lang == ""))
    )
    number = F.regexp_extract(lang, r"javascript([0-9]\.[0-9])", 1)
    return F.struct(
        is_js.alias("is_javascript"),
        F.when(number == "", 0.0).otherwise(number.try_cast("double")).alias("version"),
    )
