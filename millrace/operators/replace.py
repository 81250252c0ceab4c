"""Sequential text replacement by rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.rules import applies_to_mime, applies_to_url
from millrace.policy import TextRule


def replace_text(text: Column, url: Column, mime: Column, rules: Sequence[TextRule]) -> Column:
    """Each rule in turn replaces all its matches where it applies; the text runs through once per rule.

    A rule that does not apply gets a null pattern condition, so the earlier text is written once only.
    """
    out = text
    for rule in rules:
        use = applies_to_url(url, rule.matchurls, rule.nomatchurls) & applies_to_mime(mime, rule.mimes)
        # the pattern that never matches stands for "does not apply"
        out = F.regexp_replace(out, F.when(use, rule.search).otherwise(r"(?!)"), F.lit(rule.replace))
    return out
