"""Cleaning of whole pages: every stage in order, page by page, without an exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import policy as P
from millrace.functions import text as X
from millrace.operators import html as M
from millrace.operators import security as S
from millrace.operators.replace import replace_text


def clean(
    pages: DataFrame,
    tag_rules: Sequence[P.TagRule] = tuple(P.TAG_RULES),
    text_rules: Sequence[P.TextRule] = tuple(P.TEXT_RULES),
    comment_urls: Sequence[str] = ("/en/", "/de/"),
    exempt: str | None = None,
    script_urls: Sequence[str] | None = (),
) -> DataFrame:
    """page_id, html: characters, tokens, names of tags, comments, security, tag rules, element rules, text rules.

    ``exempt`` names a boolean column; pages with true there come back as they are. Comments in scripts go where the URL
    matches one of ``script_urls`` (everywhere without any; None keeps them).
    """
    url = F.col("url")
    fixed = X.fix_chars(F.col("html"), F.lit(None).cast("string"))
    # one projection per stage keeps the expressions apart; none of them moves a row
    rows = pages.withColumn("tokens", M.corrected(M.tokens(fixed)))
    rows = rows.withColumn("tokens", M.drop_comments(F.col("tokens"), url, comment_urls))
    if script_urls is not None:
        rows = rows.withColumn("tokens", M.without_script_comments(F.col("tokens"), url, script_urls))
    rows = rows.withColumn("tokens", M.add_img_titles(S.repaired(F.col("tokens"))))
    rows = rows.withColumn("tokens", M.rewrite_start_tags(F.col("tokens"), url, tag_rules))
    rows = rows.withColumn("clean", M.rewrite_blocks(F.col("tokens"), url, tag_rules))
    cleaned = replace_text(F.col("clean"), url, F.lit("text/html"), text_rules)
    if exempt:
        cleaned = F.when(F.col(exempt), F.col("html")).otherwise(cleaned)
    return rows.select("page_id", cleaned.alias("html"))
