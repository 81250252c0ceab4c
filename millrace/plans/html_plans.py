"""Page queries: tokens, attributes, links, cleaning and security."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import policy as P
from millrace import tags as T
from millrace.operators import html as M
from millrace.operators import security as S
from millrace.plans.loaded import rule_set
from millrace.plans.registry import query

# The SQL reads tags by a grammar of its own: names and blanks, then values, quoted ones whole.
VALUE_SQL = r"""=\s*(?:"[^"]*"|''[^'']*'')"""
TAG_SQL = rf"""(?:{VALUE_SQL}|[^>])*?"""
TOKEN_SQL = (
    rf"(?is)<script\b{TAG_SQL}>.*?(?:</script\s*>|\z)|<style\b{TAG_SQL}>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
    rf"|<[a-z/!?]{TAG_SQL}(?:>|\z)|[^<]+|<"
)


def token_ctes(source: str = "pages", prefix: str = "") -> str:
    """CTE ``tokens(page_id, url, pos, kind, tag, text)`` over the HTML of a table."""
    opening, closing = rf"(?is)^(<(?:script|style)\b{TAG_SQL}>)", r"(?is)(</(?:script|style)\s*>)$"
    return rf"""
{prefix}raw AS (SELECT page_id, url, html, regexp_extract_all(replace(html, chr(0), ' '), '{TOKEN_SQL}', 0) AS l FROM {source}),
{prefix}cut AS (SELECT page_id, url, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM {prefix}raw),
{prefix}ends AS (SELECT *, regexp_extract(t, '{opening}', 1) AS o, CASE WHEN o <> '' THEN regexp_extract(t, '{closing}', 1) ELSE '' END AS c FROM {prefix}cut),
{prefix}parts AS (SELECT page_id, url, i, 0 AS j, CASE WHEN o <> '' THEN o ELSE t END AS t, false AS raw FROM {prefix}ends
  UNION ALL SELECT page_id, url, i, 1, substr(t, length(o) + 1, length(t) - length(o) - length(c)), true FROM {prefix}ends WHERE o <> ''
  UNION ALL SELECT page_id, url, i, 2, c, false FROM {prefix}ends WHERE o <> ''),
{prefix}kinds AS (SELECT page_id, url, t AS text, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i, j) - 1 AS INTEGER) AS pos,
  CASE WHEN raw OR right(t, 1) <> '>' THEN 'data' WHEN t LIKE '<!--%' THEN CASE WHEN t LIKE '%-->' THEN 'comment' ELSE 'data' END
    WHEN lower(t) LIKE '<!doctype%' THEN 'doctype' WHEN t LIKE '<?%' THEN 'pi' WHEN regexp_matches(t, '^</[A-Za-z]') THEN 'end'
    WHEN regexp_matches(t, '^<[A-Za-z]') THEN CASE WHEN t LIKE '%/>' THEN 'startend' ELSE 'start' END ELSE 'data' END AS kind FROM {prefix}parts WHERE t <> ''),
{prefix}tokens AS (SELECT page_id, url, pos, kind, CASE WHEN kind IN ('start', 'end', 'startend') THEN lower(regexp_extract(text, '^</?([A-Za-z][^\s/>]*)', 1)) ELSE '' END AS tag, text FROM {prefix}kinds)"""


ATTR_SQL = M.ATTRIBUTE.replace("'", "''")


def attr_ctes(prefix: str = "") -> str:
    """CTE ``attrs(page_id, url, pos, tag, apos, name, value)`` over the start tags."""
    return rf"""
{prefix}inner_text AS (SELECT page_id, url, pos, tag, kind, regexp_extract_all(regexp_replace(regexp_replace(text, '^<[A-Za-z][^\s/>]*', ''), '/?>$', ''), '{ATTR_SQL}', 0) AS l
   FROM {prefix}tokens WHERE kind IN ('start', 'startend')),
{prefix}items AS (SELECT page_id, url, pos, tag, kind, unnest(l) AS item, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS apos FROM {prefix}inner_text),
{prefix}attrs AS (SELECT page_id, url, pos, tag, kind, apos, lower(regexp_extract(item, '^([^\s=<>"''/]+)', 1)) AS name,
   CASE WHEN contains(item, '=') THEN replace(replace(regexp_replace(regexp_replace(substr(item, instr(item, '=') + 1), '^\s+', ''), '(?s)^"(.*)"$|^''(.*)''$', '\1\2'), '&quot;', '"'), '&amp;', '&') END AS value FROM {prefix}items)"""


@query("html_tokens", sql=f"WITH {token_ctes()} SELECT page_id, pos, kind, tag, text FROM tokens")
def html_tokens(t):
    return M.explode_tokens(t.pages.select("page_id", "html"))


@query("html_attrs", sql=f"""WITH both_pages AS (SELECT page_id, url, html FROM pages UNION ALL SELECT page_id + 1000000000, url, html FROM tag_samples),
  {token_ctes('both_pages')}, {attr_ctes()} SELECT page_id, pos, tag, apos, name, value FROM attrs""")
def html_attrs(t):
    samples = t.tag_samples.withColumn("page_id", F.col("page_id") + 1000000000)
    both = t.pages.select("page_id", "html").unionByName(samples.select("page_id", "html"))
    return M.explode_attributes(M.explode_tokens(both))


@query("html_links", sql=rf"""WITH {token_ctes()}, {attr_ctes()}
  SELECT page_id, pos, tag, name AS attr, CASE WHEN regexp_matches(value, '^[a-z]+:') THEN value ELSE regexp_extract(url, '^[a-z]+://[^/?#]*') || value END AS target
  FROM attrs WHERE name IN ('href', 'src') AND value IS NOT NULL""")
def html_links(t):
    return M.links(t.pages.select("page_id", "url", "html"))


COMMENT_RULE = ("/en/", "/de/")


@query("html_drop_comments", sql=f"""WITH {token_ctes()} SELECT page_id, string_agg(text, '' ORDER BY pos) AS html FROM tokens
  WHERE kind <> 'comment' OR (NOT regexp_matches(url, '/(en|de)/') AND text <> '<!---->') GROUP BY page_id""")
def html_drop_comments(t):
    kept = M.drop_comments(M.tokens(F.col("html")), F.col("url"), COMMENT_RULE)
    return t.pages.select("page_id", F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("html"))


@query("html_img_title", sql=f"""WITH {token_ctes('tag_samples')}, {attr_ctes()},
  img AS (SELECT page_id, pos, max(CASE WHEN name = 'alt' THEN value END) AS alt, bool_or(name = 'title') AS titled FROM attrs WHERE tag = 'img' GROUP BY ALL)
  SELECT page_id, pos, CASE WHEN alt IS NOT NULL AND NOT titled THEN trim(string_split(alt, chr(10))[1]) END AS title FROM img""")
def html_img_title(t):
    rows = t.tag_samples.select("page_id", F.posexplode(M.add_img_titles(M.tokens(F.col("html")))).alias("pos", "t"))
    images = rows.where((F.col("t.tag") == "img") & F.col("t.kind").isin("start", "startend"))
    return images.select("page_id", "pos", M.first_attr(M.attributes(F.col("t.text")), "title").alias("title"))


def _match_sql(rule) -> str:
    tag = f"tag = '{rule.tag}'" if rule.literal_tag else f"regexp_full_match(tag, '{rule.tag}')"
    scope = "true"
    if rule.matchurls:
        scope = "(" + " OR ".join(f"regexp_matches(url, '{p}')" for p in rule.matchurls) + ")"
    elif rule.nomatchurls:
        scope = "NOT (" + " OR ".join(f"regexp_matches(url, '{p}')" for p in rule.nomatchurls) + ")"
    attrs = "".join(
        f" AND EXISTS (SELECT 1 FROM attrs a WHERE a.page_id = t.page_id AND a.pos = t.pos AND a.name = '{n}' AND regexp_matches(coalesce(a.value, ''), '{v}'))"
        for n, v in rule.attrs
    )
    return f"SELECT page_id, pos, '{rule.sid}' AS sid FROM tokens t WHERE kind IN ('start', 'startend') AND {tag} AND {scope}{attrs}"


@query("tag_rule_match", sql=f"WITH {token_ctes()}, {attr_ctes()} " + " UNION ALL ".join(_match_sql(r) for r in P.TAG_RULES))
def tag_rule_match(t):
    """Start tags with every rule whose tag, attributes and URL scope fit."""
    starts = M.explode_tokens(t.pages.select("page_id", "url", "html"), "url").where(F.col("kind").isin("start", "startend"))
    rows = starts.select("page_id", "url", "pos", "tag", M.attributes(F.col("text")).alias("attrs"))
    hits = [F.when(M.rule_matches(F.col("tag"), F.col("attrs"), F.col("url"), r), F.lit(r.sid)) for r in rule_set(t).tag_rules]
    return rows.select("page_id", "pos", F.explode(F.array_compact(F.array(*hits))).alias("sid"))


CHAR_REFS = "array_to_string(list_transform(regexp_extract_all({0}, '(?s).'), lambda c: CASE WHEN unicode(c) > 127 THEN '&#' || unicode(c)::VARCHAR || ';' ELSE c END), '')"


REWRITE_CASE = rf"""CASE
    WHEN kind = 'start' AND tag = 'a' THEN '<a href="' || {CHAR_REFS.format("CASE WHEN regexp_matches(regexp_extract(text, 'href=.(.*).>', 1), '/t[a-z]+') THEN '/go/' || regexp_extract(regexp_extract(text, 'href=.(.*).>', 1), '/(t[a-z]+)', 1) ELSE regexp_extract(text, 'href=.(.*).>', 1) END")} || '">'
    WHEN tag = 'h1' THEN CASE kind WHEN 'end' THEN '</h2>' ELSE '<h2>' END
    WHEN kind = 'start' AND tag = 'html' AND regexp_matches(text, 'lang=.(en|fr)') THEN regexp_replace(text, 'lang=', 'xml:lang=')
    WHEN kind = 'start' AND tag = 'meta' THEN '<meta charset="iso-8859-1">'
    WHEN tag IN ('b', 'br') AND regexp_matches(url, '/(fr|en)/') THEN '<i>' ELSE text END"""


@query("html_rewrite_tag", sql=f"""WITH {token_ctes()},
  r AS (SELECT page_id, pos, {REWRITE_CASE} AS text FROM tokens)
  SELECT page_id, string_agg(text, '' ORDER BY pos) AS html FROM r GROUP BY page_id""")
def html_rewrite_tag(t):
    changed = M.rewrite_start_tags(M.tokens(F.col("html")), F.col("url"), rule_set(t).tag_rules)
    return t.pages.select("page_id", F.array_join(F.transform(changed, lambda x: x["text"]), "").alias("html"))


PAIR_CTES = """
steps AS (SELECT *, sum(CASE kind WHEN 'start' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, tag ORDER BY pos) AS a FROM tokens),
levels AS (SELECT * EXCLUDE (a), CASE WHEN kind = 'end' THEN a + 1 ELSE a END AS depth FROM steps),
paired AS (SELECT *, CASE WHEN kind = 'start' AND lead(kind) OVER w = 'end' THEN lead(pos) OVER w END AS match
  FROM levels WINDOW w AS (PARTITION BY page_id, tag, depth, kind IN ('start', 'end') ORDER BY pos))"""


@query("tag_depth", sql=f"WITH {token_ctes()}, {PAIR_CTES} SELECT page_id, pos, kind, tag, CAST(depth AS BIGINT) AS depth, match FROM paired WHERE tag <> ''")
def tag_depth(t):
    tagged = M.explode_tokens(t.pages.select("page_id", "html"), partitioned=True).where(F.col("tag") != "")
    return M.pair_tags(tagged.drop("text")).select("page_id", "pos", "kind", "tag", "depth", "match")


BLOCK_CTES = PAIR_CTES + r""",
body AS (SELECT p.page_id, p.pos, coalesce(string_agg(x.text, '' ORDER BY x.pos), '') AS content FROM paired p LEFT JOIN tokens x ON x.page_id = p.page_id AND x.pos > p.pos AND x.pos < p.match
  WHERE p.match IS NOT NULL AND p.tag IN ('style', 'title') GROUP BY ALL),
fired AS (SELECT p.page_id, p.pos AS s, p.match AS e, p.tag, b.content FROM paired p LEFT JOIN body b USING (page_id, pos) WHERE p.match IS NOT NULL AND
  (p.tag = 'script' OR (p.tag = 'div' AND regexp_matches(text, 'class="ad')) OR (p.tag = 'nav' AND NOT contains(url, '/de/'))
   OR (p.tag = 'style' AND contains(url, 'example.org') AND contains(b.content, 'margin')) OR (p.tag = 'title' AND regexp_matches(b.content, 'the|de')))),
tops AS (SELECT * FROM fired f WHERE NOT EXISTS (SELECT 1 FROM fired g WHERE g.page_id = f.page_id AND g.s < f.s AND f.s < g.e)),
kept AS (SELECT t.page_id, t.pos * 2 AS pos, t.text FROM tokens t LEFT JOIN tops f ON f.page_id = t.page_id AND t.pos BETWEEN f.s AND f.e
  WHERE f.page_id IS NULL OR (f.tag IN ('nav', 'title') AND t.pos IN (f.s, f.e))),
added AS (SELECT page_id, s * 2 + 1 AS pos, CASE tag WHEN 'nav' THEN 'menu' WHEN 'title' THEN regexp_replace(content, 'the|de', '') ELSE '' END AS text FROM tops)
, blocks AS (SELECT page_id, string_agg(text, '' ORDER BY pos) AS html FROM (SELECT * FROM kept UNION ALL SELECT * FROM added) GROUP BY page_id)"""


@query("html_rewrite_block", sql=f"WITH {token_ctes()}, {BLOCK_CTES} SELECT page_id, html FROM blocks")
def html_rewrite_block(t):
    return t.pages.select("page_id", M.rewrite_blocks(M.tokens(F.col("html")), F.col("url"), rule_set(t).tag_rules).alias("html"))


@query("html_reassemble", sql=f"""WITH {token_ctes('tag_samples')}, {attr_ctes()},
  q AS (SELECT page_id, pos, string_agg(' ' || name || CASE WHEN value IS NULL THEN '' ELSE '="' ||
      array_to_string(list_transform(regexp_extract_all(replace(replace(value, '&', '&amp;'), '"', '&quot;'), '(?s).'), lambda c: CASE WHEN unicode(c) > 127 THEN '&#' || unicode(c)::VARCHAR || ';' ELSE c END), '') || '"' END, '' ORDER BY apos) AS a FROM attrs GROUP BY ALL)
  SELECT page_id, string_agg(CASE kind WHEN 'start' THEN '<' || tag || coalesce(a, '') || '>' WHEN 'startend' THEN '<' || tag || coalesce(a, '') || '/>'
     WHEN 'end' THEN '</' || tag || '>' ELSE text END, '' ORDER BY pos) AS html FROM tokens LEFT JOIN q USING (page_id, pos) GROUP BY page_id""")
def html_reassemble(t):
    out = F.array_join(F.transform(M.tokens(F.col("html")), M.render), "")
    return t.tag_samples.select("page_id", out.alias("html"))


LENGTH_BAD = r"""(v <> '' AND NOT regexp_matches(regexp_replace(regexp_replace(lower(regexp_replace(trim(v), '%%$', '%')), '(px|em|%)$', ''), '^([1-9][0-9]*)\.[0-9]+$', '\1'), '^[0-9]{1,4}$'))"""
DASHES = r"(contains(v, ':') AND lower(string_split(v, ':')[1]) <> 'javascript' AND contains(string_split(ltrim(substr(v, instr(v, ':') + 1), '/'), '/')[1], '---'))"


def security_ctes() -> str:
    one = "SELECT page_id, pos, tag, name AS attr, '{0}' AS \"check\" FROM a WHERE {1}"
    urls = "(tag, name) IN (('a', 'href'), ('iframe', 'src'), ('img', 'src'), ('img', 'lowsrc'))"
    caps = " OR ".join(f"(tag = '{t}' AND name = '{n}' AND len(v) > {c})" for t, n, c in S.SIZE_CAPS)
    ending = r"len(regexp_extract(regexp_extract(v, '^([^?]*)', 1), '(\.[^./]*)$', 1)) > 10"
    checks = [
        one.format("percent_overflow", f"{urls} AND contains(v, '{'%' * 11}')"),
        one.format("dashes_in_host", f"{urls} AND {DASHES}"),
        one.format("javascript_url", "tag = 'img' AND name IN ('src', 'lowsrc') AND contains(lower(v), 'javascript:')"),
        one.format("javascript_url", "tag = 'link' AND name = 'href' AND contains(lower(v), 'javascript:') AND (page_id, pos) IN (SELECT (page_id, pos) FROM a WHERE name = 'rel' AND lower(trim(v)) = 'icon')"),
        one.format("window_crash", r"tag = 'body' AND name = 'onload' AND regexp_matches(v, 'window\s*\(\s*\)')"),
        one.format("attr_size", caps),
        one.format("filename_overflow", f"tag = 'embed' AND name = 'src' AND len(v) <= 1024 AND {ending}"),
        one.format("fieldset_style", "tag = 'fieldset' AND name = 'style' AND contains(v, 'position')"),
        one.format("input_type", "tag = 'input' AND name = 'type' AND v = ''"),
        one.format("refresh_scheme", r"""tag = 'meta' AND name = 'content' AND (page_id, pos) IN (SELECT (page_id, pos) FROM a WHERE name = 'http-equiv' AND lower(v) = 'refresh')
          AND len(list_filter(string_split(regexp_replace(lower(v), '\s+', '', 'g'), ';url='), lambda u: NOT regexp_matches(u, '^(https?|ftp)://') AND contains(u, ':'))) > 0"""),
        one.format("object_type", "tag = 'object' AND name = 'type' AND regexp_matches(v, '/.*/')"),
        one.format("its_zone", "tag = 'object' AND name = 'data' AND regexp_matches(v, '(?i)^(its|mk|ms-its|ms-itss):.*!')"),
        one.format("blocked_classid", f"tag = 'object' AND name = 'classid' AND contains(upper(v), '{S.BLOCKED_CLASSID}')"),
        one.format("winhelp_overflow", "tag = 'param' AND name = 'value' AND len(v) > 50"),
        one.format("table_width", "tag = 'table' AND name = 'width' AND v = '-1'"),
        one.format("length_format", f"((name IN ('width', 'height') AND NOT (tag = 'table' AND name = 'width' AND v = '-1')) OR (tag = 'applet' AND name = 'hspace')) AND {LENGTH_BAD}"),
        "SELECT page_id, pos, tag, '', 'attr_number' FROM a GROUP BY page_id, pos, tag HAVING count(DISTINCT name) > 200",
        "SELECT page_id, pos, 'object', '', 'object_depth' FROM dropped",
    ]
    return f"""{token_ctes('tag_samples')}, {attr_ctes()},
objs AS (SELECT page_id, pos, kind, sum(CASE kind WHEN 'end' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS d FROM tokens WHERE tag = 'object'),
lists AS (SELECT page_id, list(kind ORDER BY pos) AS ks, list(pos ORDER BY pos) AS ps FROM objs GROUP BY page_id),
sim(page_id, i, level, dropped) AS (SELECT page_id, 0::BIGINT, 0, false FROM lists UNION ALL
  SELECT s.page_id, i + 1, CASE WHEN ks[i + 1] <> 'end' THEN least(level + 1, 3) WHEN level > 1 THEN level - 1 ELSE level END, ks[i + 1] <> 'end' AND level = 3
  FROM sim s JOIN lists l USING (page_id) WHERE i < len(ks)),
dropped AS (SELECT page_id, ps[i] AS pos FROM sim JOIN lists USING (page_id) WHERE dropped),
a AS (SELECT page_id, pos, tag, name, coalesce(value, '') AS v FROM attrs WHERE (page_id, pos) NOT IN (SELECT (page_id, pos) FROM dropped)),
findings AS ({' UNION ALL '.join(checks)})"""


SECURITY_CTES = security_ctes().replace("\nlists AS", "\nobj_lists AS").replace("FROM lists UNION", "FROM obj_lists UNION").replace("JOIN lists", "JOIN obj_lists")


@query("html_security", sql=f'WITH {SECURITY_CTES} SELECT page_id, pos, tag, attr, "check" FROM findings')
def html_security(t):
    return S.findings(t.tag_samples.select("page_id", "html"))


@query("finding_counts", sql=f'WITH {SECURITY_CTES} SELECT "check", count(*) AS findings, count(DISTINCT page_id) AS pages FROM findings GROUP BY "check"')
def finding_counts(t):
    per_page = S.findings(t.tag_samples.select("page_id", "html")).groupBy("check", "page_id").agg(F.count("*").alias("n"))
    return per_page.groupBy("check").agg(F.sum("n").alias("findings"), F.count("*").alias("pages"))


@query("object_depth", sql=f"WITH {SECURITY_CTES} SELECT page_id, pos FROM dropped")
def object_depth(t):
    """Objects nested deeper than three, which are dropped."""
    states = S.object_states(M.tokens(F.col("html")))
    return t.tag_samples.select("page_id", F.explode(states["dropped"]).alias("pos"))


@query("attr_overflow", sql=f"""WITH {token_ctes('tag_samples')}, {attr_ctes()}, named AS (SELECT page_id, pos, tag, name, min(apos) AS apos FROM attrs GROUP BY ALL),
   placed AS (SELECT *, row_number() OVER (PARTITION BY page_id, pos ORDER BY apos) AS n FROM named)
   SELECT page_id, pos, tag, count(*) AS n, string_agg(name, ' ' ORDER BY apos) FILTER (n <= 200) AS kept FROM placed GROUP BY page_id, pos, tag HAVING count(*) > 200""")
def attr_overflow(t):
    """Tags with too many attributes; a name that is repeated counts once, as in the check."""
    rows = M.explode_tokens(t.tag_samples.select("page_id", "html")).where(F.col("kind").isin("start", "startend"))
    names = F.array_distinct(F.transform(M.attributes(F.col("text")), lambda a: a["name"]))
    rows = rows.select("page_id", "pos", "tag", names.alias("names")).where(F.size("names") > S.MAX_ATTRS)
    kept = F.array_join(F.slice("names", 1, S.MAX_ATTRS), " ")
    return rows.select("page_id", "pos", "tag", F.size("names").cast("bigint").alias("n"), kept.alias("kept"))


def _tag_values(*groups) -> str:
    return "(VALUES " + ", ".join(f"('{t}', '{g}')" for g, tags in groups for t in tags) + ")"


CLASS_VALUES = _tag_values(("html", T.HTML_TAGS), ("math", T.MATH_TAGS), ("old", T.OLD_TAGS))


def tag_classes(t):
    rows = [(x, g) for g, tags in (("html", T.HTML_TAGS), ("math", T.MATH_TAGS), ("old", T.OLD_TAGS)) for x in tags]
    return t.spark.createDataFrame(rows, "tag string, class string")


@query("tag_histogram", sql=f"""WITH both_pages AS (SELECT page_id, url, html FROM pages UNION ALL SELECT page_id, url, html FROM tag_samples), {token_ctes('both_pages')}
  SELECT page_id, coalesce(c.class, 'unknown') AS class, count(*) AS n FROM tokens t LEFT JOIN {CLASS_VALUES} c(name, class) ON c.name = t.tag
  WHERE kind IN ('start', 'startend') GROUP BY ALL""")
def tag_histogram(t):
    both = t.pages.select("page_id", "html").unionByName(t.tag_samples.select("page_id", "html"))
    tags = M.explode_tokens(both).where(F.col("kind").isin("start", "startend")).select("page_id", "tag")
    # counted per tag first: the class join then sees one row per page and tag
    counts = tags.groupBy("page_id", "tag").agg(F.count("*").alias("n")).join(F.broadcast(tag_classes(t)), "tag", "left")
    return counts.groupBy("page_id", F.coalesce("class", F.lit("unknown")).alias("class")).agg(F.sum("n").alias("n"))


@query("tag_sets", sql=f"""WITH both_pages AS (SELECT page_id, url, html FROM pages UNION ALL SELECT page_id, url, html FROM tag_samples), {token_ctes('both_pages')},
  used AS (SELECT DISTINCT tag FROM tokens WHERE kind IN ('start', 'startend')), d AS (SELECT tag FROM {CLASS_VALUES} v(tag, class))
  SELECT tag, tag IN (SELECT tag FROM d) AS in_dictionary, tag IN (SELECT tag FROM d) OR tag IN ({', '.join(f"'{x}'" for x in T.KNOWN_INVALID_TAGS)}) AS ignored FROM used""")
def tag_sets(t):
    """Tags in use against the dictionary (html, math and old tags) and the ignore set (dictionary and known invalid tags)."""
    both = t.pages.select("page_id", "html").unionByName(t.tag_samples.select("page_id", "html"))
    used = M.explode_tokens(both).where(F.col("kind").isin("start", "startend")).select("tag").distinct()
    dictionary = tag_classes(t).select("tag").distinct().withColumn("d", F.lit(True))
    invalid = t.spark.createDataFrame([(x,) for x in T.KNOWN_INVALID_TAGS], "tag string").withColumn("i", F.lit(True))
    rows = used.join(F.broadcast(dictionary), "tag", "left").join(F.broadcast(invalid), "tag", "left")
    known = F.coalesce("d", F.lit(False))
    return rows.select("tag", known.alias("in_dictionary"), (known | F.coalesce("i", F.lit(False))).alias("ignored"))


@query("tag_spelling", sql=rf"""WITH {token_ctes('tag_samples')}, used AS (SELECT tag, count(*) AS n FROM tokens WHERE kind IN ('start', 'startend') GROUP BY tag),
  d AS (SELECT DISTINCT tag FROM {CLASS_VALUES} v(tag, class)),
  near AS (SELECT u.tag, min(d.tag) AS better FROM used u JOIN d ON levenshtein(u.tag, d.tag) = 1 GROUP BY u.tag)
  SELECT tag, n, CASE WHEN tag IN (SELECT tag FROM d) OR tag IN ({', '.join(f"'{x}'" for x in T.KNOWN_INVALID_TAGS)}) OR regexp_matches(tag, '^[-a-z_.]+:') THEN tag
    ELSE coalesce(better, nullif(regexp_extract(tag, '^([a-z][-a-z0-9.:_]*)', 1), ''), tag) END AS corrected FROM used LEFT JOIN near USING (tag)""")
def tag_spelling(t):
    """Unknown tags become the first dictionary tag one edit away; distinct tags only meet the dictionary."""
    tags = M.explode_tokens(t.tag_samples.select("page_id", "html")).where(F.col("kind").isin("start", "startend"))
    used = tags.groupBy("tag").agg(F.count("*").alias("n"))
    return used.select("tag", "n", M.corrected_tag(F.col("tag")).alias("corrected"))


@query("html_meta", sql=f"""WITH both_pages AS (SELECT page_id, url, html FROM pages UNION ALL SELECT page_id + 1000000000, url, html FROM tag_samples), {token_ctes('both_pages')}, {attr_ctes()}
  SELECT page_id, pos, max(CASE WHEN name = 'name' THEN value END) AS name, max(CASE WHEN name = 'http-equiv' THEN value END) AS http_equiv,
    max(CASE WHEN name = 'content' THEN value END) AS content, max(CASE WHEN name = 'charset' THEN value END) AS charset,
    bool_or(EXISTS (SELECT 1 FROM tokens t WHERE t.page_id = attrs.page_id AND t.kind = 'doctype' AND contains(t.text, 'XHTML'))) AS xhtml
  FROM attrs WHERE tag = 'meta' GROUP BY page_id, pos""")
def html_meta(t):
    samples = t.tag_samples.withColumn("page_id", F.col("page_id") + 1000000000)
    both = t.pages.select("page_id", "html").unionByName(samples.select("page_id", "html"))
    return M.meta_tags(both)


def corrected_ctes(source: str) -> str:
    """CTE ``tokens`` as ``token_ctes`` has it, with the names of tags corrected."""
    known = ", ".join(f"'{x}'" for x in T.KNOWN_INVALID_TAGS)
    return rf"""{token_ctes(source, 'u_')},
names AS (SELECT DISTINCT tag FROM u_tokens WHERE tag <> ''), dictionary AS (SELECT DISTINCT tag FROM {CLASS_VALUES} v(tag, class)),
closest AS (SELECT n.tag, min(d.tag) AS better FROM names n JOIN dictionary d ON levenshtein(n.tag, d.tag) = 1 GROUP BY n.tag),
spelled AS (SELECT n.tag AS was, CASE WHEN n.tag IN (SELECT tag FROM dictionary) OR n.tag IN ({known}) OR regexp_matches(n.tag, '^[-a-z_.]+:') THEN n.tag
  ELSE coalesce(better, nullif(regexp_extract(n.tag, '^([a-z][-a-z0-9.:_]*)', 1), ''), n.tag) END AS now FROM names n LEFT JOIN closest USING (tag)),
tokens AS (SELECT page_id, url, pos, kind, coalesce(now, tag) AS tag, CASE WHEN now <> tag THEN regexp_replace(text, '^(</?)[A-Za-z][^\s/>]*', '\1' || now) ELSE text END AS text
  FROM u_tokens LEFT JOIN spelled ON was = tag)"""


FEED_TAGS = "(" + ", ".join(f"'{t}'" for t in T.FEED_ALLOWED) + ")"
FEED_ATTRS = "(" + ", ".join(f"('{t}', '{n}')" for t, names in T.FEED_ALLOWED.items() for n in names) + ")"
def subset_ctes(source: str) -> str:
    """CTE ``subset(page_id, html)``: the feed subset of the HTML of a table."""
    return rf"""{corrected_ctes(source)}, {attr_ctes()},
tok AS MATERIALIZED (SELECT page_id, pos, kind, tag, text FROM tokens),
q AS MATERIALIZED (SELECT page_id, pos, string_agg(' ' || name || '="' || {CHAR_REFS.format("replace(replace(coalesce(value, ''), '&', '&amp;'), chr(34), '&quot;')")} || '"', '' ORDER BY apos) AS a
  FROM attrs WHERE (tag, name) IN {FEED_ATTRS} GROUP BY ALL),
walk(page_id, pos, stack, out) AS (SELECT DISTINCT page_id, -1, []::VARCHAR[], '' FROM tok UNION ALL
  SELECT t.page_id, t.pos,
    CASE WHEN t.kind = 'start' AND len(stack) = 0 AND t.tag NOT IN {FEED_TAGS} THEN [t.tag]
         WHEN t.kind IN ('start', 'startend') AND len(stack) > 0 THEN list_append(stack, t.tag)
         WHEN t.kind = 'end' AND len(stack) > 0 AND stack[-1] = t.tag THEN stack[:-2] ELSE stack END,
    CASE WHEN len(stack) > 0 THEN '' WHEN t.kind IN ('start', 'startend') AND t.tag NOT IN {FEED_TAGS} THEN ''
         WHEN t.kind = 'start' THEN '<' || t.tag || coalesce(q.a, '') || '>' WHEN t.kind = 'startend' THEN '<' || t.tag || coalesce(q.a, '') || '/>'
         WHEN t.kind = 'end' THEN '</' || t.tag || '>' WHEN t.kind = 'data' THEN t.text ELSE '' END
  FROM walk w JOIN tok t ON t.page_id = w.page_id AND t.pos = w.pos + 1 LEFT JOIN q ON q.page_id = t.page_id AND q.pos = t.pos),
subset AS (SELECT page_id, string_agg(out, '' ORDER BY pos) AS html FROM walk GROUP BY page_id)"""


SUBSET_SQL = f"""WITH both_pages AS (SELECT page_id, url, html FROM pages UNION ALL SELECT page_id + 1000000000, url, html FROM tag_samples),
{subset_ctes('both_pages')} SELECT page_id, html FROM subset"""


@query("html_safe_subset", sql=SUBSET_SQL)
def html_safe_subset(t):
    both = t.pages.select("page_id", "html").unionByName(t.tag_samples.select(F.col("page_id") + 1000000000, "html").toDF("page_id", "html"))
    return both.select("page_id", M.feed_subset(F.col("html")).alias("html"))


def _text_rules_sql() -> str:
    out = "text"
    for r, cond in zip(P.TEXT_RULES, ["doc_id % 5 <> 0", "doc_id % 3 = 0", "doc_id % 3 <> 1"]):
        search = r.search.replace("$&", "$&")
        out = f"(CASE WHEN {cond} THEN regexp_replace({out}, '{search}', '{r.replace.replace('$1', chr(92) + '1')}', 'g') ELSE {out} END)"
    return out


@query("text_replace", sql=f"SELECT doc_id, {_text_rules_sql()} AS text FROM documents")
def text_replace(t):
    """Documents served from three sites and in two types, rewritten by the rules that apply there."""
    from millrace.operators.replace import replace_text

    url = F.expr("'http://site.example' || CASE doc_id % 3 WHEN 0 THEN '/en/' WHEN 1 THEN '/de/' ELSE '/fr/' END")
    mime = F.expr("CASE WHEN doc_id % 5 = 0 THEN 'text/css' ELSE 'text/plain' END")
    return t.documents.select("doc_id", replace_text(F.col("text"), url, mime, rule_set(t).text_rules).alias("text"))


# The stages of the cleaning in order; the pages hold no tag with a security finding.
CLEAN_SQL = rf"""WITH {token_ctes(prefix='o_')},
tokens AS (SELECT page_id, url, pos, kind, tag, {REWRITE_CASE} AS text FROM o_tokens
  WHERE kind <> 'comment' OR (NOT regexp_matches(url, '/(en|de)/') AND text <> '<!---->')), {BLOCK_CTES},
numbered AS (SELECT b.page_id, p.url, regexp_replace(b.html, '([0-9]+)', '<\1>', 'g') AS html FROM blocks b JOIN pages p USING (page_id)),
upper_the AS (SELECT page_id, url, CASE WHEN contains(url, '/en/') THEN regexp_replace(html, '(?i)\bthe\b', 'THE', 'g') ELSE html END AS html FROM numbered),
cleaned AS (SELECT page_id, CASE WHEN contains(url, '/de/') THEN html ELSE regexp_replace(html, '[*#%$&]+', '', 'g') END AS html FROM upper_the)"""


@query("clean_pages", sql=CLEAN_SQL + " SELECT page_id, html FROM cleaned")
def clean_pages(t):
    from millrace.operators.cleaning import clean

    return clean(t.pages.select("page_id", "url", "html"), rule_set(t).tag_rules, rule_set(t).text_rules)
