"""Binary content and feed queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from millrace.operators import content as C
from millrace.operators import feeds as E
from millrace.plans.html_plans import subset_ctes
from millrace.plans.loaded import rule_set
from millrace.plans.registry import query
from millrace.session import fresh_path
from millrace.signatures import COMMON, MORE, read_signatures


def _blobs(t):
    """Contents of eight types, made from the page: head bytes with sizes, then the page itself."""
    n = F.col("page_id")
    width = F.when(n % 3 == 0, 468).when(n % 3 == 1, 88).otherwise(n % 1000 + 100)
    height = F.when(n % 3 == 0, 60).when(n % 3 == 1, 31).otherwise(n % 700 + 50)

    def be(x, w):
        return F.unhex(F.lpad(F.hex(x.cast("bigint")), w * 2, "0"))

    def le(x, w):
        h = F.lpad(F.hex(x.cast("bigint")), w * 2, "0")
        return F.unhex(F.concat(*[F.substring(h, w * 2 - 1 - 2 * i, 2) for i in range(w)]))

    def raw(x):
        return F.lit(x)

    gif = F.concat(raw(b"GIF89a"), le(width, 2), le(height, 2))
    png = F.concat(raw(b"\x89PNG\r\n\x1a\n\x00\x00\x00\x0dIHDR"), be(width, 4), be(height, 4))
    bmp = F.concat(raw(b"BM" + b"\x00" * 16), le(width, 4), le(height, 4))
    heads = [gif, png, bmp, raw(b"%PDF-1.4 "), raw(b"FWS\x05"), raw(b"\xff\xfb\x90"), raw(b"<?xml version='1.0'?>"), raw(b"")]
    head = heads[-1]
    for i, h in enumerate(heads[:-1]):
        head = F.when(n % 8 == i, h).otherwise(head)
    declared = F.expr(f"CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'application/x-javascript' WHEN 3 THEN 'text/html; charset=utf-8' ELSE 'text/plain' END")
    return t.pages.select(n.alias("blob_id"), F.concat(head, F.col("html").cast("binary")).alias("content"), declared.alias("declared"))


# First bytes in hexadecimal; a digest of the URL picks one and follows it, so that no formula gives the type away.
HEADS = ["474946383961", "89504e470d0a", "424d", "255044462d", "465753", "fffb", "3c3f786d6c20", "", "4d5a", "53414d50", "ffd8", "504b0304", "000001ba", "704a", "3c48546d6c", "00"]
DECLARED_SQL = "CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'application/x-javascript' WHEN 3 THEN 'text/html; charset=utf-8' ELSE 'text/plain' END"


def _mixed(t):
    """Contents that begin like many types, their declared type beside them."""
    digest = F.md5(F.col("url").cast("binary"))
    head = F.get(F.array(*[F.lit(h) for h in HEADS]), F.conv(F.substring(digest, 1, 1), 16, 10).cast("int"))
    body = F.when(F.conv(F.substring(digest, 2, 1), 16, 10).cast("int") < 12, F.unhex(F.concat(head, digest))).otherwise(F.unhex(head))
    return t.pages.select(F.col("page_id").alias("blob_id"), F.concat(body, F.col("html").cast("binary")).alias("content"), F.expr(DECLARED_SQL).alias("declared"))


@lru_cache(maxsize=2)
def _signatures(spark, application):
    """The signatures, written to a file and loaded from it as a user's file is."""
    path = fresh_path(spark, "signatures")
    lines = (COMMON + MORE).replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    spark.range(1).select(F.expr(f"'{lines}'").alias("value")).coalesce(1).write.text(path)
    return read_signatures(spark, path)


def signatures(t):
    return _signatures(t.spark, t.spark.sparkContext.applicationId)


def _rows_sql() -> str:
    """The signatures for the SQL: number, level, offset, bytes read, order, test, value as hexadecimal or number, mask."""
    out = []
    for i, line in enumerate(x for x in (COMMON + MORE).splitlines() if x):
        level = len(line) - len(line.lstrip(">"))
        at, kind, value, *mime = line[level:].split("\t")
        mask, sign = 0, ""
        for c in "&^":
            if c in kind:
                kind, m = kind.split(c)
                mask, sign = int(m, 0), c
        text, test = kind.startswith("string"), "="
        if value[0] in "=<>" and len(value) > 1:
            test, value = value[0], value[1:]
        test = "x" if value == "x" else test
        raw = value.replace("\\ ", " ").replace("\\<", "<").encode().decode("unicode_escape").encode("latin-1") if text else b""
        width = len(raw) if text else {"b": 1, "s": 2, "l": 4}[kind.removeprefix("u").removeprefix("be").removeprefix("le")[0]]
        number = 0 if text or test == "x" else int(value, 0)
        order = "text" if text else "big" if kind.startswith("be") else "little"
        told = (mime or [""])[0].replace("\\b", chr(8)) or chr(8)
        out.append((i, level, int(at), width, order, test, (raw.lower() if "/c" in kind else raw).hex(), number, mask, sign, "/c" in kind, told))
    return ", ".join("(" + ", ".join(str(v).lower() if isinstance(v, (int, bool)) else f"'{v}'" for v in row) + ")" for row in out)


BLOB_CTE = f"""sigs(n, level, off, width, endian, test, raw, number, mask, sign, fold, mime) AS (VALUES {_rows_sql()}),
ranked AS (SELECT *, max(CASE WHEN level = 0 THEN n END) OVER (ORDER BY n) AS grp, max(CASE WHEN level = 0 THEN n END) OVER (ORDER BY n) AS p0,
  max(CASE WHEN level = 1 THEN n END) OVER (ORDER BY n) AS p1 FROM sigs),
made AS (SELECT page_id AS blob_id, {DECLARED_SQL} AS declared, md5(url) AS d, html,
  [{', '.join(repr(h) for h in HEADS)}][('0x' || md5(url)[1])::INT + 1] AS h FROM pages),
contents AS (SELECT blob_id, declared, lower((h || CASE WHEN ('0x' || d[2])::INT < 12 THEN d ELSE '' END || hex(encode(left(html, 1024))))[1:2048]) AS x FROM made),
tried AS (SELECT blob_id, s.*, x[off * 2 + 1 : off * 2 + greatest(width, 1) * 2] AS piece FROM contents JOIN ranked s ON true),
valued AS (SELECT *, CASE WHEN endian = 'text' OR length(piece) < width * 2 THEN NULL
    WHEN endian = 'big' OR width = 1 THEN ('0x' || piece)::BIGINT
    WHEN width = 2 THEN ('0x' || piece[3:4] || piece[1:2])::BIGINT ELSE ('0x' || piece[7:8] || piece[5:6] || piece[3:4] || piece[1:2])::BIGINT END AS v0 FROM tried),
masked AS (SELECT *, CASE sign WHEN '&' THEN v0 & mask WHEN '^' THEN xor(v0, mask) ELSE v0 END AS v FROM valued),
held AS (SELECT *, coalesce(CASE
    WHEN endian = 'text' AND test = '=' THEN CASE WHEN fold THEN array_to_string(list_transform(regexp_extract_all(piece, '..'),
      lambda p: CASE WHEN p BETWEEN '41' AND '5a' THEN lower(hex(('0x' || p)::INT + 32)) ELSE p END), '') = raw ELSE piece = raw END
    WHEN endian = 'text' AND test = '>' THEN piece[1:2] NOT IN ('', '00')
    WHEN endian = 'text' AND test = '<' THEN piece <> '' AND piece[1:2] >= raw[1:2]
    WHEN test = '=' THEN v = number WHEN test = '>' THEN v > number WHEN test = '<' THEN v < number WHEN test = 'x' THEN v IS NOT NULL END, false) AS ok FROM masked),
first_group AS (SELECT blob_id, min(n) AS grp FROM held WHERE level = 0 AND ok GROUP BY blob_id),
mine AS (SELECT h.* FROM held h JOIN first_group f ON f.blob_id = h.blob_id AND f.grp = h.grp),
deep AS (SELECT m.*, m.ok AND (m.level < 2 OR p.ok) AS good FROM mine m LEFT JOIN mine p ON p.blob_id = m.blob_id AND p.n = m.p1 AND m.level = 2),
joined AS (SELECT blob_id, ltrim(string_agg(CASE WHEN good THEN mime END, ' ' ORDER BY n), chr(8)) AS words FROM deep GROUP BY blob_id),
blobs AS (SELECT blob_id, declared, nullif(regexp_extract(replace(words, ' ' || chr(8), ''), '^ *([^ ]*)', 1), '') AS sniffed FROM contents LEFT JOIN joined USING (blob_id))"""


def _sniffed(t):
    rows = _mixed(t)
    return rows.select("blob_id", "declared").join(C.sniff_all(rows, "blob_id", "content", signatures(t)), "blob_id")


@query("mime_sniff", sql=f"WITH {BLOB_CTE} SELECT blob_id, sniffed FROM blobs")
def mime_sniff(t):
    return C.sniff_all(_mixed(t), "blob_id", "content", signatures(t))


@query("mime_prefer", sql=f"""WITH {BLOB_CTE} SELECT blob_id, CASE WHEN sniffed IS NULL OR sniffed = declared OR declared LIKE 'application/%' OR starts_with(declared, sniffed || ';')
  OR (declared LIKE 'text/html%' AND sniffed IN ('text/plain', 'text/xml')) THEN declared ELSE sniffed END AS mime FROM blobs""")
def mime_prefer(t):
    rows = _sniffed(t)
    return rows.select("blob_id", F.when(C.preferred(F.col("sniffed"), F.col("declared")), F.col("sniffed")).otherwise(F.col("declared")).alias("mime"))


@query("mime_confusion", sql=f"WITH {BLOB_CTE} SELECT declared, sniffed, count(*) AS n FROM blobs GROUP BY ALL")
def mime_confusion(t):
    return _sniffed(t).groupBy("declared", "sniffed").agg(F.count("*").alias("n"))


@query("image_size_block", sql="""SELECT page_id AS blob_id, CASE page_id % 8 WHEN 0 THEN 'gif' WHEN 1 THEN 'png' ELSE 'bmp' END AS format,
  CASE page_id % 3 WHEN 0 THEN 468 WHEN 1 THEN 88 ELSE page_id % 1000 + 100 END AS width, CASE page_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 31 ELSE page_id % 700 + 50 END AS height,
  CASE WHEN page_id % 3 = 0 THEN 'wc.801' WHEN page_id % 3 = 1 AND page_id % 8 = 0 THEN 'wc.802' END AS sid FROM pages WHERE page_id % 8 < 3""")
def image_size_block(t):
    rows = _blobs(t).select("blob_id", C.image_size(F.col("content")).alias("s")).where(F.col("s").isNotNull())
    return rows.select("blob_id", "s.format", "s.width", "s.height", C.blocked_size(F.col("s"), rule_set(t).image_rules).alias("sid"))


def feeds(t):
    """One feed per page: RSS or RDF by page, the description holds escaped HTML of the page and of tag samples."""
    page = t.pages.select("page_id", "url", F.regexp_extract("html", r"(?s)(<h1>.*?</h1>)", 1).alias("h1"))
    rows = page.join(t.tag_samples.select("page_id", F.col("html").alias("sample")), "page_id")
    html = F.concat("h1", F.lit("<foo>gone</foo><p class='x'>kept <a href='/x' onclick='y'>link</a></p>"), F.col("sample"))
    escaped = F.replace(F.replace(html, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit("<item><title>a & b</title><description>"), escaped, F.lit("</description><link>"), "url", F.lit("</link></item>"))
    rss = F.concat(F.lit('<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel>'), item, F.lit("</channel></rss>"))
    rdf = F.concat(F.lit('<?xml version="1.0"?><rdf:RDF>'), item, F.lit("<textinput>x</textinput></rdf:RDF>"))
    return rows.select("page_id", "url", F.when(F.col("page_id") % 2 == 0, rss).otherwise(rdf).alias("xml"))


FEED_SQL = f"""WITH feed_html AS (SELECT p.page_id, p.url, regexp_extract(p.html, '(?s)(<h1>.*?</h1>)', 1)
    || '<foo>gone</foo><p class=''x''>kept <a href=''/x'' onclick=''y''>link</a></p>' || s.html AS html FROM pages p JOIN tag_samples s USING (page_id)),
{subset_ctes('feed_html')},
feed_items AS (SELECT page_id, '<item><title>a &amp; b</title><description><![CDATA[' || s.html || ']]></description><link>' || replace(p.url, '&', '&amp;') || '</link></item>' AS item
  FROM subset s JOIN pages p USING (page_id))
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<?xml version="1.0" encoding="UTF-8"?><rss><channel>' || item || '</channel></rss>'
  ELSE '<?xml version="1.0"?><rdf:RDF>' || item || '</rdf:RDF>' END AS xml FROM feed_items"""


@query("xml_feed_rewrite", sql=FEED_SQL)
def xml_feed_rewrite(t):
    rules = rule_set(t)
    return feeds(t).select("page_id", E.rewrite_feed(F.col("xml"), F.col("url"), rules.feed_rules, rules.tag_rules[1:2]).alias("xml"))
