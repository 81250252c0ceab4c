"""Rating queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import policy as P
from millrace.functions import ratings as R
from millrace.operators import ratings as S
from millrace.operators.ranking import with_row_number
from millrace.plans.html_plans import attr_ctes, token_ctes
from millrace.plans.loaded import rule_set
from millrace.plans.registry import query
from millrace.plans.url_plans import RATING_SAFE_SQL

RANGE_CASES = "CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN CAST(n_chars % 30 AS STRING) WHEN 2 THEN CAST(n_chars % 30 AS STRING) || '-' WHEN 3 THEN '-' || CAST(n_chars % 30 AS STRING) WHEN 4 THEN CAST(n_chars % 30 AS STRING) || '-' || CAST(n_chars % 17 AS STRING) WHEN 5 THEN 'x-3' WHEN 6 THEN '1-2-3' ELSE '-' END"


@query("rating_parse_range", sql="""SELECT doc_id, doc_id % 8 NOT IN (5, 6) AS valid,
  CAST(CASE WHEN doc_id % 8 IN (1, 2, 4) THEN n_chars % 30 END AS INTEGER) AS lo,
  CAST(CASE doc_id % 8 WHEN 3 THEN n_chars % 30 WHEN 4 THEN greatest(n_chars % 17, n_chars % 30) END AS INTEGER) AS hi FROM documents""")
def rating_parse_range(t):
    rows = t.documents.select("doc_id", R.parse_range(F.expr(RANGE_CASES)).alias("r"))
    return rows.select("doc_id", F.col("r").isNotNull().alias("valid"), "r.lo", "r.hi")


LOOKUP_CTES = rf"""
u AS (SELECT DISTINCT url FROM requests),
pre AS (SELECT url, {RATING_SAFE_SQL} AS safe FROM u),
best AS (SELECT p.url, max_by(r.url, len(r.url)) AS rated FROM pre p JOIN ratings r ON p.safe = r.url OR starts_with(p.safe, r.url || '/') GROUP BY p.url)"""


@query("rating_lookup", sql=f"WITH {LOOKUP_CTES} SELECT req_id, rated FROM requests LEFT JOIN best USING (url)")
def rating_lookup(t):
    return S.lookup(t.requests.select("req_id", "url"), t.ratings).select("req_id", F.col("rating.url").alias("rated"))


AGE_LO = "try_cast(regexp_extract(age, '^([0-9]+)', 1) AS INTEGER)"
AGE_HI = "try_cast(regexp_extract(age, '-([0-9]+)$', 1) AS INTEGER)"


def _over(category: str, value: str, limit: str) -> str:
    if category == "age":
        lo, hi = limit.split("-")
        fits = [f"(coalesce({n}, -1) <= {v} AND ({x} IS NULL OR {x} >= {v}))" for v in (lo, hi) if v for n, x in [(AGE_LO.replace("age", value), AGE_HI.replace("age", value))]]
        return f"({value} IS NOT NULL AND NOT ({' AND '.join(fits)}))"
    worse = R.DEGREES[R.DEGREES.index(limit) + 1:]
    return "coalesce(" + value + " IN (" + ", ".join(f"'{w}'" for w in worse or ["?"]) + "), false)"


def reason_sql(limits, prefix: str = "") -> str:
    return "CASE " + " ".join(f"WHEN {_over(c, prefix + c, limits[c])} THEN '{c}'" for c in R.CATEGORIES if c in limits) + " END"


CHECK_SQL = " UNION ALL ".join(f"SELECT url, '{sid}' AS sid, {reason_sql(limit)} AS reason FROM ratings" for sid, limit in P.RATING_LIMITS.items())


@query("rating_check", sql=f"SELECT url, sid, reason IS NULL AS allowed, reason FROM ({CHECK_SQL})")
def rating_check(t):
    return t.ratings.select("url", F.inline(S.check(S.columns(), rule_set(t).limits())))


@query("rating_denials", sql=f"""WITH {LOOKUP_CTES}, c AS ({CHECK_SQL})
  SELECT coalesce(sid, '') AS sid, coalesce(reason, 'missing rating') AS reason, count(*) AS n FROM requests r LEFT JOIN best b USING (url) LEFT JOIN c ON c.url = b.rated
  WHERE b.rated IS NULL OR c.reason IS NOT NULL GROUP BY ALL""")
def rating_denials(t):
    """Denied requests per rule and category, and requests without a rating."""
    rows = S.lookup(t.requests.select("url"), t.ratings)
    checks = S.check(S.columns("rating."), rule_set(t).limits())
    denied = F.filter(checks, lambda c: c["reason"].isNotNull())
    missing = F.array(F.struct(F.lit("").alias("sid"), F.lit("missing rating").alias("reason")))
    hits = F.when(F.col("rating").isNull(), missing).otherwise(
        F.transform(denied, lambda c: F.struct(c["sid"].alias("sid"), c["reason"].alias("reason")))
    )
    return rows.select(F.inline(hits)).groupBy("sid", "reason").agg(F.count("*").alias("n"))


@query("rating_defaults", sql=f"""SELECT url, {AGE_LO} AS age_min, CASE WHEN age IS NULL THEN 0 ELSE {AGE_HI} END AS age_max,
  coalesce(language, 'none') AS language, coalesce(sex, 'none') AS sex, coalesce(violence, 'none') AS violence FROM ratings""")
def rating_defaults(t):
    return S.with_defaults(t.ratings)


LONG_SQL = " UNION ALL ".join(f"SELECT url, '{c}' AS category, {c} AS value FROM ratings WHERE {c} IS NOT NULL" for c in R.CATEGORIES)
SPOILED = "CASE WHEN length(url) % 5 = 0 AND category = 'age' THEN value || 'x' WHEN length(url) % 5 = 1 AND category = 'sex' THEN 'much' ELSE value END"
RENAMED = "CASE WHEN length(url) % 7 = 0 AND category = 'violence' THEN 'gore' ELSE category END"


@query("rating_validate", sql=f"""WITH l AS ({LONG_SQL}), s AS (SELECT url, {RENAMED} AS category, {SPOILED} AS value FROM l)
  SELECT url, category, value, CASE category WHEN 'age' THEN regexp_full_match(value, '[0-9]*|[0-9]*-[0-9]*') WHEN 'gore' THEN false ELSE value IN ('none', 'mild', 'heavy') END AS valid FROM s""")
def rating_validate(t):
    rows = S.long_form(t.ratings).select("url", F.expr(RENAMED).alias("category"), F.expr(SPOILED).alias("value"))
    return rows.select("url", "category", "value", R.is_valid(F.col("category"), F.col("value")).alias("valid"))


@query("rating_from_headers", sql="SELECT req_id, lower(name)[10:] AS name, value FROM headers WHERE lower(name) LIKE 'x-rating-%'")
def rating_from_headers(t):
    return t.messages.select("req_id", F.inline(S.from_headers(F.col("response"))))


META_CTES = f"""{token_ctes('tag_samples')}, {attr_ctes()},
metas AS (SELECT page_id, pos, max(CASE WHEN name = 'name' THEN lower(value) END) AS n, max(CASE WHEN name = 'content' THEN value END) AS v FROM attrs WHERE tag = 'meta' GROUP BY ALL),
meta_ratings AS (SELECT page_id, pos, regexp_replace(n, '^x-rating-?', '') AS name, v AS value FROM metas WHERE n LIKE 'x-rating%')"""


@query("rating_from_meta", sql=f"WITH {META_CTES} SELECT page_id, pos, name, value FROM meta_ratings")
def rating_from_meta(t):
    return S.from_meta(t.tag_samples.select("page_id", "html"))


DECISION_LIMITS = P.RATING_LIMITS["wc.901"]


@query("rating_decision", sql=f"""WITH {LOOKUP_CTES}, {META_CTES},
h AS (SELECT req_id, max(CASE WHEN name = 'X-Rating' THEN value END) AS svc, max(CASE WHEN name = 'X-Rating-Age' THEN value END) AS age,
   max(CASE WHEN name = 'X-Rating-violence' THEN value END) AS violence FROM headers WHERE name LIKE 'X-Rating%' GROUP BY req_id),
m AS (SELECT page_id, max(CASE WHEN name = '' THEN value END) AS svc, max(CASE WHEN name = 'violence' THEN value END) AS violence FROM meta_ratings GROUP BY page_id),
j AS (SELECT r.req_id, CASE WHEN b.rated IS NOT NULL THEN 'store' WHEN h.svc = '{R.SERVICE}' THEN 'header' WHEN m.svc = '{R.SERVICE}' THEN 'page' ELSE 'none' END AS source,
   s.age AS s_age, s.language AS s_language, s.sex AS s_sex, s.violence AS s_violence, h.age AS h_age, h.violence AS h_violence, m.violence AS m_violence
   FROM requests r LEFT JOIN best b USING (url) LEFT JOIN ratings s ON s.url = b.rated LEFT JOIN h USING (req_id) LEFT JOIN m ON m.page_id = r.page_id),
v AS (SELECT req_id, source, CASE source WHEN 'store' THEN s_age WHEN 'header' THEN h_age END AS age, CASE source WHEN 'store' THEN s_language END AS language,
   CASE source WHEN 'store' THEN s_sex END AS sex, CASE source WHEN 'store' THEN s_violence WHEN 'header' THEN h_violence WHEN 'page' THEN m_violence END AS violence FROM j),
d AS (SELECT req_id, source, CASE WHEN source = 'none' THEN 'no rating data' ELSE {reason_sql(DECISION_LIMITS)} END AS reason FROM v)
SELECT req_id, source, reason IS NULL AS allowed, reason FROM d""")
def rating_decision(t):
    return S.decide(t.messages, t.ratings, t.tag_samples.select("page_id", "html"), rule_set(t).limits()["wc.901"])


@query("merge_ratings", sql="""WITH i AS (SELECT url, NOT generic AS generic, modified + CASE WHEN length(url) % 2 = 0 THEN 10 ELSE -10 END AS modified FROM ratings WHERE length(url) % 3 <> 0
   UNION ALL SELECT url || '/new', generic, modified FROM ratings WHERE length(url) % 4 = 0),
  b AS (SELECT url, generic, modified, 0 AS n FROM ratings UNION ALL SELECT url, generic, modified, 1 FROM i)
  SELECT url, generic, CAST(modified AS BIGINT) AS modified FROM b QUALIFY row_number() OVER (PARTITION BY url ORDER BY modified DESC, n DESC) = 1""")
def merge_ratings(t):
    store = t.ratings.select("url", "generic", F.col("modified").cast("bigint").alias("modified"))
    shift = F.when(F.length("url") % 2 == 0, 10).otherwise(-10)
    changed = store.where(F.length("url") % 3 != 0).select("url", (~F.col("generic")).alias("generic"), (F.col("modified") + shift).alias("modified"))
    added = store.where(F.length("url") % 4 == 0).select(F.concat("url", F.lit("/new")).alias("url"), "generic", "modified")
    return S.merge(store, changed.unionByName(added))


@query("ratings_slice", sql="SELECT url, modified::BIGINT AS modified FROM ratings ORDER BY url LIMIT 20 OFFSET 10")
def ratings_slice(t):
    return t.ratings.select("url", F.col("modified").cast("bigint").alias("modified")).orderBy("url").offset(10).limit(20)


PAGE_SIZE = 50
JUMPS = [-1000, -250, -50, 50, 250, 1000]


@query("rating_page", sql=f"""WITH r AS (SELECT url, row_number() OVER (ORDER BY url) AS rn, count(*) OVER () AS n FROM ratings)
  SELECT url, (rn - 1) // 50 AS page, array_to_string(list_filter(list_transform({JUMPS}, lambda j: (rn - 1) // 50 * 50 + j), lambda x: x >= 0 AND x < n), ' ') AS jumps FROM r""")
def rating_page(t):
    """Every rating with its page of fifty and the offsets one can jump to from there."""
    rows = with_row_number(t.ratings.select("url"), ["url"], out="rn", total="n")
    page = F.floor((F.col("rn") - 1) / PAGE_SIZE)
    targets = F.filter(F.array(*[page * PAGE_SIZE + j for j in JUMPS]), lambda x: (x >= 0) & (x < F.col("n")))
    return rows.select("url", page.alias("page"), F.array_join(targets.cast("array<string>"), " ").alias("jumps"))


@query("usage_retention", sql="""WITH u AS (SELECT url AS key, count(*) AS uses FROM requests GROUP BY url),
  r AS (SELECT *, row_number() OVER (ORDER BY uses, key) AS rn, count(*) OVER () AS n FROM u)
  SELECT key, uses FROM r WHERE rn > floor(0.95 * n)""")
def usage_retention(t):
    """Keys kept when a cache of used URLs overflows: the lowest 95 % by use count and key go."""
    used = t.requests.groupBy(F.col("url").alias("key")).agg(F.count("*").alias("uses"))
    rows = with_row_number(used, ["uses", "key"], out="rn", total="n")
    return rows.where(F.col("rn") > F.floor(F.lit(0.95) * F.col("n"))).select("key", "uses")
