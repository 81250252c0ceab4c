from pyspark.sql import functions as F

from millrace.functions import ratings as R
from millrace.operators import ratings as S


def test_parse_range(evaluate):
    got = evaluate(["", "-", "1", "1-", "-1", "1-1", "-1-", "5-3"], R.parse_range)
    assert [tuple(r) if r else None for r in got] == [
        (None, None), (None, None), (1, None), (1, None), (None, 1), (1, 1), None, (5, 5)]


def test_contains_range(spark):
    rows = [
        (1, 1, None, None, True), (None, None, 1, 1, True), (1, None, None, 1, True), (None, 1, 1, None, True), (1, 2, 1, 2, True),
        (0, 1, 1, 2, False), (1, 2, 1, 3, False), (1, 2, 0, None, False), (1, 2, None, 3, False), (1, 3, 4, 7, False),
    ]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, expected boolean")
    outer, inner = F.struct(F.col("a").alias("lo"), F.col("b").alias("hi")), F.struct(F.col("c").alias("lo"), F.col("d").alias("hi"))
    assert df.where(R.contains_range(outer, inner) != F.col("expected")).count() == 0


def test_longest_prefix_wins(spark):
    ratings = spark.createDataFrame([("http://a/", "root"), ("http://a/x", "deep"), ("http://b", "site")], "url string, v string")
    urls = spark.createDataFrame([("http://a/x/y?q",), ("http://a/z",), ("http://b/q",), ("http://c/",)], "url string")
    got = {r.url: r.rating and r.rating.v for r in S.lookup(urls, ratings).collect()}
    assert got == {"http://a/x/y?q": "deep", "http://a/z": "root", "http://b/q": "site", "http://c/": None}


def test_missing_category_is_skipped(spark):
    row = spark.createDataFrame([(None, "heavy", None, "none")], "age string, language string, sex string, violence string")
    reason = R.deny_reason(S.columns(), {"age": "18-", "violence": "none"})
    assert row.select(reason.alias("r")).first().r is None
    assert row.select(R.deny_reason(S.columns(), {"language": "mild"}).alias("r")).first().r == "language"
