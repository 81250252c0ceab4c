from pyspark.sql import functions as F

from millrace.functions import urls as U


def test_rating_prefixes(evaluate):
    site = "http://example.com"
    cases = {
        "": [], "a": [], "a/b": [],
        site: [site + "/", site], site + "//": [site + "/", site],
        site + "/?q=a": [site + "/", site], site + "/?q=a#a": [site + "/", site],
        site + "/a/b//c": [site + p for p in ("/a/b/c", "/a/b/", "/a/b", "/a/", "/a", "/", "")],
        site + "/forum": [site + p for p in ("/forum", "/", "")],
        site + "/forum/": [site + p for p in ("/forum", "/", "")],
    }
    assert evaluate(list(cases), U.rating_prefixes) == list(cases.values())


def test_norm_known_forms(evaluate):
    cases = {
        "HTTP://Example.COM:80/a/../b/./c": "http://example.com/b/c",
        "http://example.com": "http://example.com",
        "http://example.com?a=b": "http://example.com/?a=b",
        "http://example.com./%7ex": "http://example.com/~x",
        "http://example.com/a%2fb": "http://example.com/a/b",
        "http://example.com/%e4 x": "http://example.com/%E4%20x",
        "http://example.com\\dir\\file": "http://example.com/dir/file",
        "https://u:p@Example.com:443/": "https://u:p@example.com/",
        "http://example.com:8080//x//": "http://example.com:8080/x/",
        "http://example.com/?a=b;c=d&e": "http://example.com/?a=b;c=d&e",
        "http://example.com/#": "http://example.com/#",
    }
    assert evaluate(list(cases), U.url_norm) == list(cases.values())


def test_norm_is_idempotent(tables):
    rows = tables.url_cases.select(U.url_norm(F.col("url")).alias("once")).select("once", U.url_norm(F.col("once")).alias("twice"))
    # a stray percent sign is quoted again by every pass
    assert rows.where(~F.contains("once", F.lit("%25"))).where("once <> twice").count() == 0


def test_collapse_segments(evaluate):
    cases = {
        "/a/b/../c": "/a/c", "/a/..": "/", "/../../x": "/x", "/..": "/..", "../x": "../x", "a/../b": "b",
        "a/b/..": "a/", "./x": "x", "/x/.": "/x/", "//a///b": "/a/b", "\\a\\..\\b": "/b",
    }
    assert evaluate(list(cases), U.collapse_segments) == list(cases.values())


def test_long_urls(evaluate):
    urls = ["x" * 1024, "x" * 1025, "x" * 8192, "x" * 8193, "x" * 65536]
    assert evaluate(urls, U.length_class) == ["ok", "warn", "warn", "reject", "reject"]


def test_ports(evaluate):
    got = evaluate(["h", "h:1", "h:0", "h:65535", "h:65536", "h:x"], lambda c: U.split_port(c, F.lit(80))["port"])
    assert got == [80, 1, 80, 65535, 80, 80]


def test_safety_of_long_urls(evaluate):
    long = "http://example.com/" + "a" * 100_000
    assert evaluate([long, long + "%2", long + "?q", long + "#" + "b" * 100_000], lambda c: U.is_safe(c, "url")) == [True, False, False, True]
    assert evaluate(["a=" + "b" * 100_000, "a&b=/c", "a==b", ""], lambda c: U.is_safe(c, "query")) == [True, True, False, True]


def test_long_pages_are_tokenised(evaluate):
    from millrace.operators import html as M

    html = "<script>" + "x<y;" * 50_000 + "</script><p title='" + "t" * 100_000 + "'>" + "word " * 50_000
    got = evaluate([html], lambda c: F.transform(M.tokens(c), lambda t: t["kind"]))[0]
    assert got == ["start", "data", "end", "start", "data"]
