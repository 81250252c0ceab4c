from pyspark.sql import functions as F

from millrace import policy as P
from millrace.functions.rules import expand, numbered_groups
from millrace.operators import feeds as E
from millrace.operators import html as M
from millrace.operators import security as S
from millrace.operators.cleaning import clean


def texts(tokens):
    return F.array_join(F.transform(tokens, lambda t: t["text"]), "")


def test_tokens_lose_nothing(tables):
    for df in (tables.pages.select("html"), tables.tag_samples.select("html")):
        assert df.where(texts(M.tokens(F.col("html"))) != F.col("html")).count() == 0


def test_token_kinds(evaluate):
    html = "<!DOCTYPE x><P a=1>t<br/><!-- c --><script>if (a<b) '</p>'</script></P><?pi?>< 5"
    got = evaluate([html], M.tokens)[0]
    assert [(t.kind, t.tag) for t in got] == [
        ("doctype", ""), ("start", "p"), ("data", ""), ("startend", "br"), ("comment", ""), ("start", "script"), ("data", ""),
        ("end", "script"), ("end", "p"), ("pi", ""), ("data", ""), ("data", "")][: len(got)]


def kinds(evaluate, html):
    got = evaluate([html], M.tokens)[0]
    assert "".join(t.text for t in got) == html
    return [(t.kind, t.text) for t in got]


def test_quotes_in_tags(evaluate):
    assert kinds(evaluate, '<a title="x>y" href="z">t') == [("start", '<a title="x>y" href="z">'), ("data", "t")]
    assert kinds(evaluate, "<a b = 'x>\"y' c>t") == [("start", "<a b = 'x>\"y' c>"), ("data", "t")]
    # quotes that do not begin a value, and those never closed, are plain signs
    assert kinds(evaluate, "<p don't>x'>") == [("start", "<p don't>"), ("data", "x'>")]
    assert kinds(evaluate, '<a b="x>y') == [("start", '<a b="x>'), ("data", "y")]
    assert kinds(evaluate, '<br title=">"/>1 < 2 <3>') == [("startend", '<br title=">"/>'), ("data", "1 "), ("data", "<"), ("data", " 2 "), ("data", "<"), ("data", "3>")]
    assert kinds(evaluate, '<script a=">">if (a<b) "</p>"</script >x')[:3] == [("start", '<script a=">">'), ("data", 'if (a<b) "</p>"'), ("end", "</script >")]
    assert evaluate(['<a title="x>y" href="z">'], lambda c: M.attributes(M.tokens(c)[0]["text"]))[0] == [("title", "x>y"), ("href", "z")]


def test_what_is_never_closed(evaluate):
    assert kinds(evaluate, "a<!-- b <i>c</i>") == [("data", "a"), ("data", "<!-- b <i>c</i>")]
    assert kinds(evaluate, "<script>x<b>") == [("start", "<script>"), ("data", "x<b>")]
    assert kinds(evaluate, "<b>x<a href='y") == [("start", "<b>"), ("data", "x"), ("data", "<a href='y")]
    assert kinds(evaluate, "x<") == [("data", "x"), ("data", "<")]


def test_long_pages_in_linear_time(evaluate):
    import time

    evaluate(["<p>"], M.tokens)
    for part in ["<", "<!--", "<a b='", '<a b=">" ', "<script>", "<a =", "<p class='a>b'>x</p>", "<!-- x>"]:
        start = time.perf_counter()
        evaluate([part * (1_000_000 // len(part))], lambda c: F.size(M.tokens(c)))
        assert time.perf_counter() - start < 20, part


def test_attributes(evaluate):
    got = evaluate(["<a HREF='x y' b=1 c d=\"&quot;q&amp;\" e=''>"], M.attributes)[0]
    assert [tuple(a) for a in got] == [("href", "x y"), ("b", "1"), ("c", None), ("d", '"q&'), ("e", "")]


def test_spelling(evaluate):
    got = evaluate(["blink", "bllnk", "htmm", "hrr", "xmlns:a", "heisead"], M.corrected_tag)
    assert got == ["blink", "blink", "html", "hr", "xmlns:a", "heisead"]


def blocks(evaluate, html, *rules, **options):
    return evaluate([html], lambda c: M.rewrite_blocks(M.tokens(c), F.lit("http://h/"), rules, **options))[0]


def test_element_rules(evaluate):
    ad = P.TagRule("r", "div", "complete", (("class", "^ad"),), "X")
    assert blocks(evaluate, '<p><div class="ad">a<div>b</div>c</div>d', ad) == "<p>Xd"
    assert blocks(evaluate, '<div class="ad">never closed', ad) == '<div class="ad">never closed'
    assert blocks(evaluate, '<div class="ad"><div class="ad">i</div></div>e', ad) == "Xe"
    inner = P.TagRule("r", "b", "enclosed", (), "new")
    assert blocks(evaluate, "<b>one</b>-<b>two</b>", inner) == "<b>new</b>-<b>new</b>"
    matched = P.TagRule("r", "i", "matched", (), "NEW", "o+")
    assert blocks(evaluate, "<i>foo boo</i>", matched) == "<i>f boo</i>"
    assert blocks(evaluate, "<i>foo boo</i>", matched, replace_matched=True) == "<i>fNEW boo</i>"
    assert blocks(evaluate, "<i>none</i><i>xyz</i>", P.TagRule("r", "i", "complete", (), "", "x.z")) == "<i>none</i>"


def test_start_tag_rules(evaluate):
    def run(html, *rules):
        return evaluate([html], lambda c: texts(M.rewrite_start_tags(M.tokens(c), F.lit("http://h/"), rules)))[0]

    link = P.TagRule("r", "a", "attrval", (("href", "to=(.*)"),), "\\1")
    assert run('<a href="x?to=y" id=1>', link) == '<a href="y" id="1">'
    assert run('<a name="x">', link) == '<a name="x">'
    assert run("<center>x</center>", P.TagRule("r", "center", "tagname", (), "div")) == "<div>x</div>"
    assert run('<p align="l">', P.TagRule("r", "p", "attrname", (("align", "l"),), "style")) == '<p style="l">'
    assert run('<p align="l">', P.TagRule("r", "p", "attr", (("align", "l"),), 'a="1" b="2"')) == '<p a="1" b="2">'
    assert run('<img src="x">t', P.TagRule("r", "img", "complete", (("src", "x"),))) == "t"
    # the end tag follows the start tag that fired, and no other
    size = P.TagRule("r", "font", "tagname", (("size", "1"),), "span")
    assert run('<font size="1">x</font>', size) == '<span size="1">x</span>'
    assert run('<font><font size="1">x</font>y</font></font>', size) == '<font><span size="1">x</span>y</font></font>'
    assert run('<font size="1">open', size) == '<span size="1">open'
    mark = P.TagRule("r", "b", "tag", (("class", "k"),), "*")
    assert run('<b>a<b class="k">c</b></b>', mark, size) == "<b>a*c*</b>"


def test_named_groups(evaluate):
    def run(html, *rules):
        return evaluate([html], lambda c: texts(M.rewrite_start_tags(M.tokens(c), F.lit("http://h/"), rules)))[0]

    link = P.TagRule("r", "a", "attrval", (("href", r"[?&](to|go)=(?P<url>http%3[aA][^&]+)"),), r"\g<url>")
    assert run('<a href="/r?x=1&amp;go=http%3A%2F%2Fh.example%2Fa&amp;y">', link) == '<a href="http://h.example/a">'
    assert run('<a href="/r?x=1">', link) == '<a href="/r?x=1">'
    assert numbered_groups(r"(a)(?P<b>[(]x\()(?:c)(?P<d>e)(?P=b)1") == (r"(a)([(]x\()(?:c)(e)\2(?:)1", {"b": 2, "d": 3})
    assert evaluate(["k=v;w"], lambda c: expand(c, r"(?P<key>\w)=(?P<val>\w)", r"\g<val>-\1-\g<2>"))[0] == "v-k-v"


def test_repair(evaluate):
    def run(html):
        return evaluate([html], lambda c: texts(S.repaired(M.tokens(c))))[0]

    assert run('<img src="javascript:x" alt="a">') == '<img alt="a">'
    assert run('<td width="12345" id="k">') == '<td id="k">'
    assert run('<object type="a//b"></object>') == '<object type="a/b"></object>'
    deep = "<object>" * 5 + "</object>" * 5
    assert run(deep) == "<object>" * 3 + "</object>" * 5
    assert run("<p class=fine>") == "<p class=fine>"
    # tags without any value are looked at as well
    assert run("<p " + " ".join(f"a{i}" for i in range(205)) + ">") == "<p " + " ".join(f"a{i}" for i in range(200)) + ">"
    assert run("<input type>") == "<input>" and run("<br/>") == "<br/>"


def test_clean_pages_drops_what_the_rules_name(tables):
    out = clean(tables.pages.select("page_id", "url", "html"))
    assert out.count() == tables.pages.count()
    assert out.where(F.contains("html", F.lit("<script>"))).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan


def test_names_and_scripts_are_cleaned(spark):
    html = "<htmm><bllnk>x</bllnk><script><!--\n// note\nrun();\n//--></script><q:a/>"
    pages = spark.createDataFrame([(1, "http://h/", html), (2, "http://k/", html)], "page_id int, url string, html string")
    got = {r.page_id: r.html for r in clean(pages, (), (), (), script_urls=("h/",)).collect()}
    assert got[1].startswith("<html><blink>x</blink><script>") and "run();" in got[1] and "note" not in got[1] and "note" in got[2]
    assert got[1].endswith("</script><q:a/>")


def test_exempt_pages_stay(tables):
    pages = tables.pages.select("page_id", "url", "html", (F.col("page_id") % 2 == 0).alias("free"))
    out = clean(pages, exempt="free").join(tables.pages.select("page_id", F.col("html").alias("was")), "page_id")
    assert out.where("page_id % 2 = 0 AND html <> was").count() == 0


FEED = """<?xml version="1.0" encoding="ISO-8859-1"?>
<rss version="2.0"><channel>
<item><title>Weather</title>
<description>Rain at noon. {0}</description>
</item>
</channel></rss>"""


def described(evaluate, html, rules=()):
    """What becomes of HTML in a description."""
    escaped = html.replace("&", "&amp;").replace("<", "&lt;")
    got = evaluate([FEED.format(escaped)], lambda c: E.rewrite_feed(c, F.lit("http://h/"), E.FEED_RULES, rules))[0]
    head, tail = FEED.replace("ISO-8859-1", "UTF-8").split("Rain at noon. {0}")
    assert got.startswith(head) and got.endswith(tail)
    return got[len(head) : len(got) - len(tail)]


def test_feeds(evaluate):
    said = lambda html: f"<![CDATA[Rain at noon. {html}]]>"
    assert described(evaluate, "<marquee>a<p>b<marquee>c</marquee></p></marquee>d") == said("d")
    assert described(evaluate, '<a href="/x" style="y" title=\'t\' onclick="z">k</a>') == said('<a href="/x">k</a>')
    assert described(evaluate, "<b>open <i>tags") == said("<b>open <i>tags")
    assert described(evaluate, "see ]]> <b>x</b>") == "Rain at noon. see ]]&gt; &lt;b>x&lt;/b>".replace("&gt;", ">")
    shop = P.TagRule("r", "p", "complete", (("class", "^promo"),))
    assert described(evaluate, '<p class="promo-1">buy <b>now</b></p><p class="x">stay</p>', [shop]) == said('<p>stay</p>')


def test_feed_remove_and_attribute_selector(evaluate):
    rules = [E.FeedRule("r", "/a/b[k=1]", "remove")]
    got = evaluate(['<a><b k="1">x<c/></b><b k="2">y</b></a>'], lambda c: E.rewrite_feed(c, F.lit(""), rules))
    assert got == ['<a><b k="2">y</b></a>']


def test_feed_paths(evaluate):
    def run(xml, *rules):
        return evaluate([xml], lambda c: E.rewrite_feed(c, F.lit("http://h/"), rules))[0]

    remove = E.FeedRule("r", "a/b", "remove")
    assert run("<r><a><b>x<b>y</b></b>z</a><b>k</b></r>", remove) == "<r><a>z</a><b>k</b></r>"
    assert run("<r><a><b>x", remove) == "<r><a>"
    assert run('<r><a t="x>y"><b/><c>1</c></a></r>', remove) == '<r><a t="x>y"><b/><c>1</c></a></r>'
    assert run("<a><b>1</b></a>", E.FeedRule("r", "a/b", "remove", nomatchurls=("h/",))) == "<a><b>1</b></a>"
    both = [E.FeedRule("r", "/f/e"), E.FeedRule("s", "/f/g", "remove")]
    assert run("<f><e>&lt;u>x&lt;/u>y<i>z</i><!-- c --></e><g>w</g></f>", *both) == "<f><e><![CDATA[y]]><i><![CDATA[z]]></i><!-- c --></e></f>"


def test_long_feeds_in_linear_time(evaluate):
    import time

    def seconds(items):
        feed = "<rss><channel>" + "<item><title>t</title><description>&lt;b>x&lt;/b></description><x>1</x></item>" * items + "</channel></rss>"
        start = time.perf_counter()
        got = evaluate([feed], lambda c: E.rewrite_feed(c, F.lit(""), E.FEED_RULES))[0]
        assert got.count("<![CDATA[<b>x</b>]]>") == items
        return time.perf_counter() - start

    seconds(10)
    few, many = seconds(2_000), seconds(20_000)  # the longer one has 220,000 tokens
    assert many < 15 * max(few, 1)
