from datetime import datetime

from millrace.functions import http as H
from millrace.functions import net as N
from millrace.functions import text as X
from pyspark.sql import functions as F


def test_version(evaluate):
    got = evaluate(["HTTP/0.0", "foo", "HTTP/01.1", "HTtP/1.01", "HTTP/-1.1"], H.http_version)
    assert [tuple(v) for v in got] == [(0, 0), (2, 0), (1, 1), (1, 1), (2, 0)]


def test_request_line(evaluate):
    got = evaluate(["GET / HTTP/1.1", "GET  /  HTTP/1.1", " GET  /  HTTP/1.1 ", "GET /"], H.request_line)
    assert [tuple(v) for v in got] == [("GET", "/", 1, 1)] * 3 + [("", "", 2, 0)]


def test_status_line(evaluate):
    got = evaluate(["HTTP/1.1 200 foo", "HTTP/1.1 -200 foo", "HTTP/1.1 999 glork bla", "HTTP/1.0 299", ""], H.status_line)
    assert [tuple(v) for v in got] == [(1, 1, 200, "OK")] * 3 + [(1, 0, 299, "Bummer"), (1, 0, 200, "OK")]


def test_warning(evaluate):
    got = evaluate(
        ['119 smee "hulla" "Sat, 12 Feb 2005 11:12:13 GMT"', '119 smee "wulla"', "110 Response is stale", "x y", r'1 a "b\" \\ c" '],
        H.warning,
    )
    assert tuple(got[0]) == (119, "smee", "hulla", datetime(2005, 2, 12, 11, 12, 13))
    assert tuple(got[1]) == (119, "smee", "wulla", None)
    assert tuple(got[2]) == (110, "", "Response is stale", None)
    assert got[3] is None
    assert got[4].text == 'b" \\ c'


def test_dates(evaluate):
    cases = {
        "Sat, 12 Feb 0005 11:12:13 GMT": "0005-02-12 11:12:13", "Sat, 01 Nov 2099 01:02:03 GMT": "2099-11-01 01:02:03",
        "Tue, 99 Feb 2000 12:13:14 GMT": None, "Saturday, 12-Feb-09 11:12:13 GMT": "2009-02-12 11:12:13",
        "Saturday, 01-Nov-05 01:02:03 GMT": "2005-11-01 01:02:03", "Tuesday, 99-Feb-98 12:13:14 GMT": None,
        "Sat Feb 12 11:12:13 2005": "2005-02-12 11:12:13", "Sat Nov  1 01:02:03 2099": "2099-11-01 01:02:03",
        "Tue Feb 99 12:13:14 2000": None,
    }
    assert evaluate(list(cases), lambda c: H.http_date(c).cast("string")) == list(cases.values())


def test_characters(evaluate):
    texts = ["These \x84Microsoft\x93 \x94chars\x94 are history.", "\x91Retter\x92 Majak", "\x00"]
    got = evaluate(texts, lambda c: X.fix_chars(c, F.lit(None).cast("string")))
    assert got == ['These "Microsoft" "chars" are history.', "`Retter' Majak", " "]


def test_entities(evaluate):
    got = evaluate(["a&amp;b", "&#65;&#x42;&#X43;", "&nosuch;x", "&amp;amp;", "no"], X.resolve_entities)
    assert got == ["a&b", "ABC", "x", "&amp;", "no"]


def test_reverse_names(evaluate):
    got = evaluate(["127.0.0.1", "::1", "host"], N.reverse_name)
    assert got == ["1.0.0.127.in-addr.arpa.", "1." + "0." * 31 + "ip6.arpa.", None]
    assert evaluate([got[1]], N.reverse_addr) == ["0:0:0:0:0:0:0:1"]


def test_networks(evaluate):
    got = evaluate(["10.1.2.3/8", "10.1.2.3/255.255.255.0", "10.1.2.3/33", "10.1.2.3", "10.1.2.3/0"], N.net_range)
    assert [tuple(r) if r else None for r in got] == [
        (167772160, 184549375), (167838208, 167838463), None, None, (0, 4294967295)]
