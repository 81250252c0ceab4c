import gzip

from pyspark.sql import functions as F

from millrace.operators import content as C
from millrace.signatures import COMMON, parse_signatures, read_signatures
from millrace.sources import rules_xml as X
from millrace.sources import text_files as S

FOLDER = """<?xml version="1.0" encoding="iso-8859-1"?>
<!DOCTYPE folder SYSTEM "filter.dtd">
<folder sid="own.7" oid="12">
<title lang="en">Größe</title>
<block sid="own.8" url="http://tracker[0-9]+\\.invalid/">
  <title lang="fr">Pisteurs</title>
  <title lang="en">Trackers &lt;and more&gt;</title>
</block>
<htmlrewrite sid="own.9" disable="1"
 tag="marquee">
  <nomatchurl>museum\\.invalid</nomatchurl>
  <nomatchurl>archive\\.invalid</nomatchurl>
  <attr name="scrollamount">[0-9]+</attr>
  <replacement part="tag"/>
</htmlrewrite>
<nocomments sid="own.10" />
<header sid="own.11" name="X-Own"><title lang="en">c / d</title></header>
</folder>
"""


def test_rule_folders(spark, tmp_path):
    (tmp_path / "a.zap").write_text(FOLDER, encoding="iso-8859-1")
    (tmp_path / "empty.zap").write_text("")
    rows = X.read_folders(spark, str(tmp_path)).orderBy("oid").collect()
    assert [(r.kind, r.sid, r.oid, r.disable) for r in rows] == [("block", "own.8", 0, False), ("htmlrewrite", "own.9", 1, True), ("nocomments", "own.10", 2, False), ("header", "own.11", 3, False)]
    assert rows[0].titles == {"fr": "Pisteurs", "en": "Trackers <and more>"} and rows[0].folder_oid == 12 and rows[3].name == "X-Own"
    assert rows[1].nomatchurls == ["museum\\.invalid", "archive\\.invalid"] and rows[1].part == "tag" and rows[1].tag == "marquee"


def test_lists(spark, tmp_path):
    folder = tmp_path / "kind=blockdomains" / "sid=wc.1"
    folder.mkdir(parents=True)
    with gzip.open(folder / "domains.gz", "wt") as f:
        f.write("# comment\n  ads.example \n\nbad.example\n")
    rows = S.read_lists(spark, str(tmp_path)).collect()
    assert sorted((r.kind, r.sid, r.entry) for r in rows) == [("blockdomains", "wc.1", "ads.example"), ("blockdomains", "wc.1", "bad.example")]


def test_wildcards(spark, tmp_path):
    text = "before http://x\n__DATA__\n# note\nPASS http://a/*.gif\nNOZAP http://b/**\nPRINT http://c/(*)/** http://c/p/${1}\nAD http://d/**/ads?x+*\n"
    (tmp_path / "list.txt").write_text(text)
    rows = S.import_wildcards(S.read_lines(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r.kind, r["class"], r.pattern, r.replacement, r.disabled) for r in rows] == [
        ("allow", "PASS", r"http://a/[^/]*\.gif", "", False),
        ("block", "PRINT", r"http://c/([^/]*)/.*", r"http://c/p/\1", True),
        ("block", "AD", r"http://d/.*/ads\?x\+[^/]*", "", False),
    ]


def test_rating_stanzas(spark, tmp_path):
    (tmp_path / "rating.txt").write_text(
        "generic true\nage 4-\nmodified 1234567\nsex 1\nurl http://one.example/\nviolence 0\nlanguage 2\n\n"
        "Sex 0\nAGE 17-\ngeneric false\nURL http://two.example/\n")
    rows = {r.url: r for r in S.read_ratings(spark, str(tmp_path)).collect()}
    one, two = rows["http://one.example/"], rows["http://two.example/"]
    assert (one.age, one.language, one.violence, one.sex, one.generic, one.modified) == ("4-", "heavy", "none", "mild", True, 1234567)
    assert (two.age, two.sex, two.language, two.generic) == ("17-", "none", None, False)


def test_hosts_and_topics(spark, tmp_path):
    (tmp_path / "hosts").write_text("# c\n127.0.0.1\tLocalhost loop # x\n\n10.0.0.1 a\n")
    assert sorted(tuple(r) for r in S.read_hosts(spark, str(tmp_path / "hosts")).collect()) == [("10.0.0.1", "a"), ("127.0.0.1", "localhost"), ("127.0.0.1", "loop")]
    (tmp_path / "dump").write_text('<Topic r:id="Top/Arts/X">\n <a/>\n</Topic>\n<Topic r:id="Top/Kids_and_Teens/Y">\n <b/>\n</Topic>\n<out/>\n<Topic r:id="Top">\n<c/>\n</Topic>\n')
    rows = S.read_topics(spark, str(tmp_path / "dump"), "kids_and_teens").collect()
    assert [r.line for r in rows] == ['<Topic r:id="Top/Kids_and_Teens/Y">', "<b/>"]


def test_sniffing(spark):
    table = parse_signatures(COMMON)
    contents = [b"GIF89a....", b"<HTML><body>", b"\x89PNG\r\n", b"FWS\x05abc", b"\xff\xfb\x90\x00\x00", b"plain text", b"GIF", b"<!doctype html>"]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "i int, c binary")
    got = [r.m for r in df.select("i", C.sniff(F.col("c"), table).alias("m")).orderBy("i").collect()]
    assert got == ["image/gif", "text/html", "image/png", "application/x-shockwave-flash", "audio/mpeg", None, None, "text/html"]


SIGNS = r"""
0	string	AB
>2	byte	>1	x/one
>>3	leshort&0xff	0x10	\b-two
>>3	string	<4	three
>2	byte	x	\b+
0	string	>\0	x/text
"""


def test_signature_tables(spark):
    table = parse_signatures(COMMON + SIGNS)
    contents = [
        b"AB\x05\x10\x00", b"AB\x05455", b"AB\x01\x10\x00", b"AB\x00zz", b"\x00nothing", b"GIF89a", b"<HtMl x", b"abc", None, b"", b"\x00\x00\x01\xba\x00", b"FWS\x05abc",
    ]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c), "x") for i, c in enumerate(contents)], "i int, c binary, grp string")
    want = ["x/one-two+", "x/one", "+", "+", None, "image/gif", "text/html", None, None, None, "video/mpeg", "application/x-shockwave-flash"]
    assert {r.i: r.sniffed for r in C.sniff_all(df, "i", "c", table).collect()} == dict(enumerate(want))
    # the expression gives what the tables give
    assert [r.m for r in df.select("i", C.sniff(F.col("c"), table).alias("m")).orderBy("i").collect()] == want
    assert C.sniff_all(df.limit(0), "i", "c", table).count() == 0


def test_signature_file(spark, tmp_path):
    (tmp_path / "signs").write_text(SIGNS + "# note\n0\tregex\tx\ty\n>(4.l)\tbyte\t1\tz\n0\tshort\t0x0201\tx/native\n", encoding="latin-1")
    rows = read_signatures(spark, str(tmp_path / "signs"))
    assert [r.mime for r in rows][-2:] == ["x/text", "x/native"]
    df = spark.createDataFrame([(0, bytearray(b"\x01\x02\x00\x00\x00"))], "i int, c binary")
    assert df.select(C.sniff(F.col("c"), rows[-1:])).first()[0] == "x/native"


def test_signature_levels():
    rows = parse_signatures("0\tstring\tAB\n>2\tbyte\t>1\tx/one\n>>3\tleshort&0xff\t0x10\tx/two\n0\tregex\tfoo\tbad\n0\tstring\t!no\tbad\n")
    assert [(r.level, r.test, r.mime) for r in rows] == [(0, "=", "\b"), (1, ">", "x/one"), (2, "=", "x/two")]


def test_large_folders_are_split(spark, tables, tmp_path):
    rules = tables.rules
    X.write_folders(rules, str(tmp_path / "out"), rows=7)
    back = X.read_folders(spark, str(tmp_path / "out"))
    assert back.select("file").distinct().count() > rules.select("folder_sid").distinct().count()
    order = back.orderBy("folder_sid", "oid").select("folder_sid", "kind", "sid").collect()
    assert order == rules.orderBy("folder_sid", "oid").select("folder_sid", "kind", "sid").collect()


def test_folder_numbers_and_titles(spark):
    from millrace.operators.rules import localised

    rows = spark.createDataFrame([("b", 5), ("a", None), ("c", 2)], "folder_sid string, folder_oid int")
    assert {r.folder_sid: r.folder_oid for r in X.number_folders(rows).collect()} == {"c": 0, "b": 1, "a": 2}
    texts = spark.sql("SELECT map('en', 'E', 'de', 'D') AS m UNION ALL SELECT map('fr', 'F') UNION ALL SELECT cast(map() AS map<string,string>)")
    got = texts.select(localised(F.col("m"), "de").alias("t")).collect()
    assert [r.t for r in got] == ["D", "F", ""]


def test_rules_of_every_kind_come_back(spark, tables, tmp_path):
    import pytest

    from millrace import policy as P
    from millrace.operators import feeds as E
    from millrace.plans.loaded import rule_set, scoped_rules
    from millrace.sources.compiled import RuleSet, compile_rules, compile_scopes, write_rule_set, write_scopes

    odd = P.TagRule("o.1", "p", "attr", (("title", ""), ("class", "a<b>&'\"")), "x\ny", "m & n", ("u<v",), ("w",))
    own = RuleSet(
        tuple(P.ALLOW_PATTERNS), tuple(P.BLOCK_PATTERNS), tuple(P.HEADER_RULES), tuple(P.TEXT_RULES), (*P.TAG_RULES, odd), tuple(P.IMAGE_RULES),
        (*P.QUALITY_RULES, P.QualityRule("o.2", 0, 7, (), ("a&b",))), (P.RatingRule("o.3", (("age", "8-14"), ("x<y", "a & b")), ("m",), ("n",)),),
        (*E.FEED_RULES, E.FeedRule("o.4", "/a/b[k=1]", "remove", ("u",))),
    )
    write_rule_set(spark, own, str(tmp_path / "set"))
    rows = X.read_folders(spark, str(tmp_path / "set"))
    assert compile_rules(rows) == own
    with pytest.raises(ValueError):
        compile_rules(rows, limit=3)
    assert compile_rules(rows.withColumn("disable", F.lit(True))) == RuleSet()
    assert rule_set(tables).tag_rules == tuple(P.TAG_RULES) and rule_set(tables).limits() == P.RATING_LIMITS
    assert scoped_rules(tables) == tuple(P.SCOPED_RULES)
    write_scopes(spark, [P.ScopedRule(f"s.{i}", 0, i, "Replacer", ("text/x",), (f"/{i}/",)) for i in range(1000)], str(tmp_path / "many"))
    assert len(compile_scopes(X.read_folders(spark, str(tmp_path / "many")))) == 1000
