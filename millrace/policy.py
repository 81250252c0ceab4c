"""Small literal rule sets used by the registered queries, with typed rows."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PatternRule:
    """A URL pattern; a replacement may refer to groups as ``\\1``."""

    sid: str
    pattern: str
    replacement: str = ""


@dataclass(frozen=True)
class ScopedRule:
    """A rule of one handler with its URL and MIME scope."""

    sid: str
    folder_oid: int
    oid: int
    handler: str
    mimes: tuple[str, ...] = ()
    matchurls: tuple[str, ...] = ()
    nomatchurls: tuple[str, ...] = ()


@dataclass(frozen=True)
class Handler:
    """A processing step: the stages it runs in and the MIME patterns it takes."""

    name: str
    stages: tuple[str, ...]
    mimes: tuple[str, ...] = ()
    rewrites: bool = False


@dataclass(frozen=True)
class HeaderRule:
    sid: str
    action: str
    header: str
    value: str = ""
    filterstage: str = "both"
    matchurls: tuple[str, ...] = ()


@dataclass(frozen=True)
class TextRule:
    sid: str
    search: str
    replace: str
    mimes: tuple[str, ...] = ()
    matchurls: tuple[str, ...] = ()
    nomatchurls: tuple[str, ...] = ()


@dataclass(frozen=True)
class TagRule:
    """Rewrites a start tag or the element it opens."""

    sid: str
    tag: str
    part: str
    attrs: tuple[tuple[str, str], ...] = ()
    replacement: str = ""
    content: str = ""
    matchurls: tuple[str, ...] = ()
    nomatchurls: tuple[str, ...] = ()

    @property
    def literal_tag(self) -> bool:
        return self.tag.isalnum()


@dataclass(frozen=True)
class ImageRule:
    sid: str
    width: int
    height: int
    formats: tuple[str, ...] = ()


@dataclass(frozen=True)
class QualityRule:
    sid: str
    quality: int
    minimal_size: int
    matchurls: tuple[str, ...] = field(default=())
    nomatchurls: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class RatingRule:
    """Limits by category; a missing category is not checked."""

    sid: str
    limits: tuple[tuple[str, str], ...]
    matchurls: tuple[str, ...] = ()
    nomatchurls: tuple[str, ...] = ()


# Substring lists: (sid, entry), in the order they are tried.
BLOCK_URLS = [("wc.201", "utm_source"), ("wc.201", "/fr/8"), ("wc.202", "page=2&ref"), ("wc.202", "//m.")]
ALLOW_URLS = [("wc.211", "/en/25"), ("wc.211", "spam-farm.example.org/en/7")]

BLOCK_PATTERNS = [
    PatternRule("wc.301", "https?://blog[.][^/]*/de/"),
    PatternRule("wc.302", "/(es|fr)/([0-9]+)[.]html", "http://mirror.example/\\1/\\2"),
    PatternRule("wc.303", "[?&]utm_source=([a-z]+)"),
    PatternRule("wc.304", "^http://m[.]([a-z]+)[.]", "http://\\1.mobile.example/"),
    PatternRule("wc.305", "#top$"),
]
ALLOW_PATTERNS = [PatternRule("wc.401", "/en/6[0-9]+"), PatternRule("wc.402", "^https://www[.]ththen")]

EXEMPT_HOSTS = [".example.net", "spam-farm.example.org", ".thther.example.org"]

HANDLERS = [
    Handler("BinaryCharFilter", ("Response decode",), ("text/html",), True),
    Handler("Blocker", ("Request",)),
    Handler("Compress", ("Response encode",), ("text/[a-z.+-]+", "application/xml", "application/postscript"), True),
    Handler("Header", ("Request header", "Response header")),
    Handler("HtmlRewriter", ("Response modify",), ("text/html",), True),
    Handler("ImageReducer", ("Response modify",), ("image/(jpeg|png|gif|bmp|x-ms-bmp|pcx|tiff)",), True),
    Handler("Rating", ("Response header",)),
    Handler("Replacer", ("Response modify",), ("text/html", "text/xml", "text/plain", "application/x-javascript"), True),
    Handler("XmlRewriter", ("Response modify",), ("text/xml", "application/((rss|atom|rdf)[+])?xml"), True),
]
STAGES = ["Request", "Request header", "Response header", "Response decode", "Response modify", "Response encode"]

SCOPED_RULES = [
    ScopedRule("wc.10", 0, 0, "Replacer", ("text/html",), ("/en/", "/de/"), ("[.]html$",)),
    ScopedRule("wc.11", 0, 1, "Replacer", (), (), ("^https", "utm_source")),
    ScopedRule("wc.12", 0, 2, "HtmlRewriter", ("text/html", "xml"), (), ("www[.]",)),
    ScopedRule("wc.13", 1, 0, "HtmlRewriter", (), ("example[.]com",)),
    ScopedRule("wc.14", 1, 1, "Blocker", (), ("blog[.]", "m[.]")),
    ScopedRule("wc.15", 2, 0, "Header", ("text/plain",)),
    ScopedRule("wc.16", 2, 1, "XmlRewriter", ("application/rss",), ("/fr/",)),
    ScopedRule("wc.17", 3, 0, "Rating"),
]

HEADER_RULES = [
    HeaderRule("wc.501", "remove", "X-H", filterstage="request"),
    HeaderRule("wc.502", "remove", "via|warn", filterstage="both"),
    HeaderRule("wc.503", "remove", "age", filterstage="response", matchurls=("^https",)),
    HeaderRule("wc.511", "add", "X-Origin", "$host", "both"),
    HeaderRule("wc.512", "add", "Cache-Control", "no-cache", "response", ("/en/",)),
    HeaderRule("wc.521", "replace", "User-Agent", "Plain/1.0 for ${host}", "request"),
    HeaderRule("wc.522", "replace", "X-Missing", "never", "both"),
]

TEXT_RULES = [
    TextRule("wc.601", "([0-9]+)", "<$1>", mimes=("text/plain", "text/html")),
    TextRule("wc.602", "(?i)\\bthe\\b", "THE", matchurls=("/en/",)),
    TextRule("wc.603", "[*#%$&]+", "", nomatchurls=("/de/",)),
]

TAG_RULES = [
    TagRule("wc.701", "script", "complete"),
    TagRule("wc.702", "div", "complete", (("class", "^ad"),)),
    TagRule("wc.703", "nav", "enclosed", (), "menu", "", (), ("/de/",)),
    TagRule("wc.704", "a", "attrval", (("href", "/(t[a-z]+)"),), "/go/\\1"),
    TagRule("wc.705", "h1", "tagname", (), "h2"),
    TagRule("wc.706", "html", "attrname", (("lang", "en|fr"),), "xml:lang"),
    TagRule("wc.707", "meta", "attr", (("charset", ".*"),), 'charset="iso-8859-1"'),
    TagRule("wc.708", "b(r|)", "tag", (), "<i>", "", ("/fr/", "/en/")),
    TagRule("wc.709", "style", "complete", (), "", "margin", ("example[.]org",)),
    TagRule("wc.710", "title", "matched", (), "", "the|de"),
]

IMAGE_RULES = [ImageRule("wc.801", 468, 60), ImageRule("wc.802", 88, 31, ("gif",)), ImageRule("wc.803", 1, 1, ("png", "gif"))]
QUALITY_RULES = [
    QualityRule("wc.811", 40, 2000, ("/en/",)),
    QualityRule("wc.812", 60, 1000, ("example[.]net", "blog[.]")),
]
# Quality and smallest size taken when no rule applies.
DEFAULT_QUALITY, DEFAULT_MINIMAL_SIZE = 20, 5120

SIGNATURES = [("Sig.Cookie", "ndtion"), ("Sig.Track", "stlyre"), ("Sig.Mail", "@example"), ("Sig.Long", "the the the")]

# Rating limits per rule; a missing category is not checked.
RATING_LIMITS = {
    "wc.901": {"age": "8-14", "language": "mild", "sex": "none", "violence": "mild"},
    "wc.902": {"violence": "none", "language": "heavy"},
}
