"""URL expressions: split, normalise, quote, query strings, safety tests, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.let import let

# Default port of each scheme.
DEFAULT_PORTS = {"http": 80, "https": 443, "nntps": 563}
# Longest accepted URL and the length from which a warning is due.
MAX_URL_LENGTH = 8192
WARN_URL_LENGTH = 1024
# Characters a path keeps unquoted, besides letters, digits and "_.-".
PATH_SAFE = "-;/=,~*+()@!"

_ESCAPED = "\ue001"  # stands for the "%" of an escape that must stay one


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([^/:]+):", 1))


def netloc(url: Column) -> Column:
    """Host part as written: may hold user, password and port."""
    return F.regexp_extract(url, r"^(?:[^/:?#]+:)?//([^/?#]*)", 1)


def document(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^(?:[^/:?#]+:)?(?://[^/?#]*)?(.*)$", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(document(url), r"(?s)^([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^#]*#(.*)$", 1)


def default_port(scheme_name: Column, otherwise: int | None = 80) -> Column:
    chain = F.lit(otherwise).cast("int")
    for name, number in DEFAULT_PORTS.items():
        chain = F.when(scheme_name == name, number).otherwise(chain)
    return chain


def numeric_port(text: Column) -> Column:
    """Port number when 1..65535, else null."""
    number = F.when(text.rlike("^[0-9]{1,18}$"), text.try_cast("bigint"))
    return F.when((number > 0) & (number < 65536), number.cast("int"))


def split_port(host: Column, default: Column) -> Column:
    """``host[:port]`` as struct(host, port)."""
    has_port = F.contains(host, F.lit(":"))
    return F.struct(
        F.regexp_extract(host, r"^([^:]*)", 1).alias("host"),
        F.when(has_port, F.coalesce(numeric_port(F.regexp_extract(host, r"^[^:]*:(.*)$", 1)), default))
        .otherwise(default)
        .alias("port"),
    )


def url_split(url: Column) -> Column:
    """struct(scheme, host, port, document)."""
    name = scheme(url)
    parts = split_port(F.lower(netloc(url)), default_port(name))
    return F.struct(
        name.alias("scheme"), parts["host"].alias("host"), parts["port"].alias("port"), document(url).alias("document")
    )


def host(url: Column) -> Column:
    """Lower-cased host without port."""
    return F.regexp_extract(F.lower(netloc(url)), r"^([^:]*)", 1)


def url_unsplit(parts: Column) -> Column:
    plain = parts["port"].eqNullSafe(default_port(parts["scheme"], None))
    port = F.when(plain, "").otherwise(F.concat(F.lit(":"), parts["port"].cast("string")))
    return F.concat(parts["scheme"], F.lit("://"), parts["host"], port, parts["document"])


def fix_typos(url: Column) -> Column:
    return F.regexp_replace(url, r"^(https?)//", "$1://")


def unquote(text: Column) -> Column:
    """Decode escapes of ASCII characters; escapes of other bytes are kept as they are, behind a mark."""

    def decode(value: Column) -> Column:
        marked = F.regexp_replace(value, r"%([89A-Fa-f][0-9A-Fa-f])", _ESCAPED + "$1")
        stray = F.regexp_replace(marked, r"%(?![0-9A-Fa-f]{2})", "%25")
        return F.try_url_decode(F.replace(stray, F.lit("+"), F.lit("%2B")))

    return let(text, lambda value: F.when(F.contains(value, F.lit("%")), decode(value)).otherwise(value))


def unmark(text: Column) -> Column:
    return F.replace(text, F.lit(_ESCAPED), F.lit("%"))


def quote(text: Column, safe: str = "/") -> Column:
    """Percent-quote everything but letters, digits, ``_.-`` and the safe characters."""
    mark = "".join(f"%{b:02X}" for b in _ESCAPED.encode())

    def encode(value: Column) -> Column:
        out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
        if "*" not in safe:
            out = F.replace(out, F.lit("*"), F.lit("%2A"))
        for char in safe:
            if char not in "*-_.":
                out = F.replace(out, F.lit(f"%{ord(char):02X}"), F.lit(char))
        return out

    def restore(out: Column) -> Column:
        # escapes kept by unquote() come back in upper case
        kept = F.transform(
            F.split(out, mark),
            lambda x, i: F.when(i == 0, x).otherwise(
                F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2)), x.substr(F.lit(3), F.length(x)))
            ),
        )
        return F.when(F.contains(out, F.lit(mark)), F.array_join(kept, "")).otherwise(out)

    plain = r"^[A-Za-z0-9_.\-" + "".join("\\" + c for c in safe) + "]*$"
    return let(text, lambda v: F.when(v.rlike(plain), v).otherwise(let(encode(v), restore)))


def query_pairs(query: Column) -> Column:
    """array<struct<key,value,sep>>; value null when there is no ``=``; not yet decoded."""
    parts = F.split(query, "[&;]")
    seps = F.regexp_extract_all(query, F.lit("[&;]"), F.lit(0))

    def pair(part: Column, sep: Column) -> Column:
        return F.struct(
            F.regexp_extract(part, r"(?s)^([^=]*)", 1).alias("key"),
            F.when(F.contains(part, F.lit("=")), F.regexp_extract(part, r"(?s)^[^=]*=(.*)$", 1)).alias("value"),
            F.coalesce(sep, F.lit("")).alias("sep"),
        )

    return F.zip_with(parts, seps, pair)


def parse_query(query: Column, keep_blank: bool = False) -> Column:
    """Decoded array<struct<key,value,sep>>; ``+`` is a blank; blank values only on request."""

    def decode(text: Column) -> Column:
        return unmark(unquote(F.replace(text, F.lit("+"), F.lit(" "))))

    pairs = query_pairs(query)
    if not keep_blank:
        pairs = F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != "")
    return F.transform(
        pairs, lambda p: F.struct(decode(p["key"]).alias("key"), decode(p["value"]).alias("value"), p["sep"].alias("sep"))
    )


def join_query(query: Column) -> Column:
    """Decode and quote again every part of a query string, also of nested ``?`` tails."""

    def requote(text: Column, safe: str) -> Column:
        return quote(unquote(F.replace(text, F.lit("+"), F.lit(" "))), safe)

    def one(piece: Column) -> Column:
        texts = F.transform(
            query_pairs(piece),
            lambda p: F.concat(
                requote(p["key"], "/-:,;"),
                F.when(p["value"].isNull(), "").otherwise(F.concat(F.lit("="), requote(p["value"], "-:,;"))),
                p["sep"],
            ),
        )
        return F.array_join(texts, "")

    joined = F.array_join(F.transform(F.split(query, r"\?"), one), "?")
    return F.when(query == "", "").otherwise(joined)


def collapse_segments(url_path: Column) -> Column:
    """Backslashes, repeated slashes, ``.`` and ``..`` segments removed."""
    p = F.regexp_replace(F.replace(url_path, F.lit("\\"), F.lit("/")), "/+", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"^\./", ""), r"/\./|/\.$", "/")

    def resolve_parents(clean: Column) -> Column:
        absolute = F.startswith(clean, F.lit("/"))
        segments = F.split(F.regexp_replace(clean, "^/", ""), "/")
        # the last segment is told apart by a mark: a path that ends in ".." ends in a slash
        marked = F.transform(segments, lambda s, i: F.struct(s.alias("s"), (i == F.size(segments) - 1).alias("last")))

        def step(stack: Column, seg: Column) -> Column:
            can_pop = (F.size(stack) > 0) & (F.try_element_at(stack, F.lit(-1)) != "..")
            popped = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
            popped = F.when(seg["last"], F.array_append(popped, F.lit(""))).otherwise(popped)
            at_root = F.when(absolute & ~seg["last"], stack).otherwise(F.array_append(stack, seg["s"]))
            up = F.when(can_pop, popped).otherwise(at_root)
            return F.when(seg["s"] == "..", up).otherwise(F.array_append(stack, seg["s"]))

        folded = F.aggregate(marked, F.expr("cast(array() as array<string>)"), step)
        return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(folded, "/"))

    return let(p, lambda v: F.when(F.contains(v, F.lit("..")), resolve_parents(v)).otherwise(v))


def _norm_host(name: Column, full_host: Column) -> Column:
    def known(port: Column) -> Column:
        user = F.regexp_extract(full_host, r"^(.*@)", 1)
        parts = split_port(F.regexp_replace(full_host, r"^.*@", ""), port)
        bare = F.regexp_replace(parts["host"], r"\.$", "")
        shown = F.when(parts["port"] == port, "").otherwise(F.concat(F.lit(":"), parts["port"].cast("string")))
        return F.concat(user, bare, shown)

    with_port = let(default_port(name, None), known)
    return F.when(full_host == "", "").when(name.isin(list(DEFAULT_PORTS)), with_port).otherwise(full_host)


def url_norm(url: Column) -> Column:
    """Canonical spelling of a URL."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    raw = F.struct(
        F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).alias("scheme"),
        F.lower(unquote(F.regexp_extract(rest, r"^//([^/?#]*)", 1))).alias("host"),
        F.regexp_extract(rest, r"(?s)^(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
        join_query(query_string(rest)).alias("query"),
        unquote(fragment(rest)).alias("frag"),
        F.endswith(url, F.lit("#")).alias("bare_hash"),
    )

    def repaired(r: Column) -> Column:
        # a backslash ends the host, what follows it belongs to the path
        tail = F.regexp_extract(r["host"], r"(\\.*)$", 1)
        moved = F.concat(tail, F.when(r["path"] == "/", "").otherwise(unquote(r["path"])))
        full_path = F.when(tail != "", moved).otherwise(unquote(r["path"]))
        root = F.when((r["scheme"] != "") & ((r["query"] != "") | (r["frag"] != "")), "/").otherwise("")
        fixed_path = let(full_path, lambda p: F.when(p == "", root).otherwise(collapse_segments(p)))
        return F.struct(
            r["scheme"].alias("scheme"),
            quote(_norm_host(r["scheme"], F.regexp_extract(r["host"], r"^([^\\]*)", 1)), "@:").alias("host"),
            quote(fixed_path, PATH_SAFE).alias("path"),
            r["query"].alias("query"),
            quote(r["frag"], "/").alias("frag"),
            r["bare_hash"].alias("bare_hash"),
        )

    def joined(r: Column) -> Column:
        lead = F.when((r["host"] != "") & (r["path"] != "") & ~F.startswith(r["path"], F.lit("/")), "/").otherwise("")
        return F.concat(
            F.when(r["scheme"] != "", F.concat(r["scheme"], F.lit(":"))).otherwise(""),
            F.when(r["host"] != "", F.concat(F.lit("//"), r["host"])).otherwise(""),
            lead,
            r["path"],
            F.when(r["query"] != "", F.concat(F.lit("?"), r["query"])).otherwise(""),
            F.when(r["frag"] != "", F.concat(F.lit("#"), r["frag"])).when(r["bare_hash"], "#").otherwise(""),
        )

    return let(raw, lambda r: let(repaired(r), joined))


def url_quote(url: Column) -> Column:
    """Quote each part of a URL with the characters that are safe there."""
    name = F.regexp_extract(url, r"^([A-Za-z]+):", 1)

    def one(p: Column) -> Column:
        value = quote(p["value"], "/-:,")
        return F.concat(
            quote(p["key"], "/-:,"),
            F.when(F.coalesce(p["value"], F.lit("")) != "", F.concat(F.lit("="), value)).otherwise(""),
            p["sep"],
        )

    # the query is quoted as a whole before it is taken apart
    query = F.array_join(F.transform(parse_query(quote(query_string(url), "&=,"), True), one), "")
    frag = quote(fragment(url), "/")
    absolute = F.concat(
        F.lower(name),
        F.lit(":"),
        F.when(netloc(url) != "", F.concat(F.lit("//"), quote(netloc(url), ":"))).otherwise(""),
        quote(path(url), "/=,"),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(""),
    )
    doc = F.regexp_extract(url, r"(?s)^(.*)\?[^?]*$", 1)
    tail = F.regexp_extract(url, r"\?([^?]*)$", 1)
    relative = F.when(F.contains(url, F.lit("?")) & (tail != ""), F.concat(quote(doc, "/=,"), F.lit("?"), tail))
    relative = relative.when(F.contains(url, F.lit("?")), quote(doc, "/=,")).otherwise(quote(url, "/=,"))
    return F.when(name != "", absolute).otherwise(relative)


def split_params(url_path: Column) -> Column:
    """Split ``;params`` off the last path segment: struct(path, params)."""
    has = url_path.rlike(r";[^/]*$")
    return F.struct(
        F.when(has, F.regexp_extract(url_path, r"^((?:.*/)?[^/;]*);[^/]*$", 1)).otherwise(url_path).alias("path"),
        F.when(has, F.regexp_extract(url_path, r"^(?:.*/)?[^/;]*;([^/]*)$", 1)).otherwise("").alias("params"),
    )


def strip_site(url: Column) -> Column:
    """struct(site, rest): host as written, then path, query and fragment."""
    return F.struct(netloc(url).alias("site"), document(url).alias("rest"))


# What counts as safe in each part of a URL.
_CHAR = r"([a-z0-9\-_.!~*'(),+]|%[2-9a-f][0-9a-f])"
_LABEL = r"([a-z0-9][-a-z0-9]{0,61}|[a-z])"
_DOMAIN = rf"({_LABEL}(\.{_LABEL})*\.?)"
_HOST = rf"{_DOMAIN}(:(80|8080|8000|443))?"
_PATH = r"((/([a-z0-9\-_.!~*'(),]|%[2-9a-f][0-9a-f])+)*/?)"
_CGI = rf"{_CHAR}+(=({_CHAR}|/)+)?"
SAFE_PATTERNS = {
    "url": rf"(?i)^(https?|ftp)://{_HOST}{_PATH}(#{_CHAR}*)?$",
    "host": rf"(?i)^{_HOST}$",
    "path": rf"(?i)^{_PATH}$",
    "query": rf"(?i)^({_CGI}(&{_CGI})*)?$",
    "fragment": rf"(?i)^{_CHAR}*$",
}
# Characters that need no quoting.
UNQUOTED = r"^[a-zA-Z0-9\-;/=,~*+()@!_:.&#%?\[\]]*$"


# The same tests without repeated groups, whose matching would need a stack frame per character.
_PLAIN = r"a-z0-9\-_.!~*'(),%"
_BAD_ESCAPE = r"(?i)%(?![2-9a-f][0-9a-f])"


def is_safe(text: Column, part: str) -> Column:
    """Whether a URL or one of its parts (host, path, query, fragment) holds safe characters only."""
    escapes_ok = ~text.rlike(_BAD_ESCAPE)
    if part == "host":
        return text.rlike(SAFE_PATTERNS["host"])
    if part == "fragment":
        return text.rlike(rf"(?i)^[{_PLAIN}+]*$") & escapes_ok
    if part == "path":
        return text.rlike(rf"(?i)^(/[{_PLAIN}/]*)?$") & ~F.contains(text, F.lit("//")) & escapes_ok
    if part == "query":
        fields = F.forall(F.split(text, "&"), lambda f: f.rlike(rf"(?i)^[{_PLAIN}+]+(=[{_PLAIN}+/]+)?$"))
        return (text == "") | (fields & escapes_ok)
    known = text.rlike(r"(?i)^(https?|ftp)://[^/?#]")
    return (
        known & is_safe(netloc(text), "host") & is_safe(path(text), "path")
        & ~text.rlike(r"^[^#]*\?") & is_safe(fragment(text), "fragment")
    )


def needs_quoting(url: Column) -> Column:
    return url.rlike(r"\s$") | ~url.rlike(UNQUOTED)


# URL endings and MIME types of each media class.
IMAGE_URL = r"(?i)\.(gif|jpe?g|ico|png|bmp|pcx|tga|tiff?)$"
FLASH_URL = r"(?i)\.(swf|flash)$"
SCRIPT_URL = r"(?i)\.js$"


def media_class(url: Column, mime: Column) -> Column:
    return (
        F.when(F.startswith(mime, F.lit("image/")) | url.rlike(IMAGE_URL), "image")
        .when(F.startswith(mime, F.lit("application/x-shockwave-flash")) | url.rlike(FLASH_URL), "flash")
        .when(mime.rlike("^(application/x-javascript|text/javascript)") | url.rlike(SCRIPT_URL), "javascript")
        .otherwise("html")
    )


def cache_key(url: Column) -> Column:
    p = path(url)
    return F.concat(netloc(url), F.when(p.rlike(r"(\.html|/)$"), p).otherwise("/"))


def quote_plus(text: Column) -> Column:
    return F.replace(quote(text, ""), F.lit("%20"), F.lit("+"))


def rating_prefixes(url: Column) -> Column:
    """All prefixes of ``scheme://host/segment/…`` from the longest; empty when there is no host."""
    name = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)
    site = netloc(url)
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    base = F.concat(F.lower(name), F.lit("://"), site)
    # odd steps end in a slash, even steps in the segment
    steps = F.sequence(2 * F.size(segments), F.lit(1), F.lit(-1))

    def prefix(k: Column) -> Column:
        # k parts after the host: slash, segment, slash, segment ...
        whole = F.slice(segments, F.lit(1), F.floor(k / 2).cast("int"))
        head = F.when(F.size(whole) > 0, F.concat(F.lit("/"), F.array_join(whole, "/"))).otherwise("")
        return F.concat(base, head, F.when(k % 2 == 1, "/").otherwise(""))

    many = F.transform(steps, prefix)
    found = F.when(F.size(segments) == 0, F.array(F.concat(base, F.lit("/")))).otherwise(many)
    return F.when((name == "") | (site == ""), F.expr("cast(array() as array<string>)")).otherwise(
        F.array_append(found, base)
    )


def rating_safe(url: Column) -> Column:
    """URL without query and fragment whose path parts keep only safe characters."""
    name = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    clean = F.transform(segments, lambda s: F.regexp_replace(s, r"(?i)[^a-z0-9\-_.!~*'(),+]", ""))
    tail = F.when(F.size(segments) == 0, "/").otherwise(F.concat(F.lit("/"), F.array_join(clean, "/")))
    return F.when((name == "") | (netloc(url) == ""), "").otherwise(
        F.concat(F.lower(name), F.lit("://"), netloc(url), tail)
    )


def many_percents(url: Column) -> Column:
    return F.contains(url, F.lit("%" * 11))


def dashes_in_host(url: Column) -> Column:
    name = F.regexp_extract(url, r"^([^:]*):", 1)
    rest = F.regexp_extract(url, r"^[^:]*:/*([^/]*)", 1)
    return F.contains(url, F.lit(":")) & (F.lower(name) != "javascript") & F.contains(rest, F.lit("---"))


def length_class(url: Column) -> Column:
    return F.when(F.length(url) > MAX_URL_LENGTH, "reject").when(F.length(url) > WARN_URL_LENGTH, "warn").otherwise("ok")


def resolve(base: Column, link: Column) -> Column:
    """Link as seen from the base URL."""
    name = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.concat(name, F.lit("://"), netloc(base))
    link_path = F.regexp_extract(link, r"^([^?#]*)", 1)
    link_tail = F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(name, F.lit(":"), link))
        .when(link == "", base)
        .when(F.startswith(link, F.lit("/")), F.concat(root, collapse_segments(link_path), link_tail))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path(base), link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), link))
        .otherwise(F.concat(root, collapse_segments(F.concat(folder, link_path)), link_tail))
    )


# Parameters that wrap the real target of a redirect link.
REDIRECT_PATTERN = r"[?&;](?:location|url)=(https?(?::|%3[aA])[^&;#]*)"


def redirect_target(url: Column) -> Column:
    wrapped = F.regexp_extract(url, REDIRECT_PATTERN, 1)
    return F.when(wrapped != "", F.coalesce(F.try_url_decode(F.replace(wrapped, F.lit("+"), F.lit("%2B"))), wrapped)).otherwise(url)
