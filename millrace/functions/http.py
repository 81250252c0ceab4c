"""HTTP expressions: request and status lines, dates, warnings, content headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.functions.let import let

# Canonical reason of each status.
REASONS = {
    100: "Continue", 101: "Switching Protocols",
    200: "OK", 201: "Created", 202: "Accepted", 203: "Non-Authoritative Information", 204: "No Content",
    205: "Reset Content", 206: "Partial Content",
    300: "Multiple Choices", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified",
    305: "Use Proxy", 307: "Temporary Redirect",
    400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden", 404: "Not Found",
    405: "Method Not Allowed", 406: "Not Acceptable", 407: "Proxy Authentication Required", 408: "Request Timeout",
    409: "Conflict", 410: "Gone", 411: "Length Required", 412: "Precondition Failed", 413: "Request Entity Too Large",
    414: "Request-URI Too Long", 415: "Unsupported Media Type", 416: "Requested Range Not Satisfiable",
    417: "Expectation Failed",
    500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable",
    504: "Gateway Timeout", 505: "HTTP Version Not Supported",
}
# MIME type of common URL endings.
MIME_BY_EXTENSION = {
    "html": "text/html", "htm": "text/html", "txt": "text/plain", "css": "text/css", "js": "application/x-javascript",
    "gif": "image/gif", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "ico": "image/vnd.microsoft.icon",
    "swf": "application/x-shockwave-flash", "pdf": "application/pdf", "xml": "text/xml", "zip": "application/zip",
}
# Methods, schemes, ports and versions that are admitted.
METHODS = ["GET", "HEAD", "CONNECT", "POST"]
SCHEMES = ["http", "https"]
CONNECT_PORTS = [443, 563]


def http_version(text: Column) -> Column:
    """struct(major, minor); anything but ``HTTP/a.b`` is (2, 0)."""
    body = F.upper(text)
    pattern = r"^HTTP/\s*([0-9]{1,9})\s*\.\s*([0-9]{1,9})\s*$"
    ok = body.rlike(pattern)
    return F.struct(
        F.when(ok, F.regexp_extract(body, pattern, 1).cast("int")).otherwise(2).alias("major"),
        F.when(ok, F.regexp_extract(body, pattern, 2).cast("int")).otherwise(0).alias("minor"),
    )


def request_line(line: Column) -> Column:
    """struct(method, url, major, minor) of a three-token line; else empty and (2, 0)."""

    def parsed(tokens: Column) -> Column:
        ok = F.size(tokens) == 3
        version = http_version(F.when(ok, F.get(tokens, F.lit(2))).otherwise(""))
        return F.struct(
            F.when(ok, F.upper(F.get(tokens, F.lit(0)))).otherwise("").alias("method"),
            F.when(ok, F.get(tokens, F.lit(1))).otherwise("").alias("url"),
            version["major"].alias("major"), version["minor"].alias("minor"),
        )

    return let(F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+"), parsed)


def status_line(line: Column) -> Column:
    """struct(major, minor, status, reason) with the known reason where there is one."""
    pattern = r"(?s)^\s*(\S+)\s+(\S+)(?:\s+(\S.*))?$"
    ok = line.rlike(pattern)
    code = F.when(ok, F.regexp_extract(line, pattern, 2)).otherwise("200")
    status = F.when(code.rlike("^[1-5][0-9]{2}$"), code.try_cast("int")).otherwise(200)
    given = F.when(ok, F.regexp_extract(line, pattern, 3)).otherwise("OK")
    version = http_version(F.when(ok, F.regexp_extract(line, pattern, 1)).otherwise("HTTP/1.0"))
    known = F.expr("map(" + ", ".join(f"{code}, '{reason}'" for code, reason in REASONS.items()) + ")")
    return F.struct(
        version["major"].alias("major"), version["minor"].alias("minor"), status.alias("status"),
        F.coalesce(F.try_element_at(known, status), F.when(given == "", "Bummer").otherwise(given)).alias("reason"),
    )


def http_date(text: Column) -> Column:
    """Timestamp of the three HTTP date layouts, else null."""
    day = r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
    full = r"(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
    clock = r"([0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})"
    rfc1123 = rf"^{day}, ([0-9]{{1,2}} [A-Z][a-z]{{2}} [0-9]{{4}} {clock[1:-1]}) GMT$"
    rfc850 = rf"^{full}, ([0-9]{{1,2}}-[A-Z][a-z]{{2}}-)([0-9]{{2}}) {clock} GMT$"
    asctime = rf"^{day} ([A-Z][a-z]{{2}}) +([0-9]{{1,2}}) {clock} ([0-9]{{4}})$"
    year2 = F.regexp_extract(text, rfc850, 2)
    # two-digit years from 69 belong to the last century
    century = F.when(year2 >= "69", "19").otherwise("20")
    spelled = (
        F.when(text.rlike(rfc1123), F.regexp_extract(text, rfc1123, 1))
        .when(
            text.rlike(rfc850),
            F.concat(
                F.replace(F.regexp_extract(text, rfc850, 1), F.lit("-"), F.lit(" ")), century, year2,
                F.lit(" "), F.regexp_extract(text, rfc850, 3),
            ),
        )
        .when(
            text.rlike(asctime),
            F.concat_ws(" ", *[F.regexp_extract(text, asctime, i) for i in (2, 1, 4, 3)]),
        )
    )
    return F.try_to_timestamp(spelled, F.lit("d MMM yyyy H:m:s"))


def date_rfc1123(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def date_rfc850(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEEE, dd-MMM-yy HH:mm:ss"), F.lit(" GMT"))


def date_asctime(ts: Column) -> Column:
    return F.concat(
        F.date_format(ts, "EEE MMM "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.date_format(ts, " HH:mm:ss yyyy")
    )


_QUOTED = r'"((?:[^"\\]+|\\.)*)"?'


def warning(text: Column) -> Column:
    """struct(code, agent, text, date); null when the code is no number or a quoted text is missing."""
    quoted = rf"(?s)^\s*(-?[0-9]+)\s+(\S+)\s+{_QUOTED}\s*(.*)$"
    plain = r"(?s)^\s*(-?[0-9]+)\s+(.+)$"
    has_quote = F.contains(text, F.lit('"'))
    rest = F.regexp_extract(text, quoted, 4)
    date_text = F.when(F.startswith(rest, F.lit('"')), F.regexp_extract(rest, r'^"([^"]*)', 1)).otherwise(rest)
    in_quotes = F.struct(
        F.regexp_extract(text, quoted, 1).try_cast("int").alias("code"),
        F.regexp_extract(text, quoted, 2).alias("agent"),
        F.regexp_replace(F.regexp_extract(text, quoted, 3), r"(?s)\\(.)", "$1").alias("text"),
        F.when(date_text != "", http_date(date_text)).alias("date"),
    )
    bare = F.struct(
        F.regexp_extract(text, plain, 1).try_cast("int").alias("code"), F.lit("").alias("agent"),
        F.regexp_extract(text, plain, 2).alias("text"), F.lit(None).cast("timestamp").alias("date"),
    )
    return F.when(has_quote & text.rlike(quoted), in_quotes).when(~has_quote & text.rlike(plain), bare)


def content_type(header: Column, url: Column) -> Column:
    """Declared type, else by the ending of the path, else octet-stream."""
    known = F.expr("map(" + ", ".join(f"'{ext}', '{mime}'" for ext, mime in MIME_BY_EXTENSION.items()) + ")")
    ending = F.lower(F.regexp_extract(U.path(url), r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(header, F.try_element_at(known, ending), F.lit("application/octet-stream"))


# Character sets that are understood.
CHARSETS = ["ascii", "us-ascii", "utf-8", "utf8", "iso-8859-1", "iso8859-1", "latin-1", "latin1", "iso-8859-15",
            "windows-1252", "cp1252", "utf-16", "koi8-r", "big5", "gb2312", "euc-jp", "shift_jis"]


def charset(header: Column) -> Column:
    """Known character set of a Content-Type value, lower-cased, else null."""
    name = F.regexp_extract(F.lower(header), r"(?:^|;)\s*charset=([^;]*?)\s*(?:;|$)", 1)
    return F.when(name.isin(CHARSETS), name)


def accept_encodings(header: Column) -> Column:
    """array<struct<encoding,preference>> of an Accept-Encoding value."""

    def one(item: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(item, r"^\s*([^;]*?)\s*(?:;|$)", 1)).alias("encoding"),
            F.when(F.contains(item, F.lit(";")), F.trim(F.regexp_extract(item, r";(.*)$", 1))).alias("preference"),
        )

    return F.transform(F.split(header, ","), one)


def takes_gzip(header: Column) -> Column:
    return F.exists(accept_encodings(header), lambda e: e["encoding"].isin("gzip", "x-gzip"))


def content_length(header: Column) -> Column:
    """Length as a number; null when the header is absent (as for chunked bodies) or not a number."""
    return header.try_cast("bigint")


def admission_status(method: Column, url: Column, version: Column) -> Column:
    """Status that turns a request down, or null when it is admitted."""
    v = http_version(version)
    number = v["major"] * 1000 + v["minor"]
    port = U.split_port(url, F.lit(443))["port"]
    name = U.scheme(url)
    scheme_ok = (name == "") | ~F.contains(url, F.lit("://")) | name.isin(SCHEMES)
    return (
        F.when(~method.isin(METHODS), 405)
        .when(url == "", 400)
        .when(~number.between(9, 1001), 505)
        .when(F.length(url) > U.MAX_URL_LENGTH, 414)
        .when((method == "CONNECT") & ~(port.isin(CONNECT_PORTS) | port.between(1024, 65535)), 403)
        .when((method != "CONNECT") & ~scheme_ok, 403)
    )
