"""Content signatures: the rows of signature files, and fixed values for the common types."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signature:
    """A test of the bytes at an offset; rows of a deeper level refine the row above them."""

    level: int
    offset: int
    kind: str
    test: str
    value: bytes | int | None
    mime: str = ""
    mask: int | None = None
    mask_by: str = "&"

    @property
    def fold_case(self) -> bool:
        return self.kind.startswith("string/") and "c" in self.kind.lower()


WIDTH = {"byte": 1, "short": 2, "beshort": 2, "leshort": 2, "long": 4, "belong": 4, "lelong": 4}

# Leading bytes of common types, in the layout of signature files.
COMMON = r"""
0	string	.RMF	application/vnd.rn-realmedia
0	beshort&0xfffe	=0xfffa	audio/mpeg
0	string	ID3	audio/mpeg
0	string	PK\003\004	application/x-zip
0	string	Rar!	application/x-rar
0	string/c	\<!DOCTYPE\ html	text/html
0	string/c	\<head	text/html
0	string/c	\<title	text/html
0	string/c	\<html	text/html
0	string	\<!--	text/html
0	string/c	\<h1	text/html
0	string	\<?xml	text/xml
0	string	GIF	image/gif
0	beshort	0xffd8	image/jpeg
0	string	BM	image/bmp
0	string	%!	application/postscript
0	string	%PDF-	application/pdf
0	string	{\\rtf	text/rtf
0	belong	0x000001BA	video/mpeg
0	belong	0x000001BB	video/mpeg
0	string	\x89PNG	image/png
0	string	BZh	application/x-bzip2
0	string	FWS
>3	byte	x	application/x-shockwave-flash
0	string	CWS	application/x-shockwave-flash
"""

# Rows of the same layout for tests that the common types do without.
MORE = r"""
0	string	MZ
>2	byte	<0x60	application/x-dos-low
>2	byte	>0x5f	application/x-dos
>>3	leshort&0x0f00	0x0100	\b-one
0	string	SAMP	sample/a
>4	byte&0x80	0x80	\b-high
>>5	string	>\0	\b-text
>4	beshort	x	\b-any
>6	string	<@	\b-upper
0	ulelong&0x0000ffff	0x00004a70	audio/x-jp
>2	short^0x1	>0x7fff	audio/x-jp-two
8	beshort	>0xff00	application/x-tail
"""


def _unescape(text: str) -> bytes:
    def one(m: re.Match) -> str:
        body = m.group(1)
        if body[0] == "x":
            return chr(int(body[1:], 16))
        if body[0].isdigit():
            return chr(int(body, 8) & 255)
        return {"n": "\n", "t": "\t", "r": "\r", "b": "\b"}.get(body, body)

    return re.sub(r"\\(x[0-9a-fA-F]{1,2}|[0-7]{1,3}|.)", one, text).encode("latin-1")


def parse_signatures(text: str) -> list[Signature]:
    """Rows of a signature file; tests on regular expressions, indirect offsets and negation are skipped.

    A text may be compared for equality, as ``<`` (no byte of the content is lower), as ``>`` with a zero byte (the
    content's is another), or as ``x`` (there is one). Numbers without a byte order are little-endian.
    """
    rows = []
    for line in text.splitlines():
        m = re.match(r"(>*)(\d+|0x[0-9a-fA-F]+)\s+(\S+)\s+((?:\\.|\S)+)(?:\s+(\S.*))?$", line)
        if not m or line.startswith("#"):
            continue
        level, offset, kind, value, mime = len(m[1]), int(m[2], 0), m[3], m[4], (m[5] or "").split("\t")[0].strip().replace(r"\b", "\b") or "\b"
        mask_by = "^" if "^" in kind else "&"
        name, _, mask = kind.partition(mask_by)
        base = name.removeprefix("u").split("/")[0]
        test = "="
        if value[0] in "=<>&^!" and (base != "string" or value[0] in "=<>!") and len(value) > 1:
            test, value = value[0], value[1:]
        if value == "x":
            test = "x"
        name = name.removeprefix("u")
        base = name.split("/")[0]
        if test == "!" or base not in ("string", *WIDTH):
            continue
        if base == "string":
            rows.append(Signature(level, offset, name, test, _unescape(value), mime))
        else:
            try:
                number = None if test == "x" else int(value.rstrip("Ll"), 8 if re.fullmatch("0[0-7]+", value) else 0)
            except ValueError:
                continue
            rows.append(Signature(level, offset, name, test, number, mime, int(mask, 0) if mask else None, mask_by))
    return rows


def read_signatures(spark: SparkSession, path: str) -> list[Signature]:
    """The rows of a signature file, in order; in ISO-8859-1."""
    files = spark.read.format("binaryFile").load(path).orderBy("path")
    return parse_signatures("\n".join(r.text for r in files.select(F.decode("content", "ISO-8859-1").alias("text")).collect()))
