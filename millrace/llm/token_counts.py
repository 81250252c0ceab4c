"""Token counts by field and section (operator 7).

A document is encoded once, as a whole. Tokens are contiguous, so the lengths of their bytes give each token's
span of characters; these spans are joined with the sections' spans (both sorted: one merge, no pairs).

Rule for a token that crosses a boundary: it counts for the section that holds most of its characters, and for
the earlier one on a tie. A token that holds a part of a character spans that whole character. Every token
counts exactly once, so the sections of a document add up to its tokens.

Sections: a record is ``source``, ``lang`` and the text, each ending with a line feed except the text; the two
fields are sections 0 and 1, and each line of the text, with its line feed, is a section from 2 on.

Defined results: null fields and texts are empty; an empty text has one empty section with no tokens. Repeated
rows give repeated rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_batches

#: Blank runs from this length on are given to the encoder as the piece they are: the pattern looks ahead at every place of such a run.
LONG_BLANK = 2_000
#: Only what the pattern counts as blank: Python's \\s holds four control characters more.
LONG_BLANKS = regex.compile(rf"\p{{White_Space}}{{{LONG_BLANK},}}")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoder and the byte length of each id."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def encoded(encoder, record: str) -> list[int]:
    """Ids of the whole record. The pattern takes all of a run of blanks but its last one as a piece (all of it at the record's end)."""
    if len(record) < LONG_BLANK:
        return encoder.encode_ordinary(record)
    ids, at = [], 0
    for run in LONG_BLANKS.finditer(record):
        end = run.end() - (run.end() < len(record))
        ids += encoder.encode_ordinary(record[at : run.start()])
        ids += encoder._encode_single_piece(record[run.start() : end])
        at = end
    return ids + encoder.encode_ordinary(record[at:])


def token_spans(ids: np.ndarray, lengths: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last character (inclusive) of each token."""
    ends = np.cumsum(lengths[ids])
    raw = np.frombuffer(text, np.uint8)
    at = np.cumsum((raw & 0xC0) != 0x80) - 1  # character of each byte
    return at[ends - lengths[ids]], at[ends - 1]


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Section of each token: the one with most of its characters, the earlier one on a tie. ``starts``: sorted starts of the sections."""
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, last, "right") - 1
    for k in np.flatnonzero(a != b):
        edges = np.clip(np.append(starts[a[k] : b[k] + 1], last[k] + 1), first[k], last[k] + 1)
        a[k] += int(np.argmax(np.diff(edges)))
    return a


def section_starts(text: str) -> list[int]:
    """Starts of the lines; a line's feed belongs to it."""
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def token_counts(df: DataFrame, path: str, pattern: str, key: Column, fields: list[Column], text: Column) -> DataFrame:
    """key, section, start, end (characters of the record, end exclusive) and n_tokens, a row for each section."""
    kind = df.select(key.alias("key")).schema["key"].dataType.simpleString()
    names = [f"field{i}" for i in range(len(fields))]

    def make():
        encoder, lengths = encoding(path, pattern)
        def ids_of(record: str) -> np.ndarray:
            return np.array(encoded(encoder, record), np.int64)

        def step(keys: list, texts: list, *heads: list) -> tuple:
            rows, sizes, section, start, end, counts = [], [], [], [], [], []
            for k, body in enumerate(texts):
                head = "".join(h[k] + "\n" for h in heads)
                record = head + body
                own = np.cumsum([0, *(len(h[k]) + 1 for h in heads)])[:-1].tolist() + [len(head) + s for s in section_starts(body)]
                starts = np.array(own, np.int64)
                ids = ids_of(record)
                got = np.bincount(allocate(*token_spans(ids, lengths, record.encode()), starts), minlength=len(starts)) if len(ids) else np.zeros(len(starts), np.int64)
                sizes.append(len(starts))
                rows.append(keys[k])
                section.append(np.arange(len(starts)))
                start.append(starts)
                end.append(np.append(starts[1:], len(record)))
                counts.append(got)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (section, start, end, counts)]
            repeated = pa.array(rows).take(pa.array(np.repeat(np.arange(len(rows)), sizes))) if rows else pa.array([], pa.int64())
            return repeated.cast(to), pa.array(flat[0].astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in flat[1:])

        to = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
        return step

    columns = [key.alias("key"), F.coalesce(text, F.lit("")).alias("text"), *(F.coalesce(f, F.lit("")).alias(n) for f, n in zip(fields, names, strict=True))]
    return map_batches(df, columns, make, f"key {kind}, section int, start long, end long, n_tokens long")
