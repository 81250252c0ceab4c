"""BPE against the library, token counts against a loop over characters."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, token_counts
from millrace.llm.queries import QUERIES
from tests.conftest import SMALL

ODD = [
    "", " ", "\n\t ", "It's we'LL 'S", "Straße ÀÉ é ΑΣ Σ. İI", "<|endoftext|> a <|startoftext|><|endoftext|>b", " x y\u0085z\x1c.", "日本語 テスト 😀😀",
    "a" * 3000, "ab1234 5.67!!??", "​﻿", "x\x00y", "ﬁ ﬂ Ⅷ ²", "!" * 500, "word " * 2000,
]


def test_codec_agrees_with_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = bpe.codec(path), Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(1)
    letters = "abcdeést <|>'\ńñÜß1,.-"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(500)]
    for text in texts:
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_certain_cuts_keep_ids():
    own = bpe.codec(public_tokenizers.path("word_bpe_49k.json"))
    word = "".join(own.letters[b] for b in "qxzjqñßüqj".encode())
    assert len(own.fragments(word)) > 1 and "".join(own.fragments(word)) == word
    whole = own.merged([*(own.vocab[c] for c in word[:-1]), own.vocab[word[-1] + own.end]])
    assert np.frombuffer(own.piece("qxzjqñßüqj"), "<u4").tolist() == whole
    ids = [own.vocab[c] for c in "thestationing"] * 4
    assert own.merged_long(list(ids)) == own.merged(list(ids))


def test_bpe_query_on_documents(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op10_bpe"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", 6), (2, "x" * 200_000, 7)], "doc_id long, text string, ids int")
    rows = bpe.encode(df, path, F.col("doc_id"), F.col("text")).collect()
    assert len(rows) == 4 and [r.decoded for r in rows if r.key == 1] == ["", ""] and [r.decoded for r in rows if r.key is None] == ["a</w> b</w>"]
    assert bpe.encode(df.limit(0), path, F.col("doc_id"), F.col("text")).count() == 0


def plain_counts(encoder, fields, text):
    """The rule, token by token and character by character."""
    record = "".join(f + "\n" for f in fields) + text
    lines = text.split("\n")
    owner = [k for k, f in enumerate(fields) for _ in f + "\n"]
    owner += [len(fields) + k for k, line in enumerate(lines) for _ in line + ("\n" if k < len(lines) - 1 else "")]
    counts, raw, at = [0] * (len(fields) + len(lines)), record.encode(), 0
    char = [k for k, c in enumerate(record) for _ in c.encode()]
    for i in encoder.encode_ordinary(record):
        size = len(encoder.decode_single_token_bytes(i))
        held = [owner[c] for c in sorted(set(char[at : at + size]))]
        counts[max(sorted(set(held)), key=held.count)] += 1
        at += size
    assert at == len(raw)
    return counts


@pytest.mark.parametrize("source", ["odd", "documents"])
def test_token_counts(spark, source):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder, _ = token_counts.encoding(path, public_tokenizers.PATTERN)
    if source == "odd":
        texts = [t for t in ODD] + ["a\n\n\n  b\n\n", "\n", "é\né\n😀\n😀", None]
        df = spark.createDataFrame([(i, t, "s" if i % 2 else None, "é") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    else:
        df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source", "lang")
    got = {}
    for r in token_counts.token_counts(df, path, public_tokenizers.PATTERN, F.col("doc_id"), [F.col("source"), F.col("lang")], F.col("text")).orderBy("key", "section").collect():
        got.setdefault(r.key, []).append(r.n_tokens)
    for r in df.collect():
        assert got[r.doc_id] == plain_counts(encoder, [r.source or "", r.lang or ""], r.text or ""), r.doc_id


def test_token_counts_spans_cover_the_record(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, "ab\n" + " " * 50_000 + "\nc" + "d" * 100_000, 1)], "doc_id long, text string, section int")
    rows = token_counts.token_counts(df, path, public_tokenizers.PATTERN, F.col("doc_id"), [], F.col("text")).orderBy("section").collect()
    assert [r.start for r in rows] == [0, 3, 50_004] and [r.end for r in rows] == [3, 50_004, 150_005]
    assert token_counts.token_counts(df.limit(0), path, public_tokenizers.PATTERN, F.col("doc_id"), [], F.col("text")).count() == 0


@pytest.mark.parametrize("n", [1_999, 2_000, 2_001, 20_000])
def test_long_blanks_are_encoded_as_in_the_whole(spark, n):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder, _ = token_counts.encoding(path, public_tokenizers.PATTERN)
    runs = [" " * n, "\t" * n, "\n" * n, "\u3000" * n, " \n" * (n // 2), "\x1c" * n, " " * (n - 1) + "\n"]
    texts = [a + run + b for run in runs for a, b in (("word", "hello there"), ("", "1"), ("a!", ""), ("word", run[:3] + "\x1c" + run + "!x"))]
    for text in texts:
        assert token_counts.encoded(encoder, text) == encoder.encode_ordinary(text)
    df = spark.createDataFrame([(0, "word" + " " * n + "hello there")], "doc_id long, text string")
    got = token_counts.token_counts(df, path, public_tokenizers.PATTERN, F.col("doc_id"), [], F.col("text")).first().n_tokens
    assert got == len(encoder.encode_ordinary("word" + " " * n + "hello there"))
