"""Licence scan: automaton against all runs, phrases against plain search, chains on changed licence texts."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import licenses as L


def runs(templates):
    held = {}
    for t, ids in enumerate(templates):
        for a in range(len(ids)):
            for b in range(a + 1, len(ids) + 1):
                held.setdefault(tuple(ids[a:b]), set()).add((t, b - 1))
    return held


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_all_runs(seed):
    rng = random.Random(seed)
    templates = [[rng.randrange(3) for _ in range(rng.randrange(0, 12))] for _ in range(5)]
    templates += [templates[0], templates[1][2:6]]
    held, auto = runs(templates), L.Automaton(templates, 2)
    text = [rng.choice([-1, 0, 0, 1, 1, 2, 2]) for _ in range(200)]
    for at, (state, size) in enumerate(auto.statistics(text)):
        want = next((n for n in range(at + 1, 0, -1) if tuple(text[at + 1 - n : at + 1]) in held), 0)
        assert size == want
        if size >= 2:
            assert sorted(auto.places[state]) == sorted(held[tuple(text[at + 1 - size : at + 1])])
        ended = {t for t, ids in enumerate(templates) if ids and text[max(0, at + 1 - len(ids)) : at + 1] == ids}
        assert {t for n, t in auto.whole[state] if n <= size} == ended


def plain_base(text):
    words = L.words_of(text or "")
    found = []
    for phrase, label in L.PHRASES.items():
        p = phrase.encode().split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def scan(spark, texts):
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, score int, spans string")
    return [r for r in L.scan(rows, F.col("doc_id"), F.col("text")).orderBy("key").collect()]


def test_phrases_against_plain_search(spark):
    rng = random.Random(9)
    pool = ["cc", "by", "General", "public", "License", "all", "rights", "reserved", "été", "the", "x9", "GNU", "all"]
    texts = [rng.choice([" ", "-", "\n", ". "]).join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [None, "", "...", "CC BY", "cc by " * 5000, "occ by", "cc bye", "All  rights\nreserved.", "Écc by", "cc by"]
    for text, row in zip(texts, scan(spark, texts), strict=True):
        words, found = plain_base(text)
        assert row.n_words == words
        assert sorted((s["first"], s["label"]) for s in row.spans if s["base"]) == found
        assert 0 <= row.score <= 1 and (row.score == 1 or not found)


def labels(row):
    return sorted({s["label"] for s in row.spans})


def test_chains(spark):
    mit, bsd = L.TEMPLATES["mit"][1], L.TEMPLATES["bsd"][0]
    words = mit.split()
    changed = " ".join("Example" if i % 19 == 7 else w for i, w in enumerate(words))
    broken = " ".join(w + ("\n * line" if i % 11 == 10 else "") for i, w in enumerate(words))
    half = " ".join(words[: len(words) // 2])
    texts = [
        mit, "before " * 40 + changed + " after" * 40, broken, half, mit.upper() + "\n" + bsd, mit + " and again " + mit, " ".join(reversed(words)), "clean words only",
        "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
        " ".join(words[:60]) + " gap" * (L.GAP + 1) + " " + " ".join(words[60:]),
    ]
    got = scan(spark, texts)
    assert labels(got[0]) == ["mit"] and got[0].score == 1 and [(s["first"], s["last"]) for s in got[0].spans] == [(0, got[0].n_words - 1)]
    assert labels(got[1]) == ["mit"] and got[1].spans[0]["first"] == 40 and 0.9 < got[1].score < 1
    assert labels(got[2]) == ["mit"]
    assert labels(got[3]) == [] and 0.4 < got[3].score < 0.6
    assert labels(got[4]) == ["bsd", "mit"]
    assert [s["label"] for s in got[5].spans] == ["mit", "mit"]
    assert labels(got[6]) == [] and labels(got[7]) == [] and got[7].score == 0
    assert labels(got[8]) == ["mit"] and labels(got[9]) == ["gpl", "gpl-3.0"] and labels(got[10]) == ["cc-by", "cc-by-nc-4.0"]
    # two parts too far apart are two chains
    assert labels(got[11]) == [] and 0.5 < got[11].score < 0.75


def test_long_text_and_empty_table(spark):
    mit = L.TEMPLATES["mit"][1]
    [row] = scan(spark, [("filler of any kind with " * 20 + mit) * 200])
    assert sum(s["label"] == "mit" for s in row.spans) == 200
    assert scan(spark, ["x"])[0].n_words == 1
    assert L.scan(spark.createDataFrame([], "doc_id long, text string"), F.col("doc_id"), F.col("text")).count() == 0
