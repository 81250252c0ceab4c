"""Leaks of benchmark items against a plain search, slots and odd rows."""

import re

from millrace.llm import decontaminate
from millrace.llm.queries import QUERIES
from tests.conftest import SMALL


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.leaks(d, b, "doc_id", "text", "item_id", "text").collect()}


ITEM = "If Anna buys 3 apples for 6 dollars and gives 3 to Ben, how much does each of the apples cost her then?"


def test_slots(spark):
    docs = [
        (1, "Before. " + ITEM + " After."),
        (2, "if anna buys 3 apples for 6 dollars, and gives 3 to ben how much does each of the apples cost her then"),
        (3, "So this: If Carla buys 5 apples for 8 dollars and gives 5 to Dora, how much does each of the apples cost her then?"),
        (4, "Text. If Carla buys 5 apples for 8 dollars and gives 7 to Carla, how much does each of the apples cost her then?"),
        (5, "If Anna buys 3 apples for 6 dollars she is fed."),
        (6, None), (7, ""), (None, ITEM), (8, ITEM + "\n" + ITEM), (8, ITEM),
    ]
    got = run(spark, docs, [(10, ITEM), (11, "two words"), (12, None), (13, "..."), (14, "1 2 3 4 5 6")])
    assert {k for k in got if k[1] == 10} >= {(1, 10), (3, 10), (8, 10), (None, 10)}
    assert not {k for k in got if k[0] in (4, 5, 6, 7)} and not {k for k in got if k[1] != 10}
    assert got[(1, 10)].same_values and not got[(3, 10)].same_values and got[(1, 10)].covered == 1
    assert run(spark, docs + [(9, "so, TWO words!")], [(11, "two words")]).keys() == {(9, 11)}
    assert run(spark, [(1, "7 1 2 3 4 5 6 7"), (2, "9 8 7 6 5 4 3")], [(14, "1 2 3 4 5 6")]).keys() == {(1, 14)}
    assert run(spark, docs, []) == {} and run(spark, [], [(1, ITEM)]) == {}


def test_values_may_become_equal(spark):
    tell = lambda a, x, y, z, b: f"So {a} buys {x} apples for {y} dollars and gives {z} to {b} before she goes home to sleep."
    docs = [(1, tell("Carla", 4, 8, 7, "Dora")), (2, tell("Carla", 4, 8, 4, "Dora")), (3, tell("Carla", 4, 8, 7, "Carla")), (4, tell("Anna", 3, 6, 5, "Ben"))]
    got = run(spark, docs, [(1, docs[-1][1])])
    assert {k[0] for k in got} == {1, 2, 3, 4}
    assert [got[(d, 1)].distinct_values for d in (1, 2, 3, 4)] == [True, False, False, True] and got[(4, 1)].same_values


def test_very_long_text(spark):
    filler = "nothing to see in this part of the text "
    got = run(spark, [(1, filler * 20_000 + ITEM + filler * 20_000), (2, filler * 20_000)], [(10, ITEM)])
    assert set(got) == {(1, 10)}


def test_query_on_documents(spark):
    """Whole items found by a plain search of their words are found, and nothing else."""
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontamination"](spark, SMALL).collect()}
    assert want and got == want


def test_texts_side_by_side_stay_apart(spark):
    """Texts are looked at together: no window, sentence or unit crosses from one to the next."""
    docs = [(k, t) for k, t in enumerate(["so two", "words", "", "he has 5", "km to go", "He said. Two", None, "words", "so two words"])]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(1, "two words"), (2, "5 km"), (3, "go he")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b, "doc_id", "text", "item_id", "text").collect()] == [(8, 1)]
    own = decontaminate.Templates()
    at, kind, hashes, bounds = own.tokens(["A b. C 5", "km D", "", "D"])
    alone = [own.tokens([t]) for t in ["A b. C 5", "km D", "", "D"]]
    assert bounds.tolist() == [0, 4, 6, 6, 7] and kind.tolist() == [x for a in alone for x in a[1].tolist()]
    assert hashes.tolist() == [x for a in alone for x in a[2].tolist()] and at.tolist() == [x for a in alone for x in a[0].tolist()]
