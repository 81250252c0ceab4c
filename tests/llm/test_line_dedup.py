"""Line dedup against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import line_dedup
from millrace.llm.queries import QUERIES
from tests.conftest import SMALL


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(docs, edits, fuzzy_from):
    """[(id, text)] -> [(id, kept text)], line by line."""
    rows = sorted({(i is not None, i or 0, t or "") for i, t in docs})
    lines = [(d, p, x) for d, (_, _, t) in enumerate(rows) for p, x in enumerate(t.split("\n")) if x.strip(" ")]
    first = {}
    for d, p, x in lines:
        first.setdefault(x, (d, p))
    group = {x: x for x in first}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    names = [x for x in first if len(x) >= fuzzy_from]
    for k, x in enumerate(names):
        for y in names[:k]:
            if abs(len(x) - len(y)) <= edits and distance(x, y) <= edits:
                a, b = root(x), root(y)
                if a != b:
                    a, b = sorted([a, b], key=first.get)
                    group[b] = a
    kept = {first[root(x)] for x in first}
    out = {}
    for d, (has, i, t) in enumerate(rows):
        out[(i if has else None, t)] = "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(" ") or (d, p) in kept)
    return sorted(((i, out[(i, t or "")]) for i, t in docs), key=str)


def run(spark, docs, **args):
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, rid long")
    rows = line_dedup.dedup_lines(df, "doc_id", "text", **args).collect()
    assert all(r.rid == r.doc_id for r in rows)
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_distance(spark, edits):
    rng = random.Random(edits)
    pairs = [("", ""), ("a", ""), ("", "abc"), ("abc", "abc"), ("ab", "ba"), ("aaaa", "aaa"), ("abab", "baba")]
    for _ in range(400):
        x = "".join(rng.choices("abé😀", k=rng.randint(0, 24)))
        y = list(x)
        for _ in range(rng.randint(0, edits + 2)):
            at = rng.randint(0, len(y))
            y[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
        pairs.append((x, "".join(y)))
    df = spark.createDataFrame([(k, list(a), list(b)) for k, (a, b) in enumerate(pairs)], "k int, a array<string>, b array<string>").repartition(4)
    for r in df.select("k", line_dedup.edit_distance(F.col("a"), F.col("b"), edits).alias("d")).collect():
        want = distance(*pairs[r.k])
        assert r.d == want if want <= edits else r.d > edits, pairs[r.k]


@pytest.mark.parametrize("edits", [1, 2])
def test_dedup(spark, edits):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcde ", k=rng.randint(8, 40))) for _ in range(25)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randint(0, len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "é"])
            lines.append("".join(x))
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, docs[3][1]), (103, docs[3][1]), (None, docs[4][1]), (104, "x" * 30_000 + "\n" + "x" * 30_001)]
    want = plain([d for d in docs if d[0] != 104], edits, 12)
    got = run(spark, docs, edits=edits, fuzzy_from=12)
    assert [x for x in got if x[0] == 104] == [(104, "x" * 30_000)]
    assert [x for x in got if x[0] != 104] == want
    assert run(spark, [], edits=edits) == []


def radius(x, edits=1):
    return max(edits, min(len(x) // 40, line_dedup.MOST))


def far_apart(x, y):
    a, b = Counter(x), Counter(y)
    return sum(((a - b) + (b - a)).values())


def test_query_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = QUERIES["op8_line_dedup"](spark, SMALL).collect()
    seen, want = set(), {}
    for i, t in sorted(docs):
        keep = [x for x in t.split("\n") if not x.strip(" ") or not (x in seen or seen.add(x))]
        want[i] = "\n".join(keep)
    assert len(rows) == len(docs)
    close = [r for r in rows if r.text != want[r.doc_id]]
    near = lambda x, y: x != y and abs(len(x) - len(y)) <= radius(min(x, y, key=len)) and distance(x, y) <= radius(min(x, y, key=len))
    for r in close:  # beyond equal lines only lines with a near twin may go
        gone = [x for x in want[r.doc_id].split("\n") if x not in r.text.split("\n")]
        assert gone and all(any(near(x, y) for y in seen) for x in gone)
    # every near pair but the first line of each chain
    lines = sorted(x for x in seen if len(x) >= 24)
    pairs = [(x, y) for i, x in enumerate(lines) for y in lines[:i] if abs(len(x) - len(y)) <= line_dedup.MOST and far_apart(x, y) <= 2 * radius(min(x, y, key=len)) and near(x, y)]
    kept = {x for r in rows for x in r.text.split("\n")}
    assert not [p for p in pairs if p[0] in kept and p[1] in kept]
    assert all(r.lines_in == len(dict(docs)[r.doc_id].split("\n")) for r in rows)


def edited(rng, line, edits):
    x = list(line)
    for _ in range(edits):
        at = rng.randint(0, len(x))
        x[at : at + rng.randint(0, 1)] = rng.choice(["", "z", " ", "é", "😀"])
    return "".join(x)


def test_edits_follow_the_length(spark):
    rng = random.Random(4)
    lines = []
    for n in (30, 78, 81, 100, 119, 122, 160, 420):
        for blank in (" ", ""):
            line = blank.join("".join(rng.choices("abcdefghé😀", k=rng.randint(2, 7))) for _ in range(n // 4))[:n].strip()
            lines += [line] + [edited(rng, line, k) for k in (1, 1, 2, 2, 3, 3, 4, 6)]
    rng.shuffle(lines)

    root = list(range(len(lines)))
    for i, x in enumerate(lines):
        for j, y in enumerate(lines[:i]):
            r = radius(min(x, y, key=len))
            if abs(len(x) - len(y)) <= r and distance(x, y) <= r:
                a, b = sorted([root[i], root[j]])
                root = [a if v == b else v for v in root]
    want = sorted(x for i, x in enumerate(lines) if root[i] == i)
    got = sorted(x for _, t in run(spark, list(enumerate(lines))) for x in [t] if x)
    assert got == want and len(want) < len(lines) - 60


def test_two_typos_in_a_long_line(spark):
    line = "the quick brown fox jumps over the lazy dog and then runs far away into the deep green forest where nobody has ever seen it come back again before dawn today"
    assert len(line) < 160 and run(spark, [(1, line), (2, line.replace("quick", "quikc"))]) == [(1, line), (2, "")]


def counted(monkeypatch):
    """Pairs that reach the edit distance."""
    seen, verify = [], line_dedup.near

    def near(pairs, *args):
        seen.append(pairs.count())
        return verify(pairs, *args)

    monkeypatch.setattr(line_dedup, "near", near)
    return seen


@pytest.mark.parametrize("hot", [20, 1000])
def test_lines_that_share_segments_but_are_not_near_make_few_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    seen, rng = counted(monkeypatch), random.Random(6)
    words = ["".join(rng.choices("abcdefghilmnoprstu", k=6)) for _ in range(50)]
    lines = []
    for i in range(200):
        own = list(words)
        for at in rng.sample(range(0, 16), 3):
            own[at] = "".join(rng.choices("abcdefghilmnoprstuvwxyz", k=6))
        lines.append(" ".join(own))
    lines += [edited(rng, lines[k], 2) for k in (3, 50, 120)]
    assert dict(run(spark, list(enumerate(lines)))) == dict(enumerate([*lines[:200], "", "", ""]))
    assert 3 <= sum(seen) < 200 * 199 / 2 / 20


@pytest.mark.parametrize("edits", [1, 2])
def test_groups_around_one_line_of_a_key(spark, monkeypatch, edits):
    """Lines near one of a key make no pairs among themselves, and no link is lost."""
    monkeypatch.setattr(line_dedup, "HOT", 8)
    seen, rng = counted(monkeypatch), random.Random(8)
    marks = "0123456789abcdefghijklmnopqrstuvwxyz"
    lines = [f"the sign of this page is {a}, in the book {b if edits == 2 else 0}" for a in marks for b in rng.sample(marks, 4)]
    lines = sorted(set(lines))
    rng.shuffle(lines)
    lines += [edited(rng, x, rng.randint(1, 3)) for x in rng.sample(lines, 10)]
    rng.shuffle(lines)
    docs = list(enumerate(lines))
    assert run(spark, docs, edits=edits) == plain(docs, edits, 24)
    assert len(seen) == 2 and sum(seen) < len(lines) * (len(lines) - 1) / 2 / 2


def test_all_keys_are_made_and_dealt_out_once(spark, monkeypatch):
    plans, write = [], line_dedup.cut

    def cut(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return write(df, name)

    monkeypatch.setattr(line_dedup, "cut", cut)
    near, far = "a line of text that others come near to, one way", "nothing here is close to what stands elsewhere"
    lines = [near, near.replace("way", "wax"), near + "s", far]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.xxhash64("line").alias("h1"))
    names = {r.h1: r.line for r in df.collect()}
    probes, index = line_dedup.sharing(df, 1, 2, 40)
    met = probes.join(index, "key").where("a <> b").select("a", "b").distinct().collect()
    pairs = {frozenset([names[r.a], names[r.b]]) for r in met}
    assert pairs >= {frozenset([near, lines[1]]), frozenset([near, lines[2]])} and not any(far in p for p in pairs)
    assert sum(p.count("Generate explode(") for p in plans) == 1 and sum(p.count("ReusedExchange") for p in plans) == 1


def test_only_texts_that_lose_lines_move(spark, monkeypatch):
    moved, join = [], line_dedup.without

    def without(docs, drops):
        moved.append(docs.count())
        return join(docs, drops)

    monkeypatch.setattr(line_dedup, "without", without)
    docs = spark.range(80_000).select(F.xxhash64("id").alias("rid"), F.concat(F.lit("first\nlast "), F.col("id")).alias("body"), "id")
    drops = docs.where("id % 2 = 0").select("rid", F.array(F.lit(0)).alias("gone"))
    got = line_dedup.without_most(docs, drops).select("id", "body", F.concat(F.when(F.col("id") % 2 == 0, "").otherwise("first\n"), F.lit("last "), F.col("id")).alias("want"))
    assert got.count() == 80_000 and got.where("body <> want").count() == 0
    assert 40_000 <= moved[0] < 42_000
