"""Each stage of the pipeline on its own input against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from millrace.llm import bpe, simhash

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return {name: ([r.asDict() for r in a.collect()], [r.asDict() for r in b.collect()]) for name, a, b in out}


def test_columns_and_order(stages):
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"]
    for name, (_, rows) in stages.items():
        assert set(rows[0]) == ({"doc_id", "ids", "decoded"} if name == "bpe" else set(pipeline.COLUMNS))


def test_quality_keeps_good_documents(spark, stages):
    before, after = stages["quality"]
    kept = {r["doc_id"] for r in after}
    marked = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert np.mean([i in kept for i, q in marked.items() if q]) > 0.97 and np.mean([i in kept for i, q in marked.items() if not q]) < 0.5
    assert all(r in before for r in after)


def test_lines(stages):
    before, after = stages["line_dedup"]
    assert sorted(r["doc_id"] for r in before) == sorted(r["doc_id"] for r in after)
    lines = [x for r in after for x in r["text"].split("\n") if x.strip(" ")]
    assert len(lines) == len(set(lines)) and all(r["n_chars"] == len(r["text"]) for r in after)
    whole = {x for r in before for x in r["text"].split("\n") if x.strip(" ")}
    assert len(whole) - len(lines) < 0.02 * len(whole)


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    kept = {r["doc_id"] for r in after}
    assert len(kept) == len(after)
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    alike = lambda a, b: (len(a & b) / len(a | b)) if a | b else 1.0
    for i, s in sets.items():
        near = [alike(s, t) for j, t in sets.items() if j != i]
        if max(near, default=0) < 0.8:
            assert i in kept
        if i not in kept:
            assert any(alike(s, sets[j]) >= 0.8 for j in sets if j != i)
    # groups of linked documents: one of each stays
    ids, root = list(sets), {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if alike(sets[i], sets[j]) >= 0.8:
                low, high = sorted([top(i), top(j)])
                root[high] = low
    want = {i for i in ids if top(i) == i}
    assert want <= kept and len(kept - want) <= 0.02 * len(ids) and len(kept - want) <= 0.05 * len(set(ids) - want)


def test_decontamination(spark, stages):
    import re

    before, after = stages["decontamination"]
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {r["doc_id"] for r in before if not any(x in words(r["text"]) for x in items)}
    assert {r["doc_id"] for r in after} == want


def test_encoding(stages):
    import public_tokenizers

    before, after = stages["bpe"]
    own = bpe.codec(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in before}
    assert len(after) == len(before) and all(bytes(r["ids"]) == own.encode(texts[r["doc_id"]]) and r["decoded"] == own.decode(bytes(r["ids"])) for r in after)


@pytest.mark.parametrize("bucket", [64, 4])
def test_near_copies_meet(spark, monkeypatch, bucket):
    """On both sides of 0.8: pairs above it are found, pairs below it are not linked."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "ALL_PAIRS", bucket)
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    texts = []
    for k in range(360):
        words = rng.choices(vocabulary, k=rng.choice([100, 200, 400]))
        texts.append(" ".join(words))
        # each replaced word spoils five shingles on each side
        for at in rng.sample(range(len(words)), round(len(words) * (0.015 + 0.00009 * k))):
            words[at] = "other"
        texts.append(" ".join(words))
    texts += ["", None, " "]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, rank int")
    got = {r.key: r.component.key for r in simhash.similar_documents(df, F.col("doc_id"), F.col("text"), 5).collect()}
    sets = [shingles(t or "") for t in texts]
    shares = [len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(360)]
    met = [got[2 * k] == got[2 * k + 1] for k in range(360)]
    above, below = [m for m, s in zip(met, shares) if s >= 0.8], [m for m, s in zip(met, shares) if s < 0.8]
    assert min(len(above), len(below)) > 60 and not any(below) and sum(above) >= 0.98 * len(above)
    assert [got[720], got[721], got[722]] == [720] * 3


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rank int"
    df = spark.createDataFrame([(1, None, None, None, None, 1), (1, None, None, None, None, 1), (None, "a b", "x", "y", 3, 1), (2, "", "", "", 0, 1), (3, "q " * 50_000, "", "", 1, 1)], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = df
    for name, stage in pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            path = f"{tmp_path}/{name}-{rows is docs}"
            stage(spark, rows, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(f"{tmp_path}/{name}-True")
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "3", "None"]
    assert docs.count() == 3


def test_no_pair_of_a_large_bucket_is_left_out(spark, monkeypatch):
    """All texts are in one bucket and most within the radius, but each is alike one other only, or a few."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "wide_keys", lambda fps: fps.select("fp", F.lit(0).alias("table"), F.lit(0).alias("key")))
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(204)]
    texts = []
    for k in range(simhash.ALL_PAIRS):
        words = list(base)
        for at in range(4):
            words[10 + 50 * at + rng.randrange(30)] = f"v{k}-{at}"
        texts.append(" ".join(words))
        words[2] = f"w{k}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.key: r.component.key for r in simhash.similar_documents(df, F.col("doc_id"), F.col("text"), 5).collect()}
    sets, want = [shingles(t) for t in texts], list(range(len(texts)))
    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            if len(a & b) >= 0.8 * len(a | b):
                low, high = sorted([want[j], want[k]])
                want = [low if x == high else x for x in want]
    assert got == dict(enumerate(want)) and len(set(want)) > 50


def bucket_of(values):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([[r.astype(">u8").tobytes() for r in v] for v in values], pa.list_(pa.binary()))], ["fps"])


def copies(rng, n, flips):
    """One wide fingerprint n times, up to so many bits of each turned."""
    bits = np.repeat(rng.integers(0, 2, (1, 256), dtype=np.uint8), n, 0)
    for row in bits:
        row[rng.choice(256, rng.integers(0, flips), replace=False)] ^= 1
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def joined(pairs, n):
    root = list(range(n))
    for a, b in pairs:
        root = [root[a] if r == root[b] else r for r in root]
    return root


@pytest.mark.parametrize("n, near", [(2, 2), (12, 5), (64, 40), (65, 3), (146, 30), (192, 150), (300, 4)])
def test_pairs_of_a_bucket(n, near):
    """Buckets of all sizes, some of them side by side: all pairs within the radius, or trees of the same components."""
    rng = np.random.default_rng(n)
    values = [np.unique(np.concatenate([copies(rng, near, 40), rng.integers(0, 2**64, (n - near, 4), dtype=np.uint64)]), axis=0) for _ in range(5)]
    rows = [tuple(r) for b in simhash.wide_bucket_pairs([bucket_of(values)]) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    for v in values:
        place = {r.astype(">u8").tobytes(): k for k, r in enumerate(v)}
        got = [tuple(sorted((place[a], place[b]))) for a, b, _ in rows if a in place]
        want = [(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None]).sum(-1, dtype=int) <= simhash.WIDE_RADIUS), strict=True) if i < j]
        trees = n > simhash.ALL_PAIRS and near > simhash.FEW + 1
        assert {m for a, _, m in rows if a in place} == {trees} and got and len(got) == len(set(got))
        if trees:
            assert set(got) <= set(want) and len(got) < len(v) and joined(got, len(v)) == joined(sorted(want), len(v))
        else:
            assert sorted(got) == want


def test_work_of_a_large_bucket(monkeypatch):
    """Fingerprints far from one another are compared many at a time, not each by a walk of its own."""
    calls = []
    above = simhash.above
    monkeypatch.setattr(simhash, "above", lambda *a: calls.append(1) or above(*a))
    unrelated = np.random.default_rng(4).integers(0, 2**64, (640, 4), dtype=np.uint64)
    assert list(simhash.wide_bucket_pairs([bucket_of([unrelated])])) == [] and 0 < len(calls) < 20
