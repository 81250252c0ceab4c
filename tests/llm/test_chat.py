"""Windows of conversations against a plain loop."""

import re

import regex
from pyspark.sql import functions as F

from millrace.llm import chat


def escape(s):
    return re.sub(r"\[(?=/?INST\])", "[\\\\", re.sub(r"<(?=[|/s])", r"<\\", s.replace("\\", "\\\\")))


def plain(rows):
    """{conv: [(formatted, loss texts)]}"""
    out = {}
    for conv in {r[0] for r in rows}:
        said = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        at, turns = 0, []
        for k, (_, _, role, text) in enumerate(said):
            turns.append((at, role, text, k == 0 and role == "system"))
            at += len(regex.findall(r"[\p{L}\p{N}]{1,4}|[^\p{L}\p{N}\s]", text)) + chat.MARKS
        out[conv] = []
        for cell in sorted({t[0] // chat.STRIDE for t in turns}):
            fresh = [t for t in turns if t[0] // chat.STRIDE == cell]
            first = fresh[0][0]
            before = [t for t in turns if t[0] < first and (t[3] or first - t[0] <= chat.HISTORY)]
            told = "".join(f"<|role|>{escape(r)}<|text|>{escape(x)}<|end|>" for _, r, x, _ in before + fresh)
            out[conv].append((told, [x for _, r, x, _ in fresh if r == "assistant"]))
    return out


def test_windows(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRIDE", 30)
    monkeypatch.setattr(chat, "HISTORY", 25)
    monkeypatch.setattr(chat, "BLOCK", 7)
    hostile = "\\ <|end|> <\\| </s><s>[INST] [/INST] [\\INST] <|text|> \\\\|"
    rows = [(1, 0, "system", "Be good"), (2, 0, "user", hostile), (2, 1, "assistant", hostile), (2, 2, hostile, hostile), (3, None, None, None), (3, 5, "assistant", ""), (None, 1, "assistant", "x\ny")]
    rows += [(1, k, "user" if k % 2 else "assistant", f"words number {k} " * (k % 5)) for k in range(1, 60)]
    rows += [(4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (4, 1, "assistant", "a " * 500), (4, 2, "user", "after")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cell int")
    made = chat.windows(df)
    got, want = {}, plain(rows)
    for r in made.orderBy("conv_id", "cell").collect():
        got.setdefault(r.conv_id, []).append((r.formatted, [r.formatted[s.start : s.end] for s in r.loss]))
    assert got == {c: [(f, [escape(x) for x in t]) for f, t in w] for c, w in want.items()}
    assert len(got[1]) > 5
    back = {}
    for r in chat.read_back(made).orderBy("conv_id", "cell").collect():
        back.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
    for conv in {r[0] for r in rows}:
        assert back[conv] == [(r or "", x or "") for _, _, r, x in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
    assert chat.windows(df.limit(0)).count() == 0
    assert made.where(F.size("fresh") == 0).count() == 0
