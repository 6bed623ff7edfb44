import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import substring_dedup


def slow(rows, length):
    first = {}
    for i, t in rows:
        for s in range(len(t) - length + 1):
            if i is not None:
                first[t[s : s + length]] = min(i, first.get(t[s : s + length], i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if i is not None and first[t[s : s + length]] < i:
                gone[s : s + length] = True
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def fast(df, **how):
    rows = substring_dedup.removed(df, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("k")).collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("seed, length, gram", [(1, 50, 24), (2, 50, 24), (3, 20, 8)])
def test_against_brute_force(spark, seed, length, gram):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["ab", "cde", "f", "ghij", "ünö"]) for _ in range(60)) for _ in range(5)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randrange(6)):
            a = rng.randrange(100)
            parts.append(rng.choice([rng.choice(base)[a : a + rng.randrange(15, 140)], "q" * rng.randrange(90), f"only{i} " * 4]))
        rows.append((i, "".join(parts)))
    rows += [(200, rows[7][1]), (201, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = slow([(i, t.encode()) for i, t in rows], length)
    assert fast(df, length=length, gram=gram) == want
    # Many groups: equal runs meet before their bucket.
    assert fast(df, length=length, gram=gram, group_bytes=300, meet_groups=3) == want


def test_odd_rows(odd_docs):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect()]
    assert fast(odd_docs) == slow(rows, 50)


def test_common_passage_and_long_rows_of_one_sign(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RUN", 100)
    passage = "this passage of a licence is in every third document of all, word for word, and longer than fifty bytes. "
    rows = [(i, (f"own{i} " * (i % 5) + passage * (1 + i % 3) + f" end {i}") if i % 3 == 0 else "=" * (40 + 13 * i) + f"{i}") for i in range(60)]
    rows += [(70, None), (71, rows[3][1]), (72, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert fast(df, meet_groups=2) == slow([(i, (t or "").encode()) for i, t in rows], 50)


def test_clashing_names(spark):
    columns = ("doc_id", "text", "g", "sha", "row", "p", "kept", "n", "block")
    df = spark.createDataFrame([(1, "a" * 60, *range(7)), (2, "a" * 60, *range(7))], "doc_id bigint, text string, " + ", ".join(f"`{c}` int" for c in columns[2:]))
    out = substring_dedup.cut_documents(df)
    assert out.columns == list(columns)
    assert sorted(map(tuple, out.collect())) == [(1, "a" * 60, *range(7)), (2, "", *range(7))]


def test_empty_table(no_docs):
    assert fast(no_docs) == []


def test_cut_documents_keeps_columns(spark):
    text = "über " * 30
    df = spark.createDataFrame([(1, text, "a"), (2, "x" + text + "tail", "b"), (3, None, "c")], "doc_id bigint, text string, lang string")
    out = {r["doc_id"]: r for r in substring_dedup.cut_documents(df).collect()}
    assert substring_dedup.cut_documents(df).columns == df.columns
    assert out[1]["text"] == text and out[2]["text"] == "xtail" and out[3]["text"] == "" and out[3]["lang"] == "c"


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.choice(b"abc ") for _ in range(5000))
    whole = substring_dedup.runs(text, 50, 24)
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    parts = substring_dedup.runs(text, 50, 24)

    def windows(r):
        return {(s, int(h)) for a, b, h in zip(*r, strict=True) for s in range(a, b + 1)}

    assert windows(whole) == windows(parts) and len(windows(whole)) == 5000 - 49
