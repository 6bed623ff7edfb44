import math
import re
import zlib
from collections import Counter
from itertools import accumulate

import pytest

from graphloom.llm import mixing, quality, toxicity


def slow_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_measures(spark, odd_docs, small):
    for df in (odd_docs, small):
        want = sorted(((r["doc_id"], *slow_measures(r["text"])) for r in df.collect()), key=repr)
        got = quality.quality(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_quality_verdicts(spark):
    clean = "this is the plain text of a report that was written for the people in it and by them"
    rows = [(1, clean), (2, "too short"), (3, "# $ % & * " * 20), (4, "the same five words again " * 20), (5, clean.upper() + "!!"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in quality.quality(df).filter("kept").collect()} == {1}
    out = quality.filter_quality(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [rows[0]]
    assert "Python" not in out._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        quality.compiled([quality.Rule("no_such_measure", most=1)])


def test_quality_filter_on_odd_rows(odd_docs, no_docs):
    assert quality.filter_quality(odd_docs).columns == odd_docs.columns
    assert quality.filter_quality(odd_docs).count() == quality.quality(odd_docs).filter("kept").count()
    assert quality.quality(no_docs).collect() == []


def test_fold():
    assert toxicity.fold("1d10t") == toxicity.fold("1D!0T") == " idiot "
    assert toxicity.fold("l0ser, LOSER! l\u043es\u0435r") == " loser loser loser "  # Cyrillic o and e
    assert toxicity.fold("Ünïté 2024") == " unite "
    assert toxicity.fold("") == "  "


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        text = f"some words about thing {i} and nothing else of note in this text " * 2
        if bad:
            text += ["you zorgling", "you z0rgling", "you zorglings here"][i % 3] + " and more"
        if i % 5 == 1:
            text += "the grumble festival opened"
        if i % 10 == 0:
            text += " grumble"
        rows.append((i, text, "clash"))
        labels.append((i, int(bad), 1))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic string"), spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")


def test_toxicity_on_held_out_rows(toxic_docs):
    docs, labels = toxic_docs
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 900 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 200 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_exception_phrases():
    m = toxicity.Model({" grum": 5.0}, {" grumble festival ": 5.0}, 3.0, -4.0)
    a = m.automaton()
    assert toxicity.density("a grumble festival", a) == 0
    assert toxicity.density("a grumble", a) > 0


def test_toxicity_odd_rows(odd_docs, no_docs, toxic_docs):
    _, labels = toxic_docs
    assert toxicity.toxicity(odd_docs, labels).count() == odd_docs.count()
    assert toxicity.toxicity(no_docs, labels).collect() == []
    assert {r["score"] for r in toxicity.toxicity(odd_docs, labels.limit(0)).collect()} == {0.0}


def slow_score(text, model):
    """The score by its definition: every entry and phrase is sought at every place."""
    folded = toxicity.fold(text or "")
    found = [w for words, sign in ((model.entries, 1), (model.exceptions, -1)) for e, weight in words.items() for k in range(len(folded)) if folded.startswith(e, k) for w in [sign * weight]]
    x = max(0.0, 100 * sum(found) / max(20, len(folded.split())))
    return 1 / (1 + math.exp(-(model.slope * math.log1p(x) + model.offset)))


def test_scores_against_plain_search(spark, odd_docs, small):
    model = toxicity.Model({" word": 2.0, " tie one": 0.5, " the": 0.01, " loser": 6.0, " idiot": 5.0}, {" the best ": 0.01, " word word ": 1.5}, 1.7, -3.0)
    docs = odd_docs.select("doc_id", "text").union(small.filter("doc_id < 60").select("doc_id", "text")).union(spark.createDataFrame([(900, "you l0ser, 1diot! the best word"), (901, None)], "doc_id bigint, text string"))
    want = sorted(((r["doc_id"], slow_score(r["text"], model)) for r in docs.collect()), key=repr)
    got = sorted(((r["doc_id"], r["score"]) for r in toxicity.score(docs, model).collect()), key=repr)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert max(abs(g[1] - w[1]) for g, w in zip(got, want, strict=True)) < 1e-9


def test_learning_is_repeatable(toxic_docs):
    """More labels than the bound: the same rows are taken, however the tables are dealt."""
    docs, labels = toxic_docs
    models = [toxicity.learn(docs.repartition(n), labels.repartition(n), most=200) for n in (1, 5)]
    assert models[0].entries and models[0] == models[1]


def test_exponent():
    tokens = [1000, 100, 100, 10]
    t = mixing.exponent(mixing.shape(tokens), None, 4.0)
    assert 0 < t < 1 and abs((1000 / 10) ** (1 - t) - 4.0) < 1e-6
    t = mixing.exponent(mixing.shape(tokens), 0.9, None)
    assert abs(mixing.entropy(mixing.weights(tokens, t)) - 0.9 * 1.3862943611) < 1e-6
    assert mixing.exponent(mixing.shape([5]), 0.9, 4.0) == 1.0 and mixing.exponent(mixing.shape([5, 5]), 0.9, 4.0) == 1.0


def slow_mix(rows, target, limit, seed=mixing.SEED):
    """(doc_id, epoch, tokens before) by plain loops."""
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    docs = [(i, "null" if s is None else "=" + s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), md5(t or "")) for i, t, s in rows]
    counts = Counter()
    for _, s, n, _ in docs:
        counts[s] += n
    out = []
    for share in mixing.targets(sorted(counts.items()), target, limit):
        left, epoch, before = share.target, 0, 0
        while True:
            order = sorted((int(md5(f"{seed}:{epoch}:{'' if i is None else i}:{d}")[:15], 16), n, d, i) for i, s, n, d in docs if s == share.source)
            rest = left - epoch * share.tokens
            inside = 0
            ends = dict(zip((o[0] for o in order), accumulate(o[1] for o in order), strict=True))  # equal rows end together
            for k, n, _, i in order:
                if rest >= share.tokens or ends[k] <= rest:
                    out.append((i, epoch, epoch * share.tokens + inside))
                inside += n
            epoch += 1
            if not share.tokens or left - epoch * share.tokens <= 0:
                break
    return sorted(out, key=repr)


def test_mix_against_brute_force(spark):
    rows = [(i, "w " * (i * 7 % 40), ["a", "a", "a", "a", "b", "c", None][i % 7]) for i in range(300)] + [(1000, "", "empty"), (1001, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    got = mixing.mix(df, target=0.99, limit=3.5, block_tokens=500)
    pdf = got.toPandas()
    assert sorted(zip(pdf.doc_id.tolist(), pdf.epoch.tolist(), pdf.before.tolist(), strict=True), key=repr) == slow_mix(rows, 0.99, 3.5)
    assert set(pdf.doc_id) == {r[0] for r in rows}  # no document is lost
    assert (pdf.groupby("block_id").slot.max() == pdf.groupby("block_id").size()).all()
    copies = Counter(r["doc_id"] for r in mixing.mixed_documents(df, target=0.99, limit=3.5).collect())
    assert copies == Counter(pdf.doc_id)


def test_mix_of_repeated_rows(spark, monkeypatch):
    """Ids that repeat or lack: the same result however the rows are dealt, also with more sources than the driver holds."""
    rows = [(i % 7 if i % 5 else None, "w " * (i * 3 % 11) + ("x" if i % 2 else ""), "abc"[i % 3] if i % 4 else "a", i) for i in range(120)]
    rows += rows[:30]
    want = slow_mix([r[:3] for r in rows], 0.99, 3.5)
    for n, most in ((1, 100), (5, 100), (3, 2)):
        monkeypatch.setattr(mixing, "MOST_SOURCES", most)
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, src int").repartition(n)
        got = [tuple(r) for r in mixing.mix(df, target=0.99, limit=3.5, block_tokens=50).select("doc_id", "epoch", "before", "block_id", "slot").collect()]
        assert sorted((g[:3] for g in got), key=repr) == want
        first = sorted(got, key=repr) if n == 1 else first
        assert sorted(got, key=repr) == first
        copies = mixing.mixed_documents(df, target=0.99, limit=3.5, copy_col="copy")
        assert Counter(r["doc_id"] for r in copies.collect()) == Counter(w[0] for w in want)
        assert copies.columns == [*df.columns, "copy"] and Counter(r["copy"] for r in copies.collect()) == Counter(w[1] for w in want)


def test_mix_odd_rows(odd_docs, no_docs):
    df = odd_docs.withColumnRenamed("sha", "source").withColumnRenamed("g", "_src").withColumnRenamed("key", "_copy")
    assert mixing.mixed_documents(df).columns == df.columns
    assert mixing.mix(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []
