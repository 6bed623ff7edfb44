import corpus_pipeline
from graphloom.llm import catalog, quality
from graphloom.llm.common import written
from tests.llm.test_quality_toxicity_mixing import slow_mix
from tests.llm.test_simhash import slow_components
from tests.llm.test_substring_dedup import slow

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "simhash", "substrings", "mixing", "packing"]

    good, _ = written(stages["quality"](spark, docs, SF), "t")
    kept = {r["doc_id"] for r in quality.quality(docs).filter("kept").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == kept

    single, _ = written(stages["simhash"](spark, good, SF), "t")
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert {r["doc_id"] for r in single.collect()} == {i for i, _, least in slow_components(rows) if i == least}

    cut, _ = written(stages["substrings"](spark, single, SF), "t")
    want = {i: n - gone for i, n, gone, _, _ in slow([(r["doc_id"], r["text"].encode()) for r in single.collect()], 50)}
    got = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == docs.columns and set(got) == set(want)
    assert all(0 <= want[i] - len(r["text"].encode()) <= 6 and r["n_chars"] == len(r["text"]) for i, r in got.items())  # less only by broken characters

    mixed, _ = written(stages["mixing"](spark, cut, SF), "t")
    want = slow_mix([(r["doc_id"], r["text"], r["source"]) for r in cut.collect()], 0.97, corpus_pipeline.REPEAT_LIMIT)
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(i for i, _, _ in want)

    packed = stages["packing"](spark, mixed, SF).collect()
    assert {r["doc_id"] for r in packed} == set(got)


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11))


def through(spark, docs):
    stages = corpus_pipeline.STAGES
    for name, stage in stages[:-1]:
        out, _ = written(stage(spark, docs, SF), "t")
        assert sorted(out.columns) == sorted(docs.columns), name
        docs = out
    return docs, stages[-1][1](spark, docs, SF).collect()


GOOD = "this is a plain report of the people in the town and what they did on the day of the fair with all of their friends"


def test_odd_rows(spark):
    """Nulls, empty, repeated and very long texts, ids that repeat or lack, names that the stages use themselves."""
    rows = [(1, GOOD), (1, GOOD), (2, GOOD), (3, None), (4, ""), (None, GOOD + " and a word more for the one without id"), (5, " ".join(f"{w}{i}" if i % 3 else w for i in range(3_000) for w in ("the", "tale", "of", "a"))), (6, "x" * 100_000)]
    clash = ("n_chars", "row", "_src", "_gone", "copy", "key", "k", "g", "sha", "curve", "kept", "fp")
    df = spark.createDataFrame([(i, t, "s", *[7] * len(clash)) for i, t in rows], "doc_id bigint, text string, source string, " + ", ".join(f"`{c}` int" for c in clash)).repartition(3)
    docs, pieces = through(spark, df)
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == {1, 5, None} and {r["doc_id"] for r in pieces} == kept
    assert all(r["row"] == 7 and r["copy"] == 7 for r in docs.collect())
    assert {r["copy"] for r in pieces if r["doc_id"] == 1} >= {0, 1}


def test_empty_table(spark):
    docs, pieces = through(spark, spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    assert docs.collect() == [] and pieces == []
