import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import warc


def pages(spark):
    inner = warc.record(99, "http://x", b"inside", warc.digest(b"inside"), None).decode()
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i * 37 % 90)) for i in range(60)]
    # Payloads that hold whole records, bare magic and cut headers.
    rows += [(100, "u", inner * 9), (101, None, "WARC/1.1\r\n" * 50), (102, "a b\r\nc", "x" * 3000 + inner[:60]), (103, "u", None), (104, "u", ""), (105, "u", rows[5][2]), (106, "u", rows[5][2]), (5, "again", rows[5][2])]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)


def slow(rows, least):
    first = {}
    for r in rows:
        h = (r["html"] or "").encode()
        if len(h) >= least:
            first[h] = min(first.get(h, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        h = (r["html"] or "").encode()
        ref = first.get(h, r["page_id"])
        revisit = ref < r["page_id"]
        out.append((r["page_id"], len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", ref if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("step, least", [(500, 0), (4096, 0), (1 << 20, 10)])
def test_round_trip(spark, step, least):
    df = pages(spark)
    out = warc.round_trip(df, least, step=step)
    got = out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == slow(df.collect(), least)
    payload = {r["page_id"]: r["payload"] for r in out.filter("record_type = 'response'").collect()}
    for r in df.filter(F.col("page_id") >= 100).collect():
        assert payload.get(r["page_id"], b"") in (b"", (r["html"] or "").encode())


def test_urls_come_back_whole(spark):
    urls = ["http://h/" + "q" * 9_000, "http://h/" + "é" * 100_000, "http://h/a b\tc%20d", " http://h/x\r\n\r\ny ", "http://h/%20", "", None, "about:blank", "http://h/\x00\x01\x7f\x1c", "\x85", " "]
    df = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["url"] for r in warc.round_trip(df, step=4096).collect()}
    assert [got[i] for i in range(len(urls))] == urls


def test_many_ranges_share_tasks(spark, monkeypatch):
    """Tasks grow with the bytes, not with the ranges."""
    df = pages(spark)
    folder = warc.new_path(spark, "warc-test")
    files = warc.write_archives(df, folder)
    total = sum(n for _, n in files)
    assert total // 100 > 100
    assert warc._ranges(spark, files, 100).rdd.getNumPartitions() <= 4
    monkeypatch.setattr(warc, "TASK_BYTES", total // 20)
    assert 15 <= warc._tasks(spark, files, 100) <= 21
    got = warc.read_archives(spark, folder, files, 100).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == slow(df.collect(), 0)


def test_empty_table(spark):
    assert warc.round_trip(pages(spark).limit(0)).collect() == []


def test_hot_digest_and_clashing_names(spark, monkeypatch):
    """A third of all payloads is one payload; the columns' names are those that the operator uses itself."""
    monkeypatch.setattr("graphloom.llm.common.HOT_KEYS", 5)
    rows = [(i, "u", ["same", f"p{i}", ""][i % 3], 1, 2, 3) for i in range(90)] + [(None, "u", "same", 1, 2, 3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, sha1 int, first int, refers_to int").repartition(3)
    got = warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    want = slow([r for r in df.collect() if r["page_id"] is not None], 0)
    assert sorted((tuple(r) for r in got if r["page_id"] is not None), key=repr) == want
    assert [r["record_type"] for r in got if r["page_id"] is None] == ["response"]
