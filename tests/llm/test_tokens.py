import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import packing, token_counts, token_files
from graphloom.llm.common import tokenizer_path
from graphloom.llm.tokens import WordEncoder

BPE, PIECES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")


def odd_texts(n=300):
    rng = random.Random(8)
    atoms = [*"aB ,.'!\n\t\r é世—1<|#▁", "<|endoftext|>", "<|ENDOFTEXT|>", "  ", "'s", "'LL", "İ", "ẞ", "Å", "é", "word", " "]
    return ["", " ", "\n", " a ", "a  b", *("".join(rng.choice(atoms) for _ in range(rng.randint(0, 40))) for _ in range(n))]


LIBRARY = Tokenizer.from_file(BPE)


def slow_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


def test_word_encoder_equals_library():
    tok, texts = Tokenizer.from_file(BPE), odd_texts()
    for cache in (3, 1_000_000):  # a full cache is dropped between calls
        enc = WordEncoder(BPE, cache)
        for k in range(0, len(texts), 50):
            part = texts[k : k + 50]
            ids, sizes = enc.encode([t.encode() for t in part])
            at = np.cumsum([0, *sizes])
            for i, t in enumerate(part):
                assert ids[at[i] : at[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_piece_lengths_equal_library():
    sp, lengths = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.PieceLengths(PIECES)
    for t in odd_texts():
        assert sum(map(lengths.__getitem__, token_counts.pretokens(t.encode()))) == len(sp.encode(t)), repr(t)


def test_long_chunks_are_counted_and_not_kept():
    """Texts without spaces would fill the cache with whole texts."""
    sp, lengths = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.PieceLengths(PIECES)
    for word in ("word", "x" * 64, "y" * 65, "漢字" * 5_000, "QUJD+/" * 20_000):
        for _ in range(2):
            assert sum(map(lengths.__getitem__, token_counts.pretokens(word.encode()))) == len(sp.encode(word))
    assert max(map(len, lengths)) == 64 and sum(map(len, lengths)) <= 64 * len(lengths)


def test_token_counts(odd_docs, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(sp.encode(r["text"] or "")), n > 100) for r in odd_docs.collect()), key=repr)
    for entries in (1, 1000):
        assert sorted(map(tuple, token_counts.token_counts(odd_docs, PIECES, 100, entries=entries).collect()), key=repr) == want
    assert token_counts.token_counts(no_docs, PIECES, 100).collect() == []


def check_pieces(df, length=2048):
    rows = packing.pack(df, BPE, 1, length).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        n = sum(r["length"] for r in parts)
        assert [r["offset"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist()
        assert n == length or n < length and n & (n - 1) == 0
    return by_doc


def test_packing(small):
    by_doc = check_pieces(small)
    for r in small.collect()[:40]:
        parts = sorted(by_doc[r["doc_id"]], key=lambda x: x["start"])
        assert b"".join(x["ids"] for x in parts) == np.array(slow_ids(r["text"]), "<u4").tobytes()
        assert {x["doc_tokens"] for x in parts} == {len(slow_ids(r["text"]))}


def test_packing_odd_rows(odd_docs, no_docs):
    by_doc = check_pieces(odd_docs, 64)
    for r in odd_docs.collect():
        n = sum(1 for x in odd_docs.collect() if x["doc_id"] == r["doc_id"])
        assert r["doc_id"] is None or sum(x["length"] for x in by_doc[r["doc_id"]]) == n * len(slow_ids(r["text"]))
    assert check_pieces(no_docs) == {}


def test_copies_are_numbered(spark):
    df = spark.createDataFrame([(1, "same text")] * 3 + [(1, "other"), (None, "same text"), (None, "same text")], "doc_id bigint, text string").repartition(3)
    got = sorted(((r["doc_id"] or 0, r["doc_tokens"], r["copy"]) for r in packing.pack(df, BPE, 1, 64).filter("start = 0").collect()))
    assert [g[2] for g in got if g[0] == 0] == [0, 1] and sorted(g[2] for g in got if g[0] == 1) == [0, 0, 1, 2]


def test_hilbert_neighbours_are_adjacent():
    grid = np.array([(x, y) for x in range(8) for y in range(8)], float)
    keys = packing.hilbert_index((grid + 0.5) / 4 - 1, bits=3, span=1.0)
    walk = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(64)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_ids_beyond_16_bits(spark):
    """An end id that two bytes do not hold comes back whole."""
    df = spark.createDataFrame([(1, "some text", 5, 6), (2, None, 5, 6)], "doc_id bigint, text string, curve int, ids int")
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in packing.pack(df, BPE, 70_000, 64).filter("start = 0").collect()}
    assert got[2] == [70_000] and slow_ids("some text")[0] == got[1][0]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_rank_code_round_trip(n):
    ranks = np.random.default_rng(n).choice(np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], np.uint32), n)
    assert token_files.decode_ranks(*token_files.encode_ranks(ranks), n).tolist() == ranks.tolist()


def test_token_files(small, odd_docs, no_docs):
    for df in (small, odd_docs):
        got = token_files.round_trip(df, BPE).withColumn("crc", F.crc32("ids")).orderBy("start").collect()
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        at = 0
        assert len(got) == len(rows)
        for r, g in zip(rows, got, strict=True):
            ids = slow_ids(r["text"])
            assert (g["doc_id"], g["start"], g["n_tokens"]) == (r["doc_id"], at, len(ids))
            assert g["crc"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += len(ids)
    assert token_files.round_trip(no_docs, BPE).collect() == []
