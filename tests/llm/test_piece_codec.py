import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import piece_codec
from graphloom.llm.common import tokenizer_path

PIECES = tokenizer_path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)
ENCODER, DECODER = piece_codec.PieceEncoder(PIECES), piece_codec.PieceDecoder(PIECES)


def same(text):
    ids, bounds = ENCODER.encode([text.encode()])
    assert ids.tolist() == SP.encode(text), repr(text)
    assert bounds.tolist() == [0, len(ids)]
    assert DECODER.decode(ids) == SP.decode(ids.tolist()), repr(text)


def odd_texts(n=1500):
    rng = random.Random(12)
    atoms = [*"aB ,.'!\n\t\r é世—1<|#▁\x00", "<|endoftext|>", "<s>", "<unk>", "<0x0A>", "  ", "İ", "ẞ", "word", "　", "        ", "tion", "http", "://", "���", "\U0001f600"]
    return ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_equals_library_on_odd_texts():
    for t in odd_texts():
        same(t)


def test_equals_library_on_runs_of_few_letters():
    """Few letters make many ways to merge, so pairs are refused and the walk steps back."""
    rng = random.Random(5)
    for letters in ("ab", "aes", "niot", "=-", "hater", "lL0"):
        for _ in range(400):
            same("".join(rng.choice(letters) for _ in range(rng.randint(1, 60))))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_library_on_any_text(text):
    same(text)


def test_compatible_means_merged_from_characters():
    m, rng = ENCODER.merges, random.Random(3)
    pieces = [p for p in m.history if len(p) < 7]
    for _ in range(20_000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        assert m.compatible(a, b) == (m.merged(a + b)[0] == [a, b]), (a, b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 260), max_size=12))
def test_decodes_any_ids(ids):
    assert DECODER.decode(np.array(ids, np.int32)) == SP.decode(ids)


def test_pool_is_dropped_and_long_words_go_in_stretches(monkeypatch):
    monkeypatch.setattr(piece_codec, "STRETCH", 7)
    small = piece_codec.PieceEncoder(PIECES, pool_bytes=50)
    for t in odd_texts(200) + ["ab" * 500 + "tion" * 90]:
        assert small.encode([t.encode()])[0].tolist() == SP.encode(t), repr(t)


@pytest.mark.parametrize("frame", ["small", "odd_docs", "no_docs"])
def test_rows(request, frame):
    df = request.getfixturevalue(frame)
    got = piece_codec.coded(df, PIECES).collect()
    want = [(r["doc_id"], ids := SP.encode(r["text"] or ""), SP.decode(ids)) for r in df.collect()]
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=repr) == sorted(want, key=repr)
