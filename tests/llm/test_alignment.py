import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import DataFrameWriter
from tokenizers import Tokenizer

from graphloom.llm import alignment
from graphloom.llm.common import tokenizer_path
from graphloom.sources.shared import SWEEP, exists

BYTES, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TOK = Tokenizer.from_file(BYTES)
TOK.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)
UNLETTER = {c: b for b, c in enumerate(alignment.byte_letters())}


def both(text):
    """(ids, end bytes) of both sides by the libraries over the whole text, or None."""
    if not text:
        return None
    whole, out = (" " + text).encode(), []
    a, b = TOK.encode(" " + text, add_special_tokens=False).ids, SP.encode(text)
    as_bytes = lambda i: bytes([int(SP.id_to_piece(i)[3:-1], 16)]) if SP.is_byte(i) else SP.id_to_piece(i).replace("▁", " ").encode()
    for ids, parts in ((a, [bytes(UNLETTER[c] for c in TOK.id_to_token(i)) for i in a]), (b, [as_bytes(i) for i in b])):
        if b"".join(parts) != whole:
            return None
        ends, at = [], 0
        for p in parts:
            at += len(p)
            ends.append(at)
        out.append((ids, ends))
    return out


def plain(docs):
    """The query's rows by nested loops."""
    seen, held = [], Counter()
    for doc_id, text in docs:
        sides = both(text)
        if sides is None:
            seen.append((doc_id, None, None))
            continue
        (a, ea), (b, eb) = sides
        cuts = sorted(set(ea) & set(eb))
        group = lambda ids, ends, low, high: ",".join(str(i) for i, e in zip(ids, ends, strict=True) if low < e <= high)
        if len(a) < 3000:
            text_groups = ";".join(group(a, ea, low, high) + "|" + group(b, eb, low, high) for low, high in zip([0, *cuts], cuts, strict=False))
        else:
            ga, gb, low = {}, {}, set(cuts)
            for out, ids, ends in ((ga, a, ea), (gb, b, eb)):
                k = 0
                for i, e in zip(ids, ends, strict=True):
                    out.setdefault(k, []).append(str(i))
                    k += e in low
            text_groups = ";".join(",".join(ga[k]) + "|" + ",".join(gb[k]) for k in range(len(cuts)))
        links, j = [], 0
        for i, e in enumerate(ea):
            s = ea[i - 1] if i else 0
            while eb[j] <= s:
                j += 1
            k = j
            while k < len(eb) and (eb[k - 1] if k else 0) < e:
                links.append((a[i], b[k]))
                k += 1
        held.update(set(links))
        seen.append((doc_id, (len(a), len(b), len(cuts), links), text_groups))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for doc_id, got, groups in seen:
        if got is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            links = got[3]
            out.append((doc_id, *got[:3], len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=repr)


def query(df):
    rows = alignment.cross_alignment(df, BYTES, PIECES).collect()
    return sorted(((*r[:7], hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in rows), key=repr)


def test_equals_plain_search(small):
    docs = [tuple(r) for r in small.select("doc_id", "text").collect()]
    assert query(small) == plain(docs)


def test_odd_rows(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert query(odd_docs) == plain(docs)
    assert query(no_docs) == []


def odd_texts(n=600):
    rng = random.Random(11)
    atoms = [*"aB ,.'!\n\t\r é世—1<|#▁\x00\x1c", "<|endoftext|>", "<s>", "  ", "'s", "'LL", "İ", "ẞ", "Å", "word", " ", " ", "　", " ", "\n\n", "don't", "naïve", "Straße", "12", "<0x0A>"]
    return ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_fragments_have_the_tokens_of_the_whole_text():
    own = alignment.FragmentTokens(BYTES, PIECES)
    for t in odd_texts():
        own.start()
        own.add(alignment.cut(t.encode()))
        want = both(t)
        assert (want is None) == any(own.bad), repr(t)
        if want is not None:
            assert [list(x) for x in own.ids] == [want[0][0], want[1][0]], repr(t)


def test_equal_fragments_meet_once(spark, monkeypatch):
    """However many units hold a fragment, one row keeps its bytes; fragments of one hash stay apart."""
    rows = [(u, f, w) for u in range(40) for f, w in enumerate([b"the", b"of", b"", b"x%d" % (u % 3)])]
    df = spark.createDataFrame(rows, "unit bigint, f int, fragment binary")
    for same_hash in (False, True):
        if same_hash:
            monkeypatch.setattr(alignment.F, "xxhash64", lambda c: alignment.F.lit(7).cast("bigint"))
        got = alignment.met(df, 4).collect()
        assert len(got) == len(rows)
        kept = {(r["h"], r["t"]): bytes(r["fragment"]) for r in got if r["fragment"] is not None}
        assert sorted(kept.values()) == [b"", b"of", b"the", b"x0", b"x1", b"x2"]
        assert sum(r["fragment"] is not None for r in got) == len(kept)
        assert sorted((r["unit"], r["f"], kept[r["h"], r["t"]]) for r in got) == sorted(rows)


@pytest.mark.parametrize("hot", [1, 50])
def test_small_units_and_few_hot_pairs(spark, monkeypatch, hot):
    """Units of a batch each and any share of broadcast pairs give the same rows."""
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    monkeypatch.setattr(alignment, "BATCH_FRAGMENTS", 3 * hot)
    monkeypatch.setattr(alignment, "JOINED", hot)
    docs = [(i, t) for i, t in enumerate(odd_texts(80))] + [(i, "the same words, again and again") for i in range(30)]
    assert query(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)) == plain(docs)


def test_disk_is_given_back(spark, small, monkeypatch):
    """Shuffle files go with each step, and no table holds whole documents' groups; the result can be read twice."""
    swept, kept = [], []
    save, write = alignment._Bucketed.__init__, alignment.written

    def seen(self, df, n, by):
        save(self, df, n, by)
        kept.append(self)

    def writes(df, name, *by):
        assert not {"doc_id", "groups"} <= set(df.columns)
        return write(df, name, *by)

    monkeypatch.setattr(alignment._Bucketed, "__init__", seen)
    monkeypatch.setattr(alignment, "written", writes)
    own = DataFrameWriter.saveAsTable
    monkeypatch.setattr(DataFrameWriter, "saveAsTable", lambda self, *a, **b: (swept.append(spark.conf.get(SWEEP, "false")), own(self, *a, **b))[1])
    out = alignment.cross_alignment(small, BYTES, PIECES)
    assert len(swept) == len(kept) == 5 and set(swept) == {"true"}
    assert [exists(spark, t.path) for t in kept] == [True, False, False, False, False]
    assert sorted(out.collect()) == sorted(out.collect())
