"""Tokenizing whole texts inside tasks with the public tokenizer libraries.

Both tokenizers treat white space as a boundary, so a text's ids are the ids of
its chunks, one after another, and a chunk that has been seen before need not be
encoded again.  Each Python worker keeps a bounded cache; when it is full it is
dropped and grows anew, which costs time and changes no result.
"""

from __future__ import annotations

import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CACHE_CHUNKS = 600_000
_TAIL = b".,!?;:"


def byte_letters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class _Chunks(dict):
    """Chunk of bytes -> number of its id sequence, made when first asked for."""

    def __init__(self, owner):
        self.owner = owner

    def __missing__(self, chunk: bytes) -> int:
        n = self.owner.add(chunk)
        self[chunk] = n
        return n


class WordEncoder:
    """Ids by a tokenizers file whose pre-tokens never span white space."""

    def __init__(self, path: str, cache: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.letters = byte_letters()
        self.cache = cache
        self._clear()

    def _clear(self) -> None:
        self.chunks, self.pool = _Chunks(self), array("I")
        self.start, self.size = array("q"), array("i")

    def _direct(self, chunk: bytes) -> list[int] | None:
        """Ids of a plain Latin word with an optional tail of stops, else None.

        Such a word is one pre-token and its tail another, so the merges can be
        asked for without the library's normalizer and pattern.
        """
        stem = chunk.rstrip(_TAIL)
        tail = chunk[len(stem) :]
        if stem.isalpha():  # ASCII letters
            word = stem.decode().lower()
        elif stem:
            word = stem.decode().lower()
            if not word.isalpha() or max(word) > "ɏ" or not unicodedata.is_normalized("NFC", word):
                return None
            word = "".join(self.letters[b] for b in word.encode())
        else:
            word = ""
        ids = [t.id for t in self.model.tokenize(word)] if word else []
        if tail:
            ids += [t.id for t in self.model.tokenize(tail.decode())]
        return ids

    def add(self, chunk: bytes) -> int:
        ids = self._direct(chunk)
        if ids is None:
            ids = self.tok.encode(chunk.decode(), add_special_tokens=False).ids
        self.start.append(len(self.pool))
        self.size.append(len(ids))
        self.pool.extend(ids)
        return len(self.start) - 1

    def codes(self, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The numbers of all chunks, in order, and how many chunks each text has."""
        if len(self.chunks) > self.cache:
            self._clear()
        get, codes, words = self.chunks.__getitem__, [np.zeros(0, np.int32)], []
        for t in texts:
            # Lower case is the tokenizer's own first step for ASCII; special strings
            # are matched before it, so texts that may hold one keep their case.
            chunks = (t if b"<|" in t else t.lower()).split()
            codes.append(np.fromiter(map(get, chunks), dtype=np.int32, count=len(chunks)))
            words.append(len(chunks))
        return np.concatenate(codes), words

    def expand(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks with these numbers, in order, and each chunk's number of ids."""
        if not len(code):
            return np.zeros(0, np.uint32), np.zeros(0, np.int32)
        sizes = np.frombuffer(self.size, dtype=np.int32)[code]
        starts = np.frombuffer(self.start, dtype=np.int64)[code]
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.arange(int(ends[-1]), dtype=np.int32) + np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
        return np.frombuffer(self.pool, dtype=np.uint32)[at], sizes

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, in order, and the number of each text's ids."""
        code, words = self.codes(texts)
        ids, sizes = self.expand(code)
        bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return ids, np.diff(bounds[np.cumsum([0, *words])])

    def count(self, texts: list[bytes], total: np.ndarray) -> None:
        """Adds the number of times each id occurs in the texts to total."""
        code, _ = self.codes(texts)
        times = np.bincount(code, minlength=1)
        seen = np.flatnonzero(times)
        if len(code):
            ids, sizes = self.expand(seen)
            total += np.bincount(ids, np.repeat(times[seen], sizes), len(total)).astype(np.int64)


_ENCODERS: dict[tuple, object] = {}


def worker_object(make, *key):
    """One object of a kind for each Python worker."""
    k = (make, *key)
    if k not in _ENCODERS:
        _ENCODERS[k] = make(*key)
    return _ENCODERS[k]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4_000_000):
    """Row ranges of a batch with texts of about most_bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most_bytes:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def id_width(path: str, end_id: int) -> int:
    """Bytes of an unsigned integer that holds any id of the vocabulary, and end_id."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return 2 if max(end_id, *tok.get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4


def token_ids(df: DataFrame, path: str, end_id: int, extra=None, extra_schema: str = "", width: int = 4) -> DataFrame:
    """doc_id, n_tokens, ids: the ids of every text with end_id after them.

    df has doc_id and text; a null text is an empty one.  ids holds little-endian
    unsigned integers of ``width`` bytes (2 halves what is shuffled, and fits
    vocabularies of up to 65,536 ids).  ``extra(ids, sizes)`` may return further
    columns by the names in extra_schema.
    """
    kind = np.dtype(f"<u{width}")

    def run(batches):
        enc = worker_object(WordEncoder, path)
        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                texts = [x or b"" for x in part.column("text").to_pylist()]
                flat, sizes = enc.encode(texts)
                ids, sizes = with_end(flat, sizes, end_id)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                flat = ids.astype(kind)
                data = [flat[p:q].tobytes() for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
                cols = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64()), "ids": pa.array(data, pa.binary())}
                if extra is not None:
                    cols |= extra(ids, sizes)
                yield pa.RecordBatch.from_pydict(cols)

    rows = df.selectExpr("doc_id", "cast(text as binary) as text")
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary" + (", " + extra_schema if extra_schema else ""))


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same sequences with end_id after each."""
    sizes = np.asarray(sizes, dtype=np.int64)
    out = np.empty(len(ids) + len(sizes), dtype=np.uint32)
    ends = np.cumsum(sizes + 1) - 1
    mask = np.ones(len(out), dtype=bool)
    mask[ends] = False
    out[mask] = ids
    out[ends] = end_id
    return out, sizes + 1
