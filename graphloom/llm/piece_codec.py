"""Exact sentencepiece encoding and decoding for merge-type (BPE) models.

A text's ids are those of its pre-tokens, which no piece spans.  A pre-token is encoded by
backtracking: an Aho-Corasick automaton over the pieces gives the pieces that start at
each character, longest first; a piece may follow another only if merging the text of the
two from characters anew gives back just these two; where no piece fits, the walk
steps back and the position is marked as failed in a bitfield, so that it is never
tried twice.  A sequence in which every neighbouring pair is compatible is the one that
the merges give: the first merge across a border would happen in that pair alone too.

Characters outside the vocabulary become byte pieces.  Pieces that merging does not give
for their own text are left out of the automaton.  Each Python worker keeps the ids of
pre-tokens in a pool bounded in bytes; when it is full it is dropped and grows anew.

Defined results: a null or empty text has no ids and decodes to an empty text; a literal
space mark is read as a space, as the library does, so decoding gives the space; invalid
byte sequences decode to one replacement character a byte; repeated rows and texts of
any length are handled each as they stand; a null id is returned as such; an empty table
gives no rows; only the id and the text column are read, so other columns may have any
name.
"""

from __future__ import annotations

import codecs
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.token_counts import pretokens
from graphloom.llm.tokens import slices, worker_object

MARK = "▁"
#: Bytes of pre-tokens and ids that a worker's pool holds before it is dropped, and pairs in its table of checks.
POOL_BYTES, CHECKED_PAIRS = 64_000_000, 1_000_000
#: Pre-tokens above this many characters are matched in stretches of this length.
STRETCH = 65_536


class Merges:
    """The pieces of a model, and merging from single characters."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_id, self.plain, self.control = [-1] * 256, {}, set()
        self.unknown = sp.unk_id()
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:-1], 16)] = i
            elif sp.is_control(i):
                self.control.add(i)
            elif not sp.is_unknown(i):
                self.plain[p] = i
        if min(self.byte_id) < 0:
            raise ValueError("the model has no pieces for bytes")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.plain) or sp.encode("a\nb", out_type=str)[0] != MARK + "a":
            raise ValueError("pieces of this vocabulary span white space")
        if any(sp.is_unused(i) for i in self.plain.values()):
            raise ValueError("pieces that are in the model but not in use")
        #: Merges happen by descending score, leftmost first.
        self.score = {p: sp.get_score(i) for p, i in self.plain.items()}
        self.longest = max(map(len, self.plain))
        if any(c not in self.plain for p in self.plain for c in p):
            raise ValueError("pieces with characters that are no pieces themselves")
        #: For each piece that merging gives: (score, symbol at the left edge, at the right edge) before its first merge and after each.
        self.history: dict[str, list[tuple[float, str, str]]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.plain:
            symbols, steps = self.merged(p)
            if symbols == [p]:
                self.history[p] = steps
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The symbols that merging leaves of a short text, and its steps."""
        symbols, steps = list(text), [(0.0, text[0], text[-1])]
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = self.score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            steps.append((best, symbols[0], symbols[-1]))
        return symbols, steps

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging left + right gives just these two pieces.

        The merges of both, each known from its own text, are done again in the order
        of their scores; they go through unless one across the border comes first.
        """
        a, b, score = self.history[left], self.history[right], self.score
        i = j = 0
        last_a, last_b = len(a) - 1, len(b) - 1
        while True:
            across = score.get(a[i][2] + b[j][1])
            next_a = a[i + 1][0] if i < last_a else None
            next_b = b[j + 1][0] if j < last_b else None
            if across is not None and (next_a is None or across > next_a) and (next_b is None or across >= next_b):
                return False
            if next_a is not None and (next_b is None or next_a >= next_b):
                i += 1
            elif next_b is not None:
                j += 1
            else:
                return True


class _Starts:
    """Pieces that start at a character of a text, longest first; long texts in stretches, of which the last few are kept."""

    def __init__(self, merges: Merges, text: str):
        self.merges, self.text = merges, text
        self.held: dict[int, list[list[str]]] = {}

    def __call__(self, at: int) -> list[str]:
        k = at // STRETCH
        found = self.held.get(k)
        if found is None:
            first = k * STRETCH
            size = min(STRETCH, len(self.text) - first)
            found = [[] for _ in range(size)]
            for end, piece in self.merges.automaton.iter(self.text[first : first + STRETCH + self.merges.longest]):
                start = end + 1 - len(piece)
                if start < size:
                    found[start].append(piece)  # shorter ones end, and come, first
            self.held = {x: y for x, y in self.held.items() if abs(x - k) == 1}
            self.held[k] = found
        return found[at - k * STRETCH]


class PieceEncoder(dict):
    """Pre-token -> number of its ids in the pool."""

    def __init__(self, path: str, pool_bytes: int = POOL_BYTES):
        self.merges = Merges(path)
        self.pool_bytes = pool_bytes
        self.checked: dict[tuple[str, str], bool] = {}
        self.drop()

    def drop(self) -> None:
        self.clear()
        self.pool, self.start, self.size = array("i"), array("q"), array("i")
        self.n_bytes = 0

    def _fits(self, left: str, right: str) -> bool:
        fits = self.checked.get((left, right))
        if fits is None:
            if len(self.checked) >= CHECKED_PAIRS:
                self.checked.clear()
            fits = self.checked[left, right] = self.merges.compatible(left, right)
        return fits

    def split(self, text: str) -> list[str]:
        """The pieces of a text of known characters."""
        if text in self.merges.history:
            return [text]
        starts, n = _Starts(self.merges, text), len(text)
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        left: list[int] = []  # how many shorter pieces are untried at the start of each piece in out
        at, choice = 0, len(starts(0))
        while at < n:
            pieces = starts(at)
            while choice:
                choice -= 1
                piece = pieces[choice]
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or self._fits(out[-1], piece)):
                    out.append(piece)
                    left.append(choice)
                    at = end
                    choice = len(starts(at)) if at < n else 0
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError(f"no pieces for {text[:50]!r}")
                at -= len(out.pop())
                choice = left.pop()
        return out

    def ids(self, text: str) -> list[int]:
        m, out, first = self.merges, [], 0
        for k, c in enumerate(text):
            if c not in m.plain:
                if first < k:
                    out += [m.plain[p] for p in self.split(text[first:k])]
                out += [m.byte_id[b] for b in c.encode()]
                first = k + 1
        return out + [m.plain[p] for p in self.split(text[first:])] if first < len(text) else out

    def __missing__(self, chunk: bytes) -> int:
        text = chunk.decode()
        ids = self.ids(text if text[:1] == "\n" else MARK + text.replace(" ", MARK))
        self.start.append(len(self.pool))
        self.size.append(len(ids))
        self.pool.extend(ids)
        self.n_bytes += len(chunk) + 4 * len(ids)
        self[chunk] = len(self.start) - 1
        return self[chunk]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, in order, and the bounds of each text's ids."""
        if self.n_bytes > self.pool_bytes:
            self.drop()
        codes, words = [np.zeros(0, np.int64)], [0]
        for t in texts:
            chunks = pretokens(t)
            codes.append(np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks)))
            words.append(len(chunks))
        code = np.concatenate(codes)
        if not len(code):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        sizes = np.frombuffer(self.size, np.int32)[code]
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.arange(ends[-1]) + np.repeat(np.frombuffer(self.start, np.int64)[code] - (ends - sizes), sizes)
        return np.frombuffer(self.pool, np.int32)[at], np.concatenate([[0], ends])[np.cumsum(words)]


def _one_each(error: UnicodeDecodeError):
    return "�", error.start + 1


codecs.register_error("graphloom-one-each", _one_each)


class PieceDecoder:
    """Ids to texts, by tables of the bytes of each piece."""

    def __init__(self, path: str):
        m = self.merges = Merges(path)
        byte_of = {i: b for b, i in enumerate(m.byte_id)}
        texts = [b"" if i in m.control else " ⁇ ".encode() if i == m.unknown else bytes([byte_of[i]]) if i in byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(m.pieces)]
        self.marked = np.array([p.startswith(MARK) and i not in byte_of for i, p in enumerate(m.pieces)])
        self.size = np.array([len(t) for t in texts])
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.block = np.frombuffer(b"".join(texts), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.first[ids] - (ends - sizes), sizes)
        return self.block[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text; the space that encoding puts before the first word goes."""
        marks = np.flatnonzero(self.size[ids] == 0)
        if len(marks):  # marks of begin and end have no text, and bytes don't meet across them
            return self._text(np.split(ids, marks))
        return self._text([ids])

    def _text(self, runs: list[np.ndarray]) -> str:
        out, first = [], True
        for ids in runs:
            raw = self.bytes_of(ids)
            if first and raw:
                first = False
                raw = raw[1:] if self.marked[ids[self.size[ids] > 0][0]] else raw
            out.append(raw.decode(errors="graphloom-one-each"))
        return "".join(out)


def coded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded for every row of df: the ids of its text, and the text of these ids.

    path is a sentencepiece model file of the merge type; begin and end marks are left out.
    """

    def run(batches):
        encoder, decoder = worker_object(PieceEncoder, path), worker_object(PieceDecoder, path)
        for batch in batches:
            for p, q in slices(batch, "text"):
                part = batch.slice(p, q - p)
                ids, bounds = encoder.encode([x or b"" for x in part.column("text").to_pylist()])
                texts = [decoder.decode(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")
