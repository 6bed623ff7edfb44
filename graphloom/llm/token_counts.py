"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths (in tokens) of frequent pre-tokens,
broadcast once; tier two is a cache in every Python worker, filled by encoding
what the table lacks.  Pre-tokens are never shuffled: the table is fitted to a bounded
sample of about ``SAMPLE`` rows, of which a few tasks pass on bounded summaries.  It
affects speed only; every text is counted whole.

Defined results: a null or empty text has no bytes and no tokens; repeated rows
and texts of any length are counted each as they stand; a null id is returned as such;
an empty table gives no rows; only the id and the text column are read, so other
columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tokens import CACHE_CHUNKS, slices, worker_object

#: Entries of the broadcast table, and of each summary that leads to it.
TABLE_ENTRIES = 32_768
SUMMARY_ENTRIES = 8_192
SAMPLE = 20_000  # rows
WAYS = 8  # tasks that sum up the sample
#: Longer pre-tokens (lines without spaces, encoded data) hardly repeat and are not kept, which bounds the cache in bytes.
MOST_KEY = 64

#: The library reads its own space mark in a text as a space.
SPACE_MARK = "▁".encode()

_SPACED = re.compile(rb"\n[^ \n]*| +[^ \n]*")


class PieceLengths(dict):
    """Pre-token -> its number of sentencepiece tokens.

    A pre-token is a run of spaces (or space marks) with what follows up to the next space or line
    end, or a line end with what follows it.  Keys lack the first space.  Pieces of
    the vocabulary hold the space mark only at their start and never a line end
    (checked on loading), so no merge crosses a pre-token's bounds.
    """

    def __init__(self, path: str, cache: int = CACHE_CHUNKS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache = cache
        self.frequent: dict[bytes, int] = {}
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or self.sp.encode("a\nb", out_type=str)[0] != "▁a":
            raise ValueError("pieces of this vocabulary span white space; texts can't be counted by pre-tokens")
        self.line_start = len(self.sp.encode("\n")) - 1

    def use(self, frequent: dict[bytes, int]) -> None:
        self.frequent = frequent
        self.update(frequent)

    def __missing__(self, chunk: bytes) -> int:
        if chunk[:1] == b"\n":  # encoded alone it would get the mark of a first word
            n = len(self.sp.encode(chunk.decode())) - 1
        else:
            n = len(self.sp.encode(chunk.decode())) if chunk else 1
        if len(chunk) <= MOST_KEY:
            self[chunk] = n
        return n

    def bounded(self) -> None:
        if len(self) > self.cache + len(self.frequent):
            self.clear()
            self.update(self.frequent)


def pretokens(text: bytes) -> list[bytes]:
    if not text:
        return []
    text = text.replace(SPACE_MARK, b" ")
    t = text.replace(b"\n", b" \n")
    if b"  " in t or t[:1] == b" " or t[-1:] == b" ":
        return [x[1:] if x[:1] == b" " else x for x in _SPACED.findall(b" " + text)]
    return t.split(b" ")


def _rows(part, n):
    return [x or b"" for x in part.column("text").to_pylist()]


def frequent_lengths(df: DataFrame, path: str, entries: int = TABLE_ENTRIES, summary: int = SUMMARY_ENTRIES, sample: int = SAMPLE, ways: int = WAYS) -> tuple[list[bytes], list[int]]:
    """The most frequent pre-tokens of a sample of rows, and their lengths in tokens.

    A hash of the id picks about ``sample`` rows; ``ways`` tasks each pass on their
    ``summary`` most frequent pre-tokens, so the driver gets ``ways * summary`` at most.
    """
    share = min(1.0, sample / max(df.count(), 1))
    picked = df.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for a, b in slices(batch, "text"):
                for t in _rows(batch.slice(a, b - a), b - a):
                    counts.update(pretokens(t))
                if len(counts) > 500_000:  # keeps the worker's memory bounded
                    counts = Counter(dict(counts.most_common(100_000)))
        best = counts.most_common(summary)
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in best], pa.binary()), "n": pa.array([c for _, c in best], pa.int64())})

    counts: Counter = Counter()
    for r in picked.repartition(ways).mapInArrow(count, "word binary, n bigint").toLocalIterator():
        counts[bytes(r["word"])] += r["n"]
    words = [w for w, _ in counts.most_common(entries)]
    lengths = PieceLengths(path)
    return words, [lengths[w] for w in words]


def token_counts(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", entries: int = TABLE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of df.

    path is a sentencepiece model file; begin and end marks do not count.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    words, sizes = frequent_lengths(rows, path, entries)
    # One block of bytes and one array of small numbers; a word with a space or a
    # line end keeps it, so words are set apart by a byte that UTF-8 never holds.
    shared = df.sparkSession.sparkContext.broadcast((b"\xff".join(words), sizes))

    def run(batches):
        lengths = worker_object(PieceLengths, path)
        block, n = shared.value
        lengths.use(dict(zip(block.split(b"\xff"), n, strict=True)) if n else {})
        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                texts = _rows(part, b - a)
                n_tokens = [sum(map(lengths.__getitem__, pretokens(t))) for t in texts]
                lengths.bounded()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                        "n_tokens": pa.array(n_tokens, pa.int64()),
                        "over_limit": pa.array([n > limit for n in n_tokens], pa.bool_()),
                    }
                )

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
