"""Packing documents into sequences along a space-filling curve.

A document's token ids are hashed into a short count vector, which is projected to
a few dimensions; the Hilbert index of that point is its sort key.  The documents
are range-sorted by the key, and each range partition is cut into sequences in
curve order, so that a sequence holds neighbours.  Only a partition's rest can be
shorter than a sequence; it is cut at powers of two, which need no padding.

Defined results: a null or empty text is one end id; equal keys are ordered by
doc_id, and repeated rows are packed each for itself, under a copy number; a null
doc_id comes first; a document longer than a sequence, of any length, spans several; an
empty table gives no pieces.  Only doc_id and text are read, whatever other columns are
called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import shuffle_partitions, written
from graphloom.llm.tokens import id_width, token_ids

HASHED, DIMS, BITS = 64, 4, 12
RANGE_BYTES = 64 << 20  # of ids in a task


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of integers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def projected(ids: np.ndarray, sizes: np.ndarray, dims: int = DIMS, hashed: int = HASHED) -> np.ndarray:
    """A point for each document: hashed counts, of length 1, under random signs."""
    n = len(sizes)
    doc = np.repeat(np.arange(n, dtype=np.int64), sizes)
    slot = (_mix(ids) & np.uint64(hashed - 1)).astype(np.int64)
    counts = np.sqrt(np.bincount(doc * hashed + slot, minlength=n * hashed).reshape(n, hashed))
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
    signs = np.where(_mix(np.arange(hashed * dims) + 1) & np.uint64(1), 1.0, -1.0).reshape(hashed, dims)
    return counts @ signs


def hilbert_index(points: np.ndarray, bits: int = BITS, span: float = 4.0) -> np.ndarray:
    """Index of each point along the Hilbert curve through [-span, span]^dims."""
    n, dims = points.shape
    top = (1 << bits) - 1
    x = [np.clip((points[:, d] + span) / (2 * span) * (top + 1), 0, top).astype(np.uint64) for d in range(dims)]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the turns, coarse to fine
        q, p = one << np.uint64(b), (one << np.uint64(b)) - one
        for d in range(dims):
            turned = (x[d] & q) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[d]) & p)
            x[0] = x[0] ^ np.where(turned, p, np.uint64(0)) ^ swap
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, dims):
        x[d] = x[d] ^ x[d - 1]
    fix = np.zeros(n, np.uint64)
    for b in range(bits - 1, 0, -1):
        fix ^= np.where((x[-1] >> np.uint64(b)) & one, (one << np.uint64(b)) - one, np.uint64(0))
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << one) | (((x[d] ^ fix) >> np.uint64(b)) & one)
    return key.astype(np.int64)


def tail_cuts(n: int) -> list[int]:
    """Powers of two, largest first, that sum to n."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(df: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """Pieces of documents with their places in sequences of at most ``length`` ids.

    doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, copy (from 0 on, among rows equal in doc_id and ids).
    """

    def key(ids, sizes):
        return {"curve": pa.array(hilbert_index(projected(ids, sizes)), pa.int64())}

    width = id_width(tokenizer, end_id)
    ids, _ = written(token_ids(df.select("doc_id", "text"), tokenizer, end_id, key, "curve bigint", width=width), "packing-ids")
    total = ids.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = max(shuffle_partitions(df.sparkSession), width * total // RANGE_BYTES)
    ordered = ids.repartitionByRange(ranges, "curve", "doc_id").sortWithinPartitions("curve", "doc_id", "n_tokens", "ids")

    def cut(batches):
        sequence, filled = TaskContext.get().partitionId() << 32, 0
        rest: list[tuple] = []  # pieces of the sequence that is not yet full
        last, copy = None, 0  # equal rows follow each other
        for batch in batches:
            out: list[tuple] = []
            for doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids")), strict=True):
                last, copy = (doc, raw), copy + 1 if last == (doc, raw) else 0
                data, at = np.frombuffer(raw, f"<u{width}").astype("<u4"), 0
                while at < n:
                    take = min(n - at, length - filled)
                    rest.append((doc, at, take, data[at : at + take].tobytes(), n, sequence, filled, copy))
                    at, filled = at + take, filled + take
                    if filled == length:
                        out += rest
                        rest, filled, sequence = [], 0, sequence + 1
            if out:
                yield rows(out)
        if rest:
            yield rows(recut(rest, filled, sequence))

    def recut(rest, filled, sequence):
        out, cuts, room = [], tail_cuts(filled), 0
        for doc, at, take, raw, n, _, _, copy in rest:
            done = 0
            while done < take:
                if not room:
                    room = size = cuts.pop(0)
                    sequence += 1
                part = min(take - done, room)
                out.append((doc, at + done, part, raw[4 * done : 4 * (done + part)], n, sequence - 1, size - room, copy))
                done, room = done + part, room - part
        return out

    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "copy")

    def rows(out):
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, cols, strict=True)], names=list(names))

    return ordered.mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, copy bigint")
