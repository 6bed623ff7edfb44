"""Token files: frequency-ranked ids in a byte-aligned code with separate control bytes.

The most frequent id gets rank 0, and ranks are written in one to four bytes each.
Two control bits give a rank's length; the control bytes of a block stand together
before its data bytes, so that a block is decoded by table lookups on whole arrays.

A folder holds ``ranks`` (the id of every rank) and ``part-N`` files in ascending
doc_id order, each a chain of blocks:

    4 bytes  magic "RVB1"
    4 x u64  documents, ids, control bytes, data bytes
    i64[]    doc_id of each document
    u8[]     1 where doc_id is null
    u32[]    ids of each document
    u8[]     control bytes, four ranks in each, lowest bits first
    u8[]     data bytes, little-endian

Files are written under a task's own name and then moved into place, so a task that
runs again (a lost executor, speculation) leaves one whole file.

Defined results: a null or empty text is one end id; documents with the same doc_id
are ordered by text; a null doc_id comes first; repeated rows are written each; texts
of any length are encoded whole; an empty table gives no rows.  Only doc_id and text
are read, whatever other columns are called.
"""

from __future__ import annotations

import pickle
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import move_into_place, new_path, one_task_each, written
from graphloom.llm.tokens import WordEncoder, slices, with_end, worker_object

MAGIC = b"RVB1"
BLOCK_BYTES = 4_000_000  # of text

#: Lengths of the four ranks under each control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    r = np.ascontiguousarray(ranks, dtype="<u4")
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    two = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    two[: len(r)] = size - 1
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(size, dtype=np.int64) - size
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(doc_ids: list, sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    head = MAGIC + struct.pack("<4Q", len(doc_ids), len(ranks), len(control), len(data))
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join((head, ids.tobytes(), nulls.tobytes(), np.asarray(sizes, "<u4").tobytes(), control, data))


def read_blocks(stream):
    """doc_ids, sizes and ranks of each block of an open file."""
    while head := stream.read(36):
        if head[:4] != MAGIC:
            raise ValueError("not a block of a token file")
        docs, n, c, d = struct.unpack("<4Q", head[4:])
        ids = np.frombuffer(stream.read(8 * docs), "<i8")
        nulls = np.frombuffer(stream.read(docs), np.uint8)
        sizes = np.frombuffer(stream.read(4 * docs), "<u4")
        yield pa.array(ids, pa.int64(), mask=nulls.astype(bool)), sizes, decode_ranks(stream.read(c), stream.read(d), n)


def opened(path: str):
    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_stream(name, buffer_size=1 << 20)


def _frames(stream):
    """Frames of a draft: the documents, their sizes and their ids."""
    while head := stream.read(8):
        yield pickle.loads(zstandard.decompress(stream.read(struct.unpack("<Q", head)[0])))


def write_drafts(df: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Tokenizes every text once, in doc_id order, into a draft file for each partition.

    Returns (file, id, n): how often each id occurs in each file.
    """

    def write(batches):
        enc = worker_object(WordEncoder, tokenizer)
        store, top = fs.FileSystem.from_uri(folder)
        total, docs = np.zeros(max(enc.tok.get_vocab_size(), end_id + 1), np.int64), 0
        kind = "<u2" if len(total) <= 1 << 16 else "<u4"
        name, own = f"part-{TaskContext.get().partitionId():06d}", f"{top}/.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            for batch in batches:
                for a, b in slices(batch, "text", BLOCK_BYTES):
                    part = batch.slice(a, b - a)
                    ids, sizes = with_end(*enc.encode([x or b"" for x in part.column("text").to_pylist()]), end_id)
                    frame = zstandard.compress(pickle.dumps((part.column("doc_id").to_pylist(), sizes, ids.astype(kind))), 1)
                    out.write(struct.pack("<Q", len(frame)) + frame)
                    total += np.bincount(ids, minlength=len(total))
                    docs += len(sizes)
        if docs:
            move_into_place(store, own, f"{top}/draft-{name}")
        else:
            store.delete_file(own)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"file": [name] * len(at), "id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    ordered = df.selectExpr("doc_id", "cast(text as binary) as text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(write, "file string, id bigint, n bigint"), "token-counts")[0]


def rank_order(counts: DataFrame, tokenizer: str, end_id: int) -> np.ndarray:
    """Every id of the vocabulary, by falling frequency over all texts, then by id."""
    from tokenizers import Tokenizer

    seen = np.zeros(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1), np.int64)
    for r in counts.groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row for each id of the vocabulary
        seen[r["id"]] = r["n"]
    return np.argsort(-seen, kind="stable").astype("<u4")


def write_files(df: DataFrame, tokenizer: str, end_id: int, folder: str) -> list[tuple[str, int]]:
    """Encodes every text into the folder; returns its files and their numbers of ids, in order.

    Texts are tokenized once: the ranks need the frequencies of all of them, so the
    ids wait in compressed drafts, which the second step turns into the final files.
    """
    spark = df.sparkSession
    where, name = fs.FileSystem.from_uri(folder)
    where.create_dir(name)
    counts = write_drafts(df, tokenizer, end_id, folder)
    order = rank_order(counts, tokenizer, end_id)
    with where.open_output_stream(f"{name}/ranks") as out:
        out.write(order.tobytes())
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)
    files = sorted((r["file"], r["n"]) for r in counts.groupBy("file").agg(F.sum("n").alias("n")).collect())  # one row for each file

    def recode(batches):
        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                own = f"{top}/.{uuid.uuid4().hex}"
                with store.open_input_stream(f"{top}/draft-{name}", buffer_size=1 << 20) as draft, store.open_output_stream(own) as out:
                    for docs, sizes, ids in _frames(draft):
                        out.write(block(docs, sizes, shared.value[ids]))
                move_into_place(store, own, f"{top}/{name}")
                yield pa.RecordBatch.from_pydict({"file": [name]})

    if files:
        todo = one_task_each(spark.createDataFrame([(f,) for f, _ in files], "file string"), len(files), "file")
        todo.mapInArrow(recode, "file string").count()
        # Drafts go only when all files are there, so a task that runs again finds its own.
        for f, _ in files:
            where.delete_file(f"{name}/draft-{f}")
    return files


def read_files(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document in the folder."""
    rows, before = [], 0
    for name, n in files:
        rows.append((name, before))
        before += n

    def read(batches):
        with opened(f"{folder}/ranks") as s:
            order = np.frombuffer(s.read(), "<u4")
        for batch in batches:
            for name, at in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with opened(f"{folder}/{name}") as s:
                    for docs, sizes, ranks in read_blocks(s):
                        ids = order[ranks]
                        ends = np.cumsum(sizes, dtype=np.int64)
                        starts = ends - sizes
                        raw = [ids[p:q].tobytes() for p, q in zip(starts, ends, strict=True)]
                        yield pa.RecordBatch.from_pydict({"doc_id": docs, "start": pa.array(starts + at, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids": pa.array(raw, pa.binary())})
                        at += int(ends[-1]) if len(ends) else 0

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    if not rows:
        return spark.createDataFrame([], schema)
    todo = one_task_each(spark.createDataFrame(rows, "file string, before bigint"), len(rows), "file")
    return todo.mapInArrow(read, schema)


def round_trip(df: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes the token files of all texts and reads every document back from them."""
    spark = df.sparkSession
    folder = folder or new_path(spark, "token-files")
    return read_files(spark, folder, write_files(df, tokenizer, end_id, folder))


__all__ = ["block", "decode_ranks", "encode_ranks", "rank_order", "read_files", "round_trip", "write_files"]
