"""Removal of repeated byte strings, exact for a given length, across documents.

A byte goes if a string of ``length`` bytes that covers it also starts in a document
with a smaller id.  All such strings are found by refining buckets:

1. Every window of ``length`` bytes is represented by its least q-gram (by a hash; the
   leftmost of equals), so equal windows have equal representatives.  Runs of windows
   with the same representative are the members of its q-gram bucket.  Only the hashes
   are shuffled; each bucket that more than one document enters answers with one bit
   for every member.
2. The text of the remaining runs goes to their bucket's task, but of equal runs of a
   group of documents only those of the least one: the others are covered whole.  With
   many groups, equal runs meet once more in between, dealt by bucket and group, so a
   passage that a third of all documents share reaches its bucket few times.
3. There, bucket pointers are refined: positions start in buckets by their first 8
   bytes, and each round sorts the still shared buckets by the pointers at a later
   offset (8, 16, then what is lacking), which doubles the depth.  The pointers that a
   round has updated are those that the next one reads.
4. The covered spans return to their documents, which are cut.

Texts move once, dealt by a hash of the id into groups of bounded size, and every step
reads that same exchange.  Exact copies are set aside first by their digests: they are
removed whole, and their windows are represented by the first of them.

Defined results: a null text is empty; a text shorter than ``length`` is kept whole;
rows with the same doc_id never remove from each other;
a text of any length is handled in pieces; a null doc_id is kept whole and
removes from none; the kept bytes need not be valid UTF-8 (``kept_text`` drops broken
characters); an empty table gives no rows.  Only doc_id and text are read, whatever
other columns are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import shuffle_partitions, spread_join, written

LENGTH = 50
GRAM = 24
#: Bytes of text in a group of documents, and starts of windows handled at a time.
GROUP_BYTES = 8 << 20
PIECE = 1 << 20
#: Window starts of a run that travels as one, and groups whose runs meet before their bucket.
RUN = 4_096
MEET = 4_096

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each offset on, first byte highest, as one integer."""
    n = len(data) - 7
    out = np.empty(max(n, 0), np.uint64)
    raw = data.tobytes()
    for o in range(min(8, max(n, 0))):
        part = np.frombuffer(raw, ">u8", (len(raw) - o) // 8, o)
        out[o::8] = part[: len(out[o::8])]
    return out


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a multiple of 8) from each offset on."""
    v = eights(data)
    n = len(data) - gram + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(0, gram, 8):
        h = (h ^ v[k : k + len(h)]) * _ODD[k // 8 % 3]
        h ^= h >> np.uint64(29)
    h *= _ODD[0]
    return h ^ (h >> np.uint64(32))


def representatives(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes, the position of its least one, leftmost of equals."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    rows = -(-len(h) // width)
    low = np.uint64(63)
    key = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    key[: len(h)] = h
    key = (key & ~low) | (np.arange(rows * width, dtype=np.uint64) % np.uint64(width))
    key = key.reshape(rows, width)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    s = np.arange(n)
    left, right = behind[:n], ahead[width - 1 : width - 1 + n]
    later = (right & ~low) < (left & ~low)
    at_left = s // width * width + (left & low).astype(np.int64)
    at_right = (s + width - 1) // width * width + (right & low).astype(np.int64)
    return np.where(later, at_right, at_left)


def runs(text: bytes, length: int, gram: int):
    """(first window start, last window start, hash) of each run of windows with one representative."""
    width = length - gram + 1
    firsts, lasts, hashes = [], [], []
    for a in range(0, len(text) - length + 1, PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE + length - 1, len(text) - a), a)
        h = gram_hashes(data, gram)
        rep = representatives(h, width)
        first = np.flatnonzero(np.diff(rep, prepend=-1))
        firsts.append(first + a)
        lasts.append(np.append(first[1:], len(rep)) - 1 + a)
        hashes.append(h[rep[first]])
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    first, last, h = np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes)
    # Neighbours with one hash are one run: in a row of equal signs every window has a
    # representative of its own.  Long ones are dealt out in equal steps.
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    first, last, h = first[head], last[np.append(head[1:], len(h)) - 1], h[head]
    steps = (last - first) // RUN + 1
    if steps.max() > 1:
        k = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
        first, last, h = np.repeat(first, steps) + k * RUN, np.repeat(last, steps), np.repeat(h, steps)
        last = np.minimum(last, first + RUN - 1)
    return first, last, h


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; each is stored by byte planes, which compress better."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())
    return zstandard.compress(b"".join(out), 1)


def unpacked(block: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(block), 0, []
    for kind, n in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return out


def refined(data: np.ndarray, start: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each window start of the strings in data, the least owner of an equal window.

    start holds the bounds of the strings (one more than there are), owner their ids.
    Positions that are no window starts get the largest integer.
    """
    n = len(data)
    sizes = np.diff(start)
    # Owners by rank: half the memory, and their order is all that counts.
    names, rank = np.unique(owner, return_inverse=True)
    own = np.repeat(rank.astype(np.int32), sizes)
    room = (np.repeat(start[1:], sizes) - np.arange(n)).astype(np.int32)  # bytes left in the string
    least = np.full(n, np.iinfo(np.int64).max)
    # Pointers of the initial buckets, 8 bytes deep.
    _, pointer = np.unique(eights(np.concatenate([data, np.zeros(8, np.uint8)]))[:n], return_inverse=True)
    pointer = pointer.astype(np.int32)
    active, depth = np.flatnonzero(room >= 8), 8

    def shared(at: np.ndarray) -> np.ndarray:
        """Of the positions, those whose bucket holds more than one owner."""
        order = at[np.lexsort((own[at], pointer[at]))]
        p, o = pointer[order], own[order]
        head = np.flatnonzero(np.diff(p, prepend=-1))
        size = np.diff(np.append(head, len(order)))
        mixed = o[head] != o[head + size - 1]
        return order[np.repeat(mixed, size)]

    while len(active):
        active = shared(active)
        if depth == length:
            break
        step = min(depth, length - depth)
        active = active[room[active] >= depth + step]
        if not len(active):
            break
        # Sort each bucket by the pointer ``step`` bytes on; equal pairs are one bucket.
        a, b = pointer[active], pointer[active + step]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.cumsum((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
        # New numbers lie above all old ones, so settled positions stay distinct from them.
        pointer[active[order]] = int(pointer.max()) + 1 + new
        depth += step
    least[room >= length] = names[own[room >= length]]
    if len(active):
        # Grouped by bucket with owners ascending: the head has the least owner.
        p = pointer[active]
        head = np.flatnonzero(np.diff(p, prepend=-1))
        least[active] = names[np.repeat(own[active[head]], np.diff(np.append(head, len(active))))]
    return least


def spans_of(covered: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [start, end) of bytes under the windows that start at the sorted positions."""
    if not len(covered):
        none = np.zeros(0, np.int64)
        return none, none
    gap = np.flatnonzero(np.diff(covered) > length)
    return covered[np.append(0, gap + 1)], covered[np.append(gap, len(covered) - 1)] + length


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans; touching ones are joined."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, s[1:] > e[:-1])
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]


def kept_text(kept: bytes) -> str:
    return kept.decode("utf-8", "ignore")


class _Group:
    """One group of documents, in the same order in every step."""

    def __init__(self, docs: pa.Table, copies: set, length: int, gram: int, parts: int):
        ids, texts, sums = (docs.column(c).to_pylist() for c in ("doc_id", "text", "sha"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, sums[i]))
        self.ids, self.texts, self.sums = [ids[i] for i in order], [texts[i] for i in order], [sums[i] for i in order]
        self.order = order
        self.copy = [(i, s) in copies for i, s in zip(self.ids, self.sums, strict=True)]
        self.length, self.gram, self.parts = length, gram, parts

    def members(self):
        """Document number, first, last, hash of every run, and the runs of each part, in one order."""
        doc, first, last, hashes = [], [], [], []
        for k, (i, t, copy) in enumerate(zip(self.ids, self.texts, self.copy, strict=True)):
            if i is None or copy or len(t) < self.length:
                continue
            a, b, h = runs(t, self.length, self.gram)
            doc.append(np.full(len(a), k))
            first.append(a)
            last.append(b)
            hashes.append(h)
        if not doc:
            return None
        doc, first, last, hashes = map(np.concatenate, (doc, first, last, hashes))
        part = (hashes >> np.uint64(32)) % np.uint64(self.parts)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(self.parts + 1))
        return doc, first, last, hashes.astype(np.uint32), order, bounds


class _Runs:
    """Runs of one bucket's part by the group that they come from; equal runs are stored once."""

    SCHEMA = [("p", pa.int32()), ("g", pa.int32()), ("n", pa.int32()), ("m", pa.int32()), ("heads", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary()), ("s", pa.int32()), ("settled", pa.binary())]
    COLUMNS = "p int, g int, n int, m int, heads binary, sizes binary, text binary, s int, settled binary"

    @staticmethod
    def rows(p: int, gs: list[int], source, doc, ids, first, content, strings: list[bytes], hashes) -> list[tuple]:
        """A row for each group: its runs of the least documents, and the spans of all other runs."""
        owner = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(owner, content, ids)
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        settled = ids > owner[content]
        out = []
        order = np.argsort(source, kind="stable")
        bounds = np.searchsorted(source[order], np.arange(len(gs) + 1))
        for k, g in enumerate(gs):
            at = order[bounds[k] : bounds[k + 1]]
            done, at = at[settled[at]], at[~settled[at]]
            own, which = np.unique(content[at], return_inverse=True)
            heads = packed(doc[at].astype("<u4"), ids[at].astype("<i8"), first[at].astype("<i8"), which.astype("<u4"))
            spans = packed(doc[done].astype("<u4"), first[done].astype("<i8"), (first[done] + sizes[content[done]]).astype("<i8"))
            out.append((p, g, len(at), len(own), heads, packed(sizes[own].astype("<u4"), hashes[own].astype("<u4")), zstandard.compress(b"".join([strings[c] for c in own.tolist()]), 3), len(done), spans))
        return out

    @staticmethod
    def read(members: pa.Table):
        """Groups; source, doc, ids, first and content of each run; strings and hashes of the contents."""
        number: dict[bytes, int] = {}
        gs = members.column("g").to_pylist()
        parts, hashes = [], []
        for k, (n, m, heads, sizes, text) in enumerate(zip(*(members.column(c).to_pylist() for c in ("n", "m", "heads", "sizes", "text")), strict=True)):
            doc, ids, first, which = unpacked(heads, ("<u4", n), ("<i8", n), ("<i8", n), ("<u4", n))
            size, h = unpacked(sizes, ("<u4", m), ("<u4", m))
            raw, ends = zstandard.decompress(text), np.cumsum(size, dtype=np.int64)
            content = np.fromiter((number.setdefault(raw[x:y], len(number)) for x, y in zip((ends - size).tolist(), ends.tolist(), strict=True)), np.int64, m)
            hashes.append(np.stack([content, h.astype(np.int64)]))
            parts.append((np.full(n, k), doc, ids, first, content[which]))
        of = np.zeros(len(number), np.uint32)
        for content, h in hashes:
            of[content] = h
        return (gs, *(np.concatenate(x) for x in zip(*parts, strict=True)), list(number), of)


def _table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(schema)})


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, meet_groups: int = MEET, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, starts, ends, kept (binary) for every row of docs.

    The columns in ``carry`` come along in a struct ``row``; ``kept`` then lacks
    characters of which a cut has left a part.
    """
    if not 8 <= length - 8 or gram % 8 or not 8 <= gram <= length or length - gram + 1 > 63:
        raise ValueError("length must be at least 16, gram a multiple of 8 below it by at most 62")
    spark = docs.sparkSession
    row = [F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text"), *row).withColumn("sha", F.unhex(F.sha2("text", 256)))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(2 * shuffle_partitions(spark), total // group_bytes)
    parts = max(2 * shuffle_partitions(spark), total // (group_bytes // 2))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))
    # Copies: every row whose text a smaller id has too.
    sums, _ = written(rows.select("g", "doc_id", "sha"), "substring-sums")
    first, _ = written(sums.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).filter("k > 1"), "substring-firsts")
    copies, _ = written(spread_join(sums, first, "sha").filter("doc_id > first").select("g", "doc_id", "sha").distinct(), "substring-copies")

    def group(docs_, copies_):
        return _Group(docs_, set(zip(copies_.column("doc_id").to_pylist(), copies_.column("sha").to_pylist(), strict=True)), length, gram, parts)

    def hashes(docs_, copies_):
        """The hashes of each part's runs, and how many each document has."""
        out, got = [], group(docs_, copies_).members()
        if got:
            doc, _, _, h, order, bounds = got
            g = docs_.column("g")[0].as_py()
            for p in np.flatnonzero(np.diff(bounds)):
                at = order[bounds[p] : bounds[p + 1]]
                counts = np.unique(doc[at], return_counts=True)[1].astype("<u4")
                out.append((int(p), g, len(at), len(counts), packed(h[at], counts)))
        return _table([("p", pa.int32()), ("g", pa.int32()), ("n", pa.int32()), ("docs", pa.int32()), ("block", pa.binary())], out)

    def flags(members):
        """One bit for each run: whether its bucket holds several documents."""
        p, gs, ns = members.column("p")[0].as_py(), members.column("g").to_pylist(), members.column("n").to_pylist()
        h, doc, before = [], [], 0
        for n, k, block in zip(ns, members.column("docs").to_pylist(), members.column("block").to_pylist(), strict=True):
            x, counts = unpacked(block, ("<u4", n), ("<u4", k))
            h.append(x)
            doc.append(np.repeat(np.arange(before, before + k), counts))
            before += k
        h, doc = np.concatenate(h), np.concatenate(doc)
        order = np.argsort(h, kind="stable")  # documents ascend within equal hashes
        s, d = h[order], doc[order]
        head = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        size = np.diff(np.append(head, len(s)))
        several = np.zeros(len(s), bool)
        several[order] = np.repeat(d[head] != d[head + size - 1], size)
        bounds = np.cumsum([0, *ns])
        return _table([("g", pa.int32()), ("p", pa.int32()), ("bits", pa.binary())], [(g, p, zstandard.compress(np.packbits(several[a:b]).tobytes(), 1)) for g, a, b in zip(gs, bounds[:-1], bounds[1:], strict=True) if several[a:b].any()])

    def texts(docs_, told):
        """The runs in shared buckets, for the buckets' tasks."""
        out = []
        if docs_.num_rows and told.num_rows:
            mine = group(docs_, told.filter(pc.is_valid(told.column("sha"))))
            bits = {p: b for p, b in zip(told.column("p").to_pylist(), told.column("bits").to_pylist(), strict=True) if b is not None}
            got = mine.members() if bits else None
            if got:
                doc, first, last, h, order, bounds = got
                g, names = docs_.column("g")[0].as_py(), np.array([-1 if i is None else i for i in mine.ids], np.int64)
                for p, b in sorted(bits.items()):
                    at = order[bounds[p] : bounds[p + 1]]
                    at = at[np.unpackbits(np.frombuffer(zstandard.decompress(b), np.uint8), count=len(at)).astype(bool)]
                    k, a, z = doc[at], first[at], last[at] + length
                    number: dict[bytes, int] = {}
                    content = np.fromiter((number.setdefault(mine.texts[i][x:y], len(number)) for i, x, y in zip(k.tolist(), a.tolist(), z.tolist(), strict=True)), np.int64, len(at))
                    hashes = np.zeros(len(number), np.uint32)
                    hashes[content] = h[at]
                    out += _Runs.rows(p, [g], np.zeros(len(at), np.int64), k, names[k], a, content, list(number), hashes)
        return _table(_Runs.SCHEMA, out)

    def meet(members):
        """The same rows, with the runs settled that an equal run of another group covers."""
        gs, source, doc, ids, first, content, strings, hashes = _Runs.read(members)
        return _table(_Runs.SCHEMA, _Runs.rows(members.column("p")[0].as_py(), gs, source, doc, ids, first, content, strings, hashes))

    def spans(members):
        """Covered spans of the documents, found within one part of the buckets."""
        gs, source, doc, ids, first, content, strings, bucket = _Runs.read(members)
        owner = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(owner, content, ids)
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        found = []
        # A run that a smaller document has too is covered whole.
        whole = np.flatnonzero(ids > owner[content])
        found.append((source[whole], doc[whole], first[whole], first[whole] + sizes[content[whole]]))
        # Runs that alone make up their bucket by now are settled; the others are refined.
        _, back, per_bucket = np.unique(bucket, return_inverse=True, return_counts=True)
        open_ = np.flatnonzero(per_bucket[back] > 1)
        at_open = np.full(len(strings), -1)
        at_open[open_] = np.arange(len(open_))
        start = np.concatenate([[0], np.cumsum(sizes[open_])])
        least = refined(np.frombuffer(b"".join([strings[c] for c in open_.tolist()]), np.uint8), start, owner[open_], length)
        # Of each open run, the windows that another run of a smaller document holds.
        covered = np.flatnonzero(least < np.repeat(owner[open_], sizes[open_]))
        string = np.searchsorted(start, covered, "right") - 1
        bounds = np.searchsorted(string, np.arange(len(open_) + 1))
        reached = np.diff(bounds) > 0
        mine = np.flatnonzero((ids == owner[content]) & (at_open[content] >= 0))
        for m in mine[reached[at_open[content[mine]]]].tolist():
            c = at_open[content[m]]
            a, z = spans_of(covered[bounds[c] : bounds[c + 1]] - start[c] + first[m], length)
            found.append((np.full(len(a), source[m]), np.full(len(a), doc[m]), a, z))
        source, doc, a, z = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(source, kind="stable")
        bounds, out = np.searchsorted(source[order], np.arange(len(gs) + 1)), []
        for k in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[k] : bounds[k + 1]]
            out.append((gs[k], len(at), packed(doc[at].astype("<u4"), a[at].astype("<i8"), z[at].astype("<i8"))))
        return _table([("g", pa.int32()), ("n", pa.int32()), ("block", pa.binary())], out)

    def cut(docs_, told):
        """Every document without its covered spans."""
        out, order = [], []
        if docs_.num_rows:
            mine = group(docs_, told.filter(pc.is_valid(told.column("sha"))))
            found = [unpacked(b, ("<u4", n), ("<i8", n), ("<i8", n)) for n, b in zip(told.column("n").to_pylist(), told.column("block").to_pylist(), strict=True) if b is not None]
            doc, a, z = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            order = mine.order
            by_doc = np.argsort(doc, kind="stable")
            bounds = np.searchsorted(doc[by_doc], np.arange(len(mine.ids) + 1))
            for k, (i, t, copy) in enumerate(zip(mine.ids, mine.texts, mine.copy, strict=True)):
                at = by_doc[bounds[k] : bounds[k + 1]]
                if copy and len(t) >= length:
                    s, e = np.array([0]), np.array([len(t)])
                elif len(at):
                    s, e = merged(a[at], z[at])
                else:
                    s = e = np.zeros(0, np.int64)
                ends = [0, *e.tolist()]
                kept = b"".join(t[x:y] for x, y in zip(ends, [*s.tolist(), len(t)], strict=True))
                n_removed = len(t) - len(kept)
                out.append((i, len(t), n_removed, len(s), s.tolist(), e.tolist(), kept_text(kept).encode() if carry else kept))
        lists = pa.list_(pa.int64())
        cuts = _table([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("starts", lists), ("ends", lists), ("kept", pa.binary())], out)
        return cuts.append_column("row", docs_.column("row").take(pa.array(order, pa.int64()))) if carry else cuts

    by_group = rows.groupBy("g")
    hashed = by_group.cogroup(copies.groupBy("g")).applyInArrow(hashes, "p int, g int, n int, docs int, block binary")
    shared = hashed.groupBy("p").applyInArrow(flags, "g int, p int, bits binary")
    none = lambda kind: F.lit(None).cast(kind)
    asked = copies.select("g", "doc_id", "sha", none("int").alias("p"), none("binary").alias("bits")).unionByName(shared.select("g", none("bigint").alias("doc_id"), none("binary").alias("sha"), "p", "bits"))
    runs_, _ = written(by_group.cogroup(asked.groupBy("g")).applyInArrow(texts, _Runs.COLUMNS), "substring-runs")
    found = runs_.filter("s > 0").select("g", F.col("s").alias("n"), F.col("settled").alias("block"))
    if groups > meet_groups:
        runs_, _ = written(runs_.filter("n > 0").groupBy("p", F.pmod(F.col("g"), F.lit(-(-groups // meet_groups)))).applyInArrow(meet, _Runs.COLUMNS), "substring-runs")
        found = found.union(runs_.filter("s > 0").select("g", "s", "settled"))
    found = found.union(runs_.filter("n > 0").groupBy("p").applyInArrow(spans, "g int, n int, block binary"))
    told = copies.select("g", "doc_id", "sha", none("int").alias("n"), none("binary").alias("block")).unionByName(found.select("g", none("bigint").alias("doc_id"), none("binary").alias("sha"), "n", "block"))
    schema = T._parse_datatype_string("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, starts array<bigint>, ends array<bigint>, kept binary")
    if carry:
        schema = schema.add("row", rows.schema["row"].dataType)
    return by_group.cogroup(told.groupBy("g")).applyInArrow(cut, schema)


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with its own columns, the text without its repeated strings; broken characters are dropped."""
    cuts = removed(docs, id_col, text_col, carry=tuple(docs.columns), **how)
    kept = F.col("kept").cast("string")
    return cuts.select(*[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
