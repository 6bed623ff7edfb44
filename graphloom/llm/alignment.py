"""Alignment of two tokenizers' tokens over the same text, in Spark SQL.

A is a byte-level vocabulary read by tokenizers, applied to a space and the text; B is a
sentencepiece model, which adds that space itself.  Tokens become rows (``posexplode``);
a window sums their byte lengths to the byte at which each ends; ends of A and B meet by
an equi-join on document and end.  An end is unique on each side, so that join is a
grouping of both sides' rows, which needs no exchange.  (An end is written with the token
that it begins, so that all steps read rows in ascending order and none sorts anew.)
Bytes where both end are cuts; a running count of cuts numbers the groups.  Between two
neighbouring ends lies a stretch of bytes under one token of each side, and each pair
that overlaps has one such stretch, so links are a range join that a running window
answers: each stretch takes the last token of either side that began.

What meets are *fragments*, not whole documents.  No token of either side crosses a
single space or line end between two other characters (checked on loading for B; for A
the pattern says so), so a document's alignment is that of its fragments, one after
another.  Documents that one task reads are a *unit* of bounded size and number their
fragments.  Fragments of all units meet by a hash (and their bytes, so collisions do no
harm), and each different fragment of the corpus is tokenized and aligned once; it comes
at most once from each unit, so none is a hot key.  All tables that meet by fragment are
bucketed by that hash, so texts of fragments are shuffled once, and what was found
returns to the units.

Defined results: null and empty texts, and texts whose tokens do not give back their
bytes (a literal space mark, text that is no UTF-8), have no tokens and count zero;
repeated rows are aligned each and each counts as a document; a null id is returned as
such; texts of any length are handled whole; an empty table gives no rows; only the id
and the text column are read, so other columns may have any name.
"""

from __future__ import annotations

import atexit
import re
import uuid
from array import array
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import new_path, remove, shuffle_partitions, written
from graphloom.llm.tokens import byte_letters, slices
from graphloom.sources.shared import swept

#: A unit ends with the batch in which it has this many different fragments, or bytes of them: larger units repeat less, and take more memory.
UNIT_FRAGMENTS, UNIT_BYTES = 300_000, 12_000_000
#: Fragments and bytes that are tokenized at a time.
BATCH_FRAGMENTS, BATCH_BYTES = 20_000, 4_000_000
#: Fragments whose groups are put together at a time.
JOINED = 200_000
#: Fewer pairs than this hold more than one in so many links each; only those are broadcast.
HOT_PAIRS = 200_000
#: A pair of ids as one number: A's id times this, plus B's.
SPAN = 1 << 32
#: A token as one number: its side from this bit on, its byte length from bit 32 on, its id.
SIDE_BIT = 62

#: Bytes of white space, or the start of such a character, besides the space and the line end.
_OTHER_SPACE = (b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80\x80", b"\xe2\x80\x81", b"\xe2\x80\x82", b"\xe2\x80\x83", b"\xe2\x80\x84", b"\xe2\x80\x85", b"\xe2\x80\x86", b"\xe2\x80\x87", b"\xe2\x80\x88", b"\xe2\x80\x89", b"\xe2\x80\x8a", b"\xe2\x80\xa8", b"\xe2\x80\xa9", b"\xe2\x80\xaf", b"\xe2\x81\x9f", b"\xe3\x80\x80", "▁".encode())
_CUT = re.compile(r"(?<![\s▁])(?=[ \n][^\s▁])")
_PLAIN_TAIL = b".,!?;:"
_WHOLE = b"\xff"


def fragments(text: bytes) -> list[bytes]:
    """A space and the text, cut before single spaces and line ends between other characters; a space at the start of a fragment is left out.

    A fragment of a space and a line end keeps its space, behind a byte that no text holds.
    """
    words = text.split()
    if len(words) == text.count(b" ") + text.count(b"\n") + 1 and not any(s in text for s in _OTHER_SPACE):
        return text.replace(b"\n", b" \n").split(b" ") if b"\n" in text else words
    cut = [x.encode() for x in _CUT.split(" " + text.decode()) if x]
    return [x[1:] if x[:1] == b" " and x[1:2] != b"\n" else x if x[:1] == b"\n" else _WHOLE + x for x in cut]


def cut(text: bytes) -> list[bytes]:
    """The fragments of a text; none for an empty text or one that is no UTF-8."""
    try:
        text.isascii() or text.decode()
    except UnicodeDecodeError:
        return []
    return fragments(text) if text else []


class FragmentTokens:
    """Tokens of fragments: ids of both sides in growing arrays."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(byte_path)
        self.tok.encode_special_tokens = True
        self.model, self.letters = self.tok.model, byte_letters()
        self.sp = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        if any(x not in vocab for x in self.letters):
            raise ValueError("the byte-level vocabulary lacks some bytes")
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("pieces of this vocabulary span white space")
        self.piece_bytes = [bytes([int(p[3:-1], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Byte lengths of each side's ids.
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int32), np.array([len(x) for x in self.piece_bytes], np.int32)
        for token, i in vocab.items():
            self.sizes[0][i] = len(token)
        self.space, self.line = self.letters[32], [t.id for t in self.model.tokenize(self.letters[10])]
        self.start()

    def start(self) -> None:
        self.ids, self.ends = (array("i"), array("i")), (array("q", [0]), array("q", [0]))
        self.bad: list[bool] = []

    def byte_side(self, fragment: bytes) -> list[int]:
        """A word with an optional tail of stops is one or two pre-tokens; all else goes through the library's pattern."""
        if fragment[:1] == _WHOLE:
            return self.tok.encode(fragment[1:].decode(), add_special_tokens=False).ids
        lead, tokenize = fragment[:1] == b"\n", self.model.tokenize
        whole = fragment[1:] if lead else fragment
        stem = whole.rstrip(_PLAIN_TAIL)
        if stem.isalpha():  # ASCII letters
            word = stem.decode()
        else:
            word = stem.decode()
            if not word.isalpha() or max(word) > "ɏ":
                return self.tok.encode(fragment.decode() if lead else " " + fragment.decode(), add_special_tokens=False).ids
            word = "".join([self.letters[x] for x in stem])
        ids = [t.id for t in tokenize(word if lead else self.space + word)]
        if len(stem) < len(whole):
            ids += [t.id for t in tokenize(whole[len(stem) :].decode())]
        return self.line + ids if lead else ids

    def add(self, new: list[bytes]) -> None:
        """Tokenizes fragments; those whose pieces do not give back their bytes are ``bad``."""
        # The library puts the space mark before each; before a line end it is no part of the fragment.
        (ids_a, ids_b), (ends_a, ends_b), join = self.ids, self.ends, self.piece_bytes.__getitem__
        texts = [(x[2:] if x[:1] == _WHOLE else x).decode() for x in new]
        for fragment, b in zip(new, self.sp.encode(texts, num_threads=1), strict=True):
            if fragment[:1] == b"\n":
                b, whole = b[1:], fragment
            elif fragment[:1] == _WHOLE:
                whole = fragment[1:]
            else:
                # An empty fragment is the space alone.
                b, whole = b or self.sp.encode(" ")[:1], b" " + fragment
            told = b"".join(map(join, b))
            # As no fragment grows, one that is not given back cannot be made up for by others: its texts are not given back.
            if len(told) > len(whole):
                raise ValueError("pieces of this vocabulary give more bytes than they read")
            self.bad.append(told != whole)
            ids_a.extend(self.byte_side(fragment))
            ids_b.extend(b)
            ends_a.append(len(ids_a))
            ends_b.append(len(ids_b))

    def lists(self) -> pa.Array:
        """The tokens of the fragments as lists, those of A before those of B: side, byte length and id in one number."""
        n, at = len(self.bad), [np.frombuffer(self.ends[k], np.int64) for k in (0, 1)]
        values = [np.array(np.frombuffer(self.ids[k], np.int32), np.int64) if len(self.ids[k]) else np.zeros(0, np.int64) for k in (0, 1)]
        coded = np.concatenate([(k << SIDE_BIT) + (self.sizes[k][values[k]].astype(np.int64) << 32) + values[k] for k in (0, 1)])
        owner = np.concatenate([np.repeat(np.arange(n), np.diff(at[k])) for k in (0, 1)])
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(coded[np.argsort(owner, kind="stable")]))


_UNITS = "unit bigint, row bigint, doc_id bigint, codes array<int>, f int, fragment binary"


def units(df: DataFrame) -> DataFrame:
    """Rows of two kinds by unit: documents (row, doc_id, codes), whose codes are the numbers of their fragments, and fragments (f, fragment)."""

    def run(batches):
        part, unit, row = TaskContext.get().partitionId(), 0, 0
        types = {"unit": pa.int64(), "row": pa.int64(), "doc_id": pa.int64(), "codes": pa.list_(pa.int32()), "f": pa.int32(), "fragment": pa.binary()}
        own: dict[bytes, int] = {}
        size = 0

        def emit(n: int, **columns):
            columns = {"unit": pa.array(np.full(n, part << 24 | unit)), **columns}
            return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in types.items()], names=list(types))

        def whole():
            names = list(own)
            for k in range(0, len(names), 50_000):
                some = names[k : k + 50_000]
                yield emit(len(some), f=pa.array(np.arange(k, k + len(some), dtype=np.int32)), fragment=pa.array(some, pa.binary()))
            own.clear()

        for batch in batches:
            for p, q in slices(batch, "text"):
                piece = batch.slice(p, q - p)
                codes = []
                for x in piece.column("text").to_pylist():
                    fragments_here = cut(x or b"")
                    for y in set(fragments_here).difference(own):
                        own[y] = len(own)
                        size += len(y)
                    codes.append(list(map(own.__getitem__, fragments_here)))
                rows = pa.array(np.arange(row, row + q - p, dtype=np.int64) + (part << 40))
                yield emit(q - p, row=rows, doc_id=piece.column("doc_id"), codes=pa.array(codes, pa.list_(pa.int32())))
                row += q - p
                if len(own) >= UNIT_FRAGMENTS or size >= UNIT_BYTES:
                    yield from whole()
                    unit, size = unit + 1, 0
        yield from whole()
        pa.default_memory_pool().release_unused()

    return df.selectExpr("doc_id", "cast(text as binary) as text").mapInArrow(run, _UNITS)


def met(pieces: DataFrame, n: int) -> DataFrame:
    """(unit, f, h, t, fragment): equal fragments of pieces(unit, f, fragment) have one (h, t), and one of them keeps its bytes."""
    same = Window.partitionBy("h").orderBy("fragment")
    dealt = pieces.withColumn("h", F.xxhash64("fragment")).repartition(n, "h")
    told = dealt.withColumn("t", F.dense_rank().over(same)).withColumn("before", F.lag("fragment").over(same))
    return told.select("unit", "f", "h", "t", F.when(~F.col("before").eqNullSafe(F.col("fragment")), F.col("fragment")).alias("fragment"))


def tokenized(kinds: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(h, t, bad, tokens) of kinds(h, t, fragment)."""

    def run(batches):
        own = FragmentTokens(byte_path, piece_path)

        def emit(batch):
            own.start()
            own.add(batch.column("fragment").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("h"), batch.column("t"), pa.array(own.bad, pa.bool_()), own.lists()], names=["h", "t", "bad", "tokens"])

        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("fragment")).to_numpy(zero_copy_only=False).astype(np.int64))
            p = 0
            while p < len(batch):
                before = sizes[p - 1] if p else 0
                q = min(p + BATCH_FRAGMENTS, max(p + 1, int(np.searchsorted(sizes, before + BATCH_BYTES, "right"))))
                yield emit(batch.slice(p, q - p))
                p = q
        pa.default_memory_pool().release_unused()

    return kinds.select("h", "t", "fragment").mapInArrow(run, "h bigint, t int, bad boolean, tokens array<bigint>")


def align(tokens: DataFrame, *keys: str) -> DataFrame:
    """One row for the keys of each row of tokens(keys, tokens): n_a, n_b, n_groups, n_links, pairs, groups.

    tokens are those of A, then those of B, each as one number (``SIDE_BIT``).  pairs
    has one number for each link; groups is ``a1,a2|b1;a3|b2,b3``.
    """
    rows = tokens.select(*keys, F.posexplode("tokens").alias("pos", "x"))
    rows = rows.select(*keys, "pos", F.shiftright("x", SIDE_BIT).cast("int").alias("side"), F.col("x").bitwiseAND((1 << 32) - 1).cast("int").alias("id"), F.shiftright("x", 32).bitwiseAND((1 << (SIDE_BIT - 32)) - 1).cast("int").alias("n"))
    # Where the token before ends: tokens of both sides that start at one byte are told by the same number.
    length = F.sum("n").over(Window.partitionBy(*keys, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    begun = rows.select(*keys, (length - F.col("n")).cast("int").alias("at"), F.when(F.col("side") == 0, F.col("id")).alias("a"), F.when(F.col("side") == 1, F.col("id")).alias("b"))
    # The equi-join of both sides on keys and byte, over rows in that order, which the steps below keep.
    met = begun.sortWithinPartitions(*keys, "at").groupBy(*keys, "at").agg(F.max("a").alias("a_here"), F.max("b").alias("b_here"))
    # Each stretch of bytes from one number to the next lies under the last tokens that began.
    so_far = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.col("a_here").isNotNull() & F.col("b_here").isNotNull()
    links = met.select(*keys, "at", "a_here", "b_here", cut.alias("cut"), F.last("a_here", True).over(so_far).alias("a"), F.last("b_here", True).over(so_far).alias("b"), F.count(F.when(cut, 1)).over(so_far).alias("g"))
    # Each side's ids in order, with a mark before each group's first; then the groups of both sides side by side.
    mark = F.when(F.col("at") == 0, "").when(F.col("cut"), ";").otherwise(",")
    told = links.groupBy(*keys).agg(
        F.count("a_here").alias("n_a"),
        F.count("b_here").alias("n_b"),
        F.max("g").alias("n_groups"),
        F.count("*").alias("n_links"),
        F.collect_list(F.col("a").cast("bigint") * SPAN + F.col("b")).alias("pairs"),
        F.sort_array(F.collect_list(F.struct("at", F.concat(mark, F.col("a_here").cast("string")).alias("a"), F.concat(mark, F.col("b_here").cast("string")).alias("b")))).alias("begun"),
    )
    one = lambda s: F.split(F.array_join(f"begun.{s}", ""), ";")
    groups = F.array_join(F.zip_with(one("a"), one("b"), lambda x, y: F.concat(x, F.lit("|"), y)), ";")
    return told.select(*keys, "n_a", "n_b", "n_groups", "n_links", "pairs", groups.alias("groups"))


@contextmanager
def _in_place(spark: SparkSession):
    """Joins on (unit, f) keep tables where they are that are dealt by unit alone, and groups of rows in order are read in order; affects plans only."""
    own = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.replaceHashWithSortAgg": "true"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class _Bucketed:
    """A table in buckets by a column in the shared folder."""

    def __init__(self, df: DataFrame, n: int, by: str):
        self.spark, self.name = df.sparkSession, f"alignment_{uuid.uuid4().hex}"
        self.path = new_path(self.spark, "alignment")
        with swept(self.spark):
            df.write.bucketBy(n, by).option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)

    def drop_at_end(self) -> None:
        atexit.register(self._drop_quietly)

    def _drop_quietly(self) -> None:
        try:
            self.drop()
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


def pair_counts(documents: DataFrame, pieces: DataFrame, kinds: DataFrame) -> DataFrame:
    """(pair, docs, best, k): documents that hold the pair linked, whether that is the most for its A id, and its rows in kinds.

    documents(unit, row, codes), pieces(unit, f, bad, pairs) and kinds(pairs).
    """
    used = documents.select("unit", "row", F.explode(F.array_distinct("codes")).alias("f")).join(pieces.hint("shuffle_hash"), ["unit", "f"])
    # A document's pairs are made different in an array of its own, which needs no exchange.
    held = used.groupBy("unit", "row").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.bool_or("bad").alias("bad")).filter("not bad")
    docs = held.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    times = kinds.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("k"))
    both = docs.join(times, "pair")
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))  # at most as many rows as B has ids
    return both.select("pair", "docs", (F.col("docs") == most).cast("int").alias("best"), "k")


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _assembled(documents: DataFrame, each: DataFrame) -> DataFrame:
    """doc_id, the sums over each document's fragments, and their groups one after another; a task holds the fragments of one unit."""

    def run(docs: pa.Table, frags: pa.Table) -> pa.Table:
        at = np.zeros(len(frags) + 1, np.int32)
        at[frags.column("f").to_numpy()] = np.arange(len(frags), dtype=np.int32)
        numbers = {name: frags.column(name).to_numpy() for name in _NUMBERS}
        bad, groups = frags.column("bad").to_numpy(), frags.column("groups").combine_chunks()
        lists = docs.column("codes").combine_chunks()
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
        done, p = [], 0
        while p < len(docs):  # few documents at a time: what is made of them is many times as long as their codes
            q = max(p + 1, int(np.searchsorted(bounds, bounds[p] + JOINED, "right")) - 1)
            codes, lengths = at[lists.slice(p, q - p).flatten().to_numpy()], np.diff(bounds[p : q + 1])
            if bad[codes].any():  # a text with a fragment that is not given back has no tokens
                owner = np.repeat(np.arange(q - p), lengths)
                keep = ~np.isin(owner, owner[bad[codes]])
                codes, lengths = codes[keep], np.bincount(owner[keep], minlength=q - p)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(x[codes])])[ends]), pa.int64()) for x in numbers.values()]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), groups.take(pa.array(codes))), ";")
            done.append(pa.table([docs.column("doc_id").slice(p, q - p), *sums, texts], names=["doc_id", *_NUMBERS, "groups"]))
            p = q
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(done) if done else out_schema.empty_table()

    out_schema = pa.schema([("doc_id", pa.int64()), *[(name, pa.int64()) for name in _NUMBERS], ("groups", pa.string())])
    schema = "doc_id bigint, " + ", ".join(f"{n} bigint" for n in _NUMBERS) + ", groups string"
    return documents.groupBy("unit").cogroup(each.groupBy("unit")).applyInArrow(run, schema)


def cross_alignment(df: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups for every row of df.

    A pair of ids counts by the documents of the whole table that hold it linked; n_best
    is the number of a document's links whose count is the highest of their A id, ties
    included, and count_sum the sum of the counts over its links.

    Documents are put together when the result is read; written groups would take more
    disk than all else.  The tables that are read then stay until the driver ends.
    """
    spark = df.sparkSession
    n = 2 * shuffle_partitions(spark)
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    read = _Bucketed(units(texts), n, "unit")
    documents = read.rows.filter("row is not null").select("unit", "row", "doc_id", "codes")
    with _in_place(spark):
        pieces = _Bucketed(met(read.rows.filter("f is not null").select("unit", "f", "fragment"), n), n, "h")
        tokens = _Bucketed(tokenized(pieces.rows.filter("fragment is not null"), byte_path, piece_path), n, "h")
        # Every fragment has a token of A, so it has its row.
        aligned = _Bucketed(align(tokens.rows, "h", "t", "bad"), n, "h")
        tokens.drop()
        where = pieces.rows.select("unit", "f", "h", "t")
        here = where.join(aligned.rows.select("h", "t", "bad", "pairs").hint("shuffle_hash"), ["h", "t"]).select("unit", "f", "bad", "pairs")
        counts, counts_path = written(pair_counts(documents, here, aligned.rows), "pair-counts")
        total = counts.agg(F.sum("k")).first()[0] or 0
        hot = F.col("k") > total / HOT_PAIRS  # fewer than HOT_PAIRS pairs
        many = F.broadcast(counts.filter(hot).select("pair", "docs", "best"))
        links = aligned.rows.select("h", "t", F.explode("pairs").alias("pair"))
        sums = lambda x: x.groupBy("h", "t").agg(F.sum("docs").alias("docs"), F.sum("best").alias("best"))
        rest = links.join(many.select("pair"), "pair", "left_anti").join(counts.filter(~hot).select("pair", "docs", "best"), "pair")
        value = _Bucketed(sums(sums(links.join(many, "pair")).unionByName(rest.select("h", "t", "docs", F.col("best").cast("bigint").alias("best"))).repartition(n, "h")), n, "h")
        # A pair that only bad texts hold has no count, and none of its fragments is asked for.
        whole = aligned.rows.drop("pairs").join(value.rows, ["h", "t"], "left").withColumnsRenamed({"best": "n_best", "docs": "count_sum"}).fillna(0, list(_NUMBERS)).select("h", "t", "bad", *_NUMBERS, "groups")
        # Written where the rows are, in the order of h, so what equal fragments repeat takes little; then all but this and the documents can go.
        each, _ = written(where.join(whole.hint("shuffle_hash"), ["h", "t"]).drop("h", "t"), "alignment")
    for table in (pieces, aligned, value):
        table.drop()
    remove(spark, counts_path)
    read.drop_at_end()
    return _assembled(documents, each)
