"""Temperature mixing of sources, realised as budgeted block permutations.

Source s with a share p_s of all tokens gets the weight p_s^t / sum(p^t).  The
exponent t is bisected: the largest t (nearest to the natural mix) at which the
weights reach the target entropy, but never one at which a source would be repeated
more often than the limit.  The budget is the least that uses every document once, so
the largest source passes once and the others up to ``repeat_limit`` times.

Every source is a stream of epochs, each a permutation of its documents by a hash; the
last epoch ends where the source's budget does.  Blocks of ``block_tokens`` tokens
take from every stream the part that its weight gives, and are permuted within.

Running sums are taken in two steps (over slices of the permutation, then within a
slice), so no source is gathered in one task, whatever its share of the rows.

Tokens here are words (runs other than 0x20 and 0x09-0x0D).  They are counted once, into
a narrow table from which all that follows is read.

Defined results: a null source is a source of its own; a null or empty text has no
tokens and follows its source's epochs; a source without tokens passes once; a
permutation orders by a hash of id and text, so rows of one id, or without any, have
places of their own; rows equal in id and text count each, but the last epoch takes all
or none of them; texts of any length are counted whole; an empty table gives no rows;
only id, source and text are read, and other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import spread_join, written

REPEAT_LIMIT = 4.0
ENTROPY = 0.97  # of the entropy of equal weights
BLOCK_TOKENS = 1_000_000
SEED = 17
#: Up to so many sources (crawls, books, code ...) the driver holds their shares; more are
#: weighed by Spark jobs, a job for each halving.
MOST_SOURCES = 100_000
SLICE_BITS = 12
KEY_BITS = 60
HALVINGS = 50


@dataclass(frozen=True)
class Share:
    source: str
    tokens: int
    target: int  # tokens to take, over all epochs


def weights(tokens: list[int], t: float) -> list[float]:
    total = sum(tokens)
    raised = [(n / total) ** t for n in tokens]
    return [x / sum(raised) for x in raised]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


@dataclass(frozen=True)
class Shape:
    """What the bisections ask of the token counts, all above zero."""

    n: int
    least: int
    most: int
    entropy: Callable[[float], float]  # of the weights under an exponent


def shape(tokens: list[int]) -> Shape:
    return Shape(len(tokens), min(tokens), max(tokens), lambda t: entropy(weights(tokens, t)))


def shape_of_table(counts: DataFrame) -> Shape:
    """The same for a table (src, n): each question is a job over all sources."""
    full = counts.filter("n > 0")
    r = full.agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total")).first()

    def of(t: float) -> float:
        p = F.col("n") / F.lit(r["total"])
        sums = full.agg(F.sum(F.pow(p, F.lit(t))).alias("z"), F.sum(F.pow(p, F.lit(t)) * t * F.log(p)).alias("s")).first()
        return math.log(sums["z"]) - sums["s"] / sums["z"]

    return Shape(r["c"], r["least"] or 1, r["most"] or 1, of)


def exponent(counts: Shape, target: float | None, limit: float | None) -> float:
    """The exponent in [0, 1] for the sources.

    With no target it is the least that the limit allows; with neither, 1.
    """

    def bisected(holds) -> float:
        """The largest t with holds(t), which holds up to some t; 0 if it holds nowhere."""
        if holds(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(HALVINGS):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low

    if counts.n < 2:
        return 1.0
    t = float(limit is None) if target is None else bisected(lambda t: counts.entropy(t) >= target * math.log(counts.n))
    if limit is not None:
        spread = counts.most / counts.least
        # Repetitions fall as t grows: one more than bisected() finds is allowed.
        least = 1.0 - bisected(lambda u: spread**u <= limit)
        t = max(t, least)
    return t


def targets(counts: list[tuple[str, int]], target: float | None, limit: float | None) -> list[Share]:
    full = [n for _, n in counts if n]
    t = exponent(shape(full), target, limit) if full else 1.0
    most = max(full, default=1)
    return [Share(s, n, round(n * (most / n) ** (1 - t)) if n else 0) for s, n in counts]


def _key(epoch: Column, doc: Column, digest: Column, seed: int) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("")), digest)
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def n_words(text: Column) -> Column:
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), " "), ""))


def _source(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(col)), F.lit("null"))


def narrow(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """doc_id, src, n_tokens and digest of every row, written once."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), _source(source_col).alias("src"), n_words(text).cast("bigint").alias("n_tokens"), _digest(text).alias("digest"))
    return written(rows, "mixing-rows")[0]


def plan(rows: DataFrame, target: float | None, limit: float | None) -> DataFrame:
    """One row for each source: src, tokens, target, full epochs, rest and the target of all."""
    spark = rows.sparkSession
    counts, _ = written(rows.groupBy("src").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")), "mixing-counts")
    if counts.count() <= MOST_SOURCES:
        held = {r["src"]: r for r in counts.collect()}  # at most MOST_SOURCES rows
        aims = targets(sorted((r["src"], r["n"]) for r in held.values()), target, limit)
        shares = spark.createDataFrame([(s.source, s.tokens, s.target, held[s.source]["k"]) for s in aims], "src string, tokens bigint, target bigint, k bigint")
        total = sum(s.target for s in aims)
    else:
        of = shape_of_table(counts)
        t = exponent(of, target, limit) if of.n else 1.0
        aim = F.when(F.col("n") > 0, F.bround(F.col("n") * F.pow(F.lit(of.most) / F.col("n"), F.lit(1 - t))).cast("bigint")).otherwise(0)
        shares, _ = written(counts.select("src", F.col("n").alias("tokens"), aim.cast("bigint").alias("target"), "k"), "mixing-shares")
        total = shares.agg(F.sum("target")).first()[0]
    part = lambda op, empty: F.when(F.col("tokens") > 0, op).otherwise(empty).cast("bigint")
    full = part(F.floor(F.expr("target div greatest(tokens, 1)")), 1)
    return shares.select("src", "tokens", "target", full.alias("full"), part(F.expr("target % greatest(tokens, 1)"), 0).alias("rest"), F.lit(total).cast("bigint").alias("total"), "k")


def realised(rows: DataFrame, shares: DataFrame, seed: int) -> DataFrame:
    """doc_id, src, n_tokens, digest, epoch, key and the tokens before it in its source's stream, for every copy."""
    epochs = F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1 + (F.col("rest") > 0).cast("bigint"))
    each = spread_join(rows, shares, "src").withColumn("epoch", F.explode(epochs)).withColumn("key", _key(F.col("epoch"), F.col("doc_id"), F.col("digest"), seed))
    each = each.withColumn("slice", F.shiftright("key", KEY_BITS - SLICE_BITS))
    # Sums of the slices before one: a few thousand rows for each source and epoch.
    sums = each.groupBy("src", "epoch", "slice").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.partitionBy("src", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("src", "epoch", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    order = Window.partitionBy("src", "epoch", "slice").orderBy("key", "doc_id", "digest")
    before, peers = order.rowsBetween(Window.unboundedPreceding, -1), order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.join(offsets, ["src", "epoch", "slice"])
    each = each.withColumn("in_epoch", F.col("offset") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("end", F.col("offset") + F.sum("n_tokens").over(peers))
    fits = (F.col("epoch") < F.col("full")) | (F.col("end") <= F.col("rest"))
    return each.filter(fits).withColumn("before", F.col("epoch") * F.col("tokens") + F.col("in_epoch"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target: float | None = ENTROPY, limit: float | None = REPEAT_LIMIT, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """A row for every copy of a document: doc_id, source, epoch, n_tokens, before, block_id, slot."""
    rows = narrow(docs, id_col, source_col, text_col)
    out = realised(rows, plan(rows, target, limit), seed)
    by_place = F.floor(F.col("before") / F.col("target") * F.col("total") / F.lit(block_tokens))
    blocks = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total") / F.lit(block_tokens)))
    out = out.withColumn("block_id", F.when(F.col("target") > 0, by_place).otherwise(F.pmod("key", blocks)))
    order = Window.partitionBy("block_id").orderBy(F.md5(F.concat_ws(":", F.lit(f"{seed}-slot"), "epoch", "doc_id", "digest")), "doc_id", "epoch", "src", "before", "n_tokens")
    source = F.when(F.col("src") != "null", F.substring("src", 2, 1 << 30))
    return out.withColumn("slot", F.row_number().over(order).cast("bigint")).select("doc_id", source.alias("source"), "epoch", "n_tokens", "before", "block_id", "slot")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target: float | None = ENTROPY, limit: float | None = REPEAT_LIMIT, seed: int = SEED, copy_col: str | None = None) -> DataFrame:
    """The rows of docs, with its own columns, each as often as the mix takes it.

    Texts stay where they are: what the last epoch takes is a prefix of its
    permutation, so one place for each source tells which rows are in it.
    ``copy_col`` names a further column for the number of the copy, from 0 on.
    """
    rows = narrow(docs, id_col, source_col, text_col)
    shares = plan(rows, target, limit)
    place = F.struct(F.col("key"), F.col("doc_id"), F.col("digest"))
    ends = realised(rows, shares, seed).filter(F.col("epoch") == F.col("full")).groupBy("src").agg(F.max(place).alias("end"))
    told, _ = written(shares.join(ends, "src", "left").select("src", "full", "end", "k"), "mixing-told")
    # The row travels as one column, so that its names are free.
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), _source(source_col).alias("src"), _digest(F.col(text_col)).alias("digest"))
    joined = spread_join(whole, told, "src").withColumn("key", _key(F.col("full"), F.col("doc_id"), F.col("digest"), seed))
    once_more = F.coalesce(place <= F.col("end"), F.lit(False)).cast("bigint")
    copies = F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1 + once_more)
    out = joined.withColumn("copy", F.explode(copies))
    return out.select("row.*", *([F.col("copy").alias(copy_col)] if copy_col else []))
