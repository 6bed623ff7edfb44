"""Near-duplicate embeddings through an inverted multi-index.

Vectors are scaled to length 1 and cut in halves; each half has its own codebook, and
the pairs of codewords form a grid of cells.  A vector is indexed under its ``visits``
nearest cells, found by walking the two sorted codeword lists together (multi-sequence
traversal).  Vectors that share a cell are compared in double precision, and a pair is
counted in the first cell that they share.  No list, cell or partner count is capped.

The codebooks are fitted to a bounded sample and grow with the number of vectors.  The
number of visits is the least at which made-up pairs at exactly the least cosine share
a cell with the target recall.  Such pairs are made around sampled vectors, off in any
direction, in directions in which the data differ, and towards a near neighbour, so no
luck is needed where true pairs are rare; true pairs of the sample that no ball joins are
tried beside them; they are weighed by vectors and by cells, so
that no crowded group sets the number for the others.

Crowds need no comparing: vectors within half the angle of a pivot all link with each
other.  Sampled vectors with many such neighbours become pivots of *balls*.  Members of
a ball leave the index and are counted by their number; a vector outside meets the
shells of every ball within reach, and is compared only with those shells for which
the triangle bounds on angles leave it open whether all or none of them link.
Where balls lie within reach of each other, vectors would visit many: the sample tells
how often, and only the largest crowds whose visits stay within ``FAN`` for each vector
become balls.  The other crowds stay in the index, where their cells are compared in
blocks.

Equal vectors are indexed once and counted by their number.  Tasks pass on link counts
and a spanning forest, not pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite parts
link with nothing and are kept; only vectors of equal length are compared; repeated
rows link with each other, rows of one id each by its own vector; a null id is no
component id unless no other is in reach; very long vectors only make the sample
smaller; an empty table gives no rows.  Only the id and the vector are read, whatever
other columns are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import spread_join, written
from graphloom.llm.links import Forest, components

SAMPLE = 8_192  # vectors to which the codebooks are fitted, at least ...
PER_WORD = 16  # ... and for each codeword
SAMPLE_NUMBERS = 1 << 24  # bound of the sample, in vector components
MOST_WORDS = 8_192  # codewords of a half
PER_CELL = 4  # vectors for each cell of the grid, counted once
MOST = 2_048  # members of a cell, or of a side of a comparison, in one task
SPOT = 8  # times as many rows of a spot go to one task
TARGET_RECALL = 0.995  # of pairs at exactly the least cosine
CROWD = 8  # sampled neighbours of a pivot
SHELLS = 16
FAN = 16  # shells of balls that a sampled vector visits, on average, at most


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec of all rows; vec is null where the vector cannot link at all."""
    element = getattr(df.schema[vec_col].dataType, "elementType", None)
    kind = "float" if isinstance(element, T.FloatType) else "double"
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.withColumn("vec", F.when(finite & F.exists("vec", lambda x: x != 0), F.col("vec")))


def units(raw: np.ndarray) -> np.ndarray:
    flat = raw.astype(np.float64)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # no overflow of squares
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def squared(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ words.T + (words**2).sum(1)[None, :]


def _parts(n: int, step: int = 2_000):
    return (slice(s, s + step) for s in range(0, n, step))


def codebook(points: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k codewords by Lloyd's rounds from a random start, in order along their main axis."""
    rng = np.random.default_rng(seed)
    words = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([squared(points[p], words).argmin(1) for p in _parts(len(points))])
        order = np.argsort(near, kind="stable")
        held, at = np.unique(near[order], return_index=True)
        words = words.copy()
        words[held] = np.add.reduceat(points[order], at) / np.diff(np.append(at, len(order)))[:, None]
    axis = np.linalg.svd(words - words.mean(0), full_matrices=False)[2][:1]
    return words[np.argsort((words @ axis.T).sum(1), kind="stable")]


def _least(values: np.ndarray, m: int) -> np.ndarray:
    """Columns of the m least values of each row, ascending."""
    if m < values.shape[1]:
        some = np.argpartition(values, m - 1, 1)[:, :m]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(values, some, 1), 1, kind="stable"), 1)
    return np.argsort(values, 1, kind="stable")


def traverse(x: np.ndarray, words: tuple[np.ndarray, np.ndarray], m: int) -> np.ndarray:
    """The m nearest cells of each row (all, if there are fewer), nearest first.

    The cell of the i-th nearest codeword of one half and the j-th of the other has
    i * j cells at least that are as near, itself included, so a walk of m steps never
    leaves i * j <= m.
    """
    half = words[0].shape[1]
    first, second = squared(x[:, :half], words[0]), squared(x[:, half:], words[1])
    k1, k2 = first.shape[1], second.shape[1]
    o1, o2 = _least(first, min(k1, m)), _least(second, min(k2, m))
    d1, d2 = np.take_along_axis(first, o1, 1), np.take_along_axis(second, o2, 1)
    i, j = np.nonzero(np.arange(1, o1.shape[1] + 1)[:, None] * np.arange(1, o2.shape[1] + 1)[None, :] <= m)
    best = _least(d1[:, i] + d2[:, j], min(m, k1 * k2))
    return np.take_along_axis(o1[:, i].astype(np.int64) * k2 + o2[:, j], best, 1)


def made_up(points: np.ndarray, base: np.ndarray, cosine: float, seed: int = 7) -> list[np.ndarray]:
    """For each of the points, partners at the cosine, off in the directions that the module names."""
    rng = np.random.default_rng(seed)
    # Differences of points, mixed at random, keep to the dimensions that the data use.
    few = min(64, len(base))
    apart = base[rng.integers(len(base), size=few)] - base[rng.integers(len(base), size=few)]
    some = base[rng.choice(len(base), min(len(base), 2_048), replace=False)]
    near = points @ some.T
    near[near > 1 - 1e-9] = -2
    out = []
    for off in (rng.normal(size=points.shape), rng.normal(size=(len(points), few)) @ apart, some[near.argmax(1)] - points):
        off = off - (off * points).sum(1, keepdims=True) * points
        length = np.linalg.norm(off, axis=1, keepdims=True)
        off = np.divide(off, length, out=np.zeros_like(off), where=length > 1e-9)
        out.append(cosine * points + max(0.0, 1 - cosine**2) ** 0.5 * off)
    return out


def linked(points: np.ndarray, base: np.ndarray, cosine: float, at: np.ndarray, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Points outside all balls that link with some of the base, and one such partner of each, taken at random."""
    some = base[np.random.default_rng(seed).choice(len(base), min(len(base), 2_048), replace=False)]
    near = points @ some.T
    open_ = (near >= cosine) & (near <= 1 - 1e-9)
    who = np.flatnonzero(open_.any(1) & ((points @ at.T).max(1, initial=-2) < half_cosine(cosine)))
    pick = np.where(open_[who], np.random.default_rng(seed).random((len(who), len(some))), -1)
    return who, some[pick.argmax(1)] if len(who) else points[:0]


def reaching(values: np.ndarray, weights: np.ndarray, share: float) -> int:
    """The least of the values up to which the given share of the weight lies."""
    order = np.argsort(values, kind="stable")
    weight = np.cumsum(weights[order])
    return int(values[order][min(np.searchsorted(weight, share * weight[-1]), len(order) - 1)])


def meeting(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """For lists of cells, nearest first: the visits after which x[k] and y[k] share one; most + 1 if never."""
    steps = np.maximum(np.arange(1, x.shape[1] + 1)[:, None], np.arange(1, y.shape[1] + 1)[None, :])
    return np.concatenate([np.where(x[p, :, None] == y[p, None, :], steps, most + 1).min((1, 2)) for p in _parts(len(x), 500)])


def visits(points: np.ndarray, words: tuple[np.ndarray, np.ndarray], cosine: float, recall: float, at: np.ndarray, tried: int = 4_000) -> int:
    """The visits with which made-up pairs, and pairs of the sample that no ball joins, meet with the recall, counted by vectors and by cells."""
    q = points[np.random.default_rng(5).choice(len(points), min(tried, len(points)), replace=False)]
    every = np.arange(len(q))
    pairs, cells, m = [(every, y) for y in made_up(q, points, cosine)], len(words[0]) * len(words[1]), 16
    who, y = linked(q, points, cosine, at)
    if len(who):
        pairs.append((who, y))
    while True:
        m = min(m, cells)
        own = traverse(q, words, m)
        _, cell, crowd = np.unique(own[:, 0], return_inverse=True, return_counts=True)
        need = 1
        for rows, y in pairs:
            met = meeting(own[rows], traverse(y, words, m), m)
            need = max(need, reaching(met, np.ones(len(rows)), recall), reaching(met, 1 / crowd[cell[rows]], recall))
        if need <= m or m == cells:
            return min(need, cells)
        m *= 2


def pivots(points: np.ndarray, cosine: float, crowd: int = CROWD) -> np.ndarray:
    """Sampled vectors that many others surround within half the angle; each of the crowd is covered once."""
    points = points[:SAMPLE]
    near = np.concatenate([points[p] @ points.T >= half_cosine(cosine) for p in _parts(len(points))])
    count, out = near.sum(1), []
    while len(count) and count.max() > crowd:
        k = int(count.argmax())
        out.append(points[k])
        gone = np.flatnonzero(near[k])
        count -= near[:, gone].sum(1)
        near[:, gone] = False
        count[gone] = 0
    return np.array(out).reshape(-1, points.shape[1])


def afforded(points: np.ndarray, at: np.ndarray, cosine: float, fan: float = FAN) -> np.ndarray:
    """Of the pivots, those with the most members first, all that keep the visits of the sampled points within fan for each.

    A point outside all balls visits a ball whether or not others are there, and one in a
    ball visits others only from one side, so the visits counted here, of each ball alone,
    are an upper bound whichever pivots are left out.
    """
    points = points[:SAMPLE]
    if not len(at):
        return at
    dots = np.concatenate([points[p] @ at.T for p in _parts(len(points))])
    members, visited = np.bincount(dots.argmax(1)[dots.max(1) >= half_cosine(cosine)], minlength=len(at)), np.zeros(len(at))
    for b in range(len(at)):
        away = dots[:, b : b + 1]
        _, _, v, _, _ = met_shells(away[away[:, 0] < half_cosine(cosine)], cosine)
        visited[b] = len(v) / len(points)
    kept, held = [], 0.0
    for b in np.argsort(-members, kind="stable"):
        if held + visited[b] <= fan:
            held += visited[b]
            kept.append(b)
    return at[np.sort(np.array(kept, np.int64))]


def met_shells(dots: np.ndarray, cosine: float):
    """(home, own, v, shell, every): each vector's own ball, or -1, and its shell there; the shells that vectors meet.

    v holds (vector, ball) of each meeting; ``every`` is true where the whole shell is within the angle.
    """
    whole, inner = np.arccos(cosine), np.arccos(half_cosine(cosine))
    width, far = np.arccos(half_cosine(cosine) - 1e-9) / SHELLS, np.cos(min(np.pi, whole + inner + 1e-6))
    upper = width * np.arange(1, SHELLS + 1)
    home = np.where(dots.max(1, initial=-2) >= half_cosine(cosine), dots.argmax(1), -1)
    angle = np.arccos(np.clip(dots, -1, 1))
    rows, balls = np.nonzero((dots >= far) & ((home[:, None] < 0) | (home[:, None] > np.arange(dots.shape[1])[None, :])))
    alpha = angle[rows, balls]
    v, shell = np.nonzero(alpha[:, None] - upper[None, :] <= whole + 1e-6)
    every = alpha[v] + upper[shell] <= whole - 1e-6
    own = np.where(home >= 0, angle[np.arange(len(dots)), home] / width, 0).astype(int).clip(0, SHELLS - 1)
    return home, own, np.stack([rows[v], balls[v]], 1), shell, every


def half_cosine(cosine: float) -> float:
    """Two vectors with this cosine to a third have the given cosine at least."""
    return ((1 + cosine) / 2) ** 0.5 + 1e-9


def fitted(vectors: DataFrame, n: int, dim: int, cosine: float, recall: float, crowd: int):
    """Codebooks of both halves, number of visits, and pivots."""
    k = int(np.clip(round((n / PER_CELL) ** 0.5), 1, MOST_WORDS))
    sample = max(1, min(max(SAMPLE, PER_WORD * k), SAMPLE_NUMBERS // dim))
    share = min(1.0, sample / max(n, 1))
    picked = vectors.filter(F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(1 << 40)) < max(1, int(share * (1 << 40)))).limit(2 * sample)
    rows = picked.select("vec").toArrow()  # at most twice the sample
    points = units(matrix(rows.column("vec").combine_chunks(), dim)) if rows.num_rows else np.eye(1, dim)
    points = points[np.lexsort(points.T)]
    points = points[np.random.default_rng(1).permutation(len(points))]
    half, k = dim // 2, max(1, min(k, len(points) // 4))
    words = (codebook(points[:, :half], k), codebook(points[:, half:], k))
    at = afforded(points, pivots(points, cosine, crowd), cosine)
    return words, visits(points, words, cosine, recall, at), at


def _result(ids: np.ndarray, links: np.ndarray, forest: Forest) -> pa.Table:
    """Rows (node, n, other) of what a task has found."""
    root = forest.roots()
    tied, counted = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(links)
    other = pa.chunked_array([pa.nulls(len(counted), pa.int64()), pa.array(ids[root[tied]], pa.int64())])
    return pa.table({"node": np.concatenate([ids[counted], ids[tied]]), "n": np.concatenate([links[counted], np.zeros(len(tied), np.int64)]), "other": other})


_FOUND = "node bigint, n bigint, other bigint"


def _blocks(rows: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """The rows with their block (by a hash of the node) among the ``parts`` of their group."""
    large = rows.groupBy(*keys).count().filter(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("parts"))
    large, _ = written(large, "imi-large")  # its true size tells whether rows need a shuffle to meet it
    out = rows.join(large, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return out.withColumn(name, F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def cell_links(vectors: DataFrame, n: int, words, m: int, dim: int, cosine: float, most: int) -> DataFrame:
    """Rows (node, n, other): n links more for a class of equal vectors; or, if other is set, a link.

    Cells travel by *spots*: those of one codeword of the first half and of a stretch of
    the second codebook.  A vector goes to each of its spots once, whatever the number of
    its cells there.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(words)
    rows_of_spot, seconds = SPOT * most, len(words[1])
    stretches = int(np.clip(n * m // (len(words[0]) * rows_of_spot), 1, seconds))

    def spot_of(cell):
        """Of arrays and of columns alike: first codeword, then stretch."""
        whole = (lambda x, k: x // k) if isinstance(cell, np.ndarray) else (lambda x, k: F.floor(x / F.lit(k)).cast("bigint"))
        first = whole(cell, seconds)
        return first * stretches + whole((cell - first * seconds) * stretches, seconds)

    def index(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 2_000):
                b = whole.slice(s, 2_000)
                cells = np.sort(traverse(units(matrix(b.column("vec"), dim)), shared.value, m), 1)
                lists = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32), cells.ravel().astype(np.int32))
                yield pa.RecordBatch.from_pydict({"node": b.column("node"), "copies": b.column("copies"), "vec": b.column("vec"), "cells": lists})

    kind = vectors.schema["vec"].dataType.simpleString()
    indexed, _ = written(vectors.mapInArrow(index, f"node bigint, copies bigint, vec {kind}, cells array<int>"), "imi-cells")
    spots = F.array_distinct(F.transform("cells", lambda c: spot_of(c.cast("bigint"))))
    part = _blocks(indexed.withColumn("spot", F.explode(spots)), ["spot"], rows_of_spot, "p")
    spread = part.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.withColumn("lo", F.least("p", "q")).withColumn("hi", F.greatest("p", "q")).drop("q", "parts")

    def compare_cell(cell, lo, hi, x, copies, part, lists):
        """The links of each member, and a forest of them."""
        links, forest = np.zeros(len(x), np.int64), Forest(len(x))
        left = np.arange(len(x)) if lo == hi else np.flatnonzero(part == lo)
        right = left if lo == hi else np.flatnonzero(part == hi)
        # A pair is counted here if it shares no earlier cell.
        early = np.where(lists < cell, lists, -1)
        for s in range(0, len(left), 512):
            a = left[s : s + 512]
            i, j = np.nonzero(x[a] @ x[right].T >= cosine)
            i, j = a[i], right[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            fresh = np.ones(len(i), bool)
            for k in range(0, len(i), 50_000):
                p = slice(k, k + 50_000)
                for c in range(early.shape[1]):
                    fresh[p] &= ~((early[i[p], c, None] == early[j[p]]) & (early[i[p], c, None] >= 0)).any(1)
            i, j = i[fresh], j[fresh]
            links += np.bincount(i, copies[j], len(x)).astype(np.int64) + np.bincount(j, copies[i], len(x)).astype(np.int64)
            forest.join(i, j)
        return links, forest

    def compare(t):
        spot, lo, hi = (t.column(c)[0].as_py() for c in ("spot", "lo", "hi"))
        ids, copies, part = (t.column(c).to_numpy() for c in ("node", "copies", "p"))
        x, lists = units(matrix(t.column("vec").combine_chunks(), dim)), matrix(t.column("cells").combine_chunks(), min(m, len(words[0]) * seconds)).astype(np.int64)
        row, at = np.nonzero(spot_of(lists) == spot)
        cell = lists[row, at]
        order = np.argsort(cell, kind="stable")
        row, cell = row[order], cell[order]
        links, tied = np.zeros(len(ids), np.int64), [np.zeros((2, 0), np.int64)]
        head = np.flatnonzero(np.diff(cell, prepend=-1))
        for a, z in zip(head, np.append(head[1:], len(row)), strict=True):
            if z - a > 1:
                r = row[a:z]
                more, forest = compare_cell(cell[a], lo, hi, x[r], copies[r], part[r], lists[r])
                links[r] += more  # a row is in a cell once
                tied.append(np.stack([r, r[forest.roots()]]))
        forest = Forest(len(ids))
        forest.join(*np.concatenate(tied, 1))
        return _result(ids, links, forest)

    return spread.groupBy("spot", "lo", "hi").applyInArrow(compare, _FOUND)


def ball_links(vectors: DataFrame, at: np.ndarray, dim: int, cosine: float, most: int) -> tuple[DataFrame, DataFrame]:
    """The vectors outside all balls, and rows (node, n, other) of all pairs with a member of a ball."""
    shared = vectors.sparkSession.sparkContext.broadcast(at)

    def place(batches):
        """One row for a vector's own ball (or none), and one for each shell that it visits."""
        for batch in batches:
            for s in range(0, batch.num_rows, 2_000):
                b = batch.slice(s, 2_000)
                raw = matrix(b.column("vec"), dim)
                home, own, v, shell, every = met_shells(units(raw) @ shared.value.T, cosine)
                row = np.concatenate([np.arange(len(raw)), v[:, 0]])
                role = np.concatenate([np.where(home >= 0, 0, 3), np.where(every, 1, 2)])
                yield pa.RecordBatch.from_pydict(
                    {
                        "role": pa.array(role, pa.int32()),
                        "ball": pa.array(np.concatenate([home, v[:, 1]]), pa.int32()),
                        "shell": pa.array(np.concatenate([own, shell]), pa.int32()),
                        "node": b.column("node").take(pa.array(row)),
                        "copies": b.column("copies").take(pa.array(row)),
                        # Those who meet a shell as a whole need no vector.
                        "vec": b.column("vec").take(pa.array(row, mask=role == 1)),
                    }
                )

    kind = vectors.schema["vec"].dataType
    placed, _ = written(vectors.mapInArrow(place, f"role int, ball int, shell int, node bigint, copies bigint, vec {kind.simpleString()}"), "imi-balls", "role")
    member, meets, compares = (placed.filter(F.col("role") == r).drop("role") for r in (0, 1, 2))
    outside = placed.filter("role = 3").select("node", "copies", "vec")
    # At most one row for each pivot and shell: a proven bound for the broadcasts.
    shells, _ = written(member.groupBy("ball", "shell").agg(F.sum("copies").alias("k"), F.min("node").alias("least")), "imi-shells")
    balls = shells.groupBy("ball").agg(F.sum("k").alias("k"), F.min("least").alias("least"))
    none = F.lit(None).cast("bigint")
    link = lambda df, n, other: df.select("node", n.cast("bigint").alias("n"), other.cast("bigint").alias("other"))
    inside = member.join(F.broadcast(balls), "ball")
    met = meets.join(F.broadcast(shells), ["ball", "shell"])
    taken = meets.groupBy("ball", "shell").agg(F.sum("copies").alias("taken"))
    out = link(inside, F.col("k") - F.col("copies"), none).union(link(inside.filter("node > least"), F.lit(0), F.col("least")))
    out = out.union(link(met, F.col("k"), none)).union(link(met, F.lit(0), F.col("least")))
    out = out.union(link(member.join(F.broadcast(taken), ["ball", "shell"]), F.col("taken"), none))

    # What the bounds leave open, in blocks of members against blocks of visitors.
    keys = ["ball", "shell"]
    wanted = compares.join(F.broadcast(shells.select(*keys)), keys, "left_semi")
    asked = _blocks(wanted, keys, most, "y").withColumnRenamed("parts", "y_parts")
    held = member.join(F.broadcast(wanted.select(*keys).distinct()), keys, "left_semi")
    held = _blocks(held, keys, most, "x").withColumnRenamed("parts", "x_parts")
    y_parts = asked.groupBy(*keys).agg(F.max("y_parts").alias("y_parts"))
    x_parts = held.groupBy(*keys).agg(F.max("x_parts").alias("x_parts"))
    column = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    held = held.join(F.broadcast(y_parts), keys).withColumn("y", column("y_parts")).withColumn("visitor", F.lit(False))
    asked = asked.join(F.broadcast(x_parts), keys).withColumn("x", column("x_parts")).withColumn("visitor", F.lit(True))
    names = [*keys, "x", "y", "visitor", "node", "copies", "vec"]

    def compare(t):
        ids, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        visitor = t.column("visitor").to_numpy(zero_copy_only=False).astype(bool)
        x = units(matrix(t.column("vec").combine_chunks(), dim))
        links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        left, right = np.flatnonzero(visitor), np.flatnonzero(~visitor)
        for s in range(0, len(left), 512):
            a = left[s : s + 512]
            i, j = np.nonzero(x[a] @ x[right].T >= cosine)
            i, j = a[i], right[j]
            links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
            forest.join(i, j)
        return _result(ids, links, forest)

    open_ = held.select(*names).union(asked.select(*names)).groupBy(*keys, "x", "y").applyInArrow(compare, _FOUND)
    return outside, out.union(open_)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, recall: float = TARGET_RECALL, most: int = MOST, crowd: int = CROWD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of df."""
    spark = df.sparkSession
    rows, _ = written(usable(df, id_col, vec_col), "imi-vectors")
    # Equal vectors make one class; it is numbered once, in the table that is written.
    classes = rows.filter("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes, _ = written(classes.withColumn("node", F.monotonically_increasing_id()), "imi-classes")
    found = spark.createDataFrame([], _FOUND)
    for r in classes.groupBy(F.size("vec").alias("dim")).count().collect():  # one row for each vector length
        same, dim = classes.filter(F.size("vec") == r["dim"]).select("node", "copies", "vec"), r["dim"]
        words, m, at = fitted(same, r["count"], dim, cosine, recall, crowd)
        if len(at):
            same, part = ball_links(same, at, dim, cosine, most)
            found = found.union(part)
        found = found.union(cell_links(same, r["count"], words, m, dim, cosine, most))
    found, _ = written(found, "imi-links")
    counts = found.filter("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    members = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    told, _ = written(classes.join(counts, "node", "left").join(members, "node", "left").select("vec", "least", "copies", "n", F.coalesce("component", "node").alias("component")), "imi-told")
    of, _ = written(told.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("k")), "imi-components")
    told = spread_join(told, of, "component").select("vec", F.col("copies").alias("k"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    told, _ = written(told.filter("n_links > 0"), "imi-told")
    out = spread_join(rows, told, "vec", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
