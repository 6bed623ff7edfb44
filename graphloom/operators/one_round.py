"""All joins of a pattern in one shuffle.

The images of each pattern vertex are dealt by a hash to its own side of a grid, and each
edge goes once to every cell that its two ends leave open.  A cell then holds all edges
of the embeddings whose vertices fall into it, and no other cell finds these, so it joins
them alone: from one vertex to the next, the shortest list of neighbours gives the
candidates and sorted pairs of the other lists filter them, in blocks of bounded size.
No partial row is ever shuffled or written.

The grid has a side of length 1 where more cells would only copy more.  There are as many
cells as a cell's edges, copies included, need to stay within ``CELL_EDGES`` on average.
Cells of one pattern that so hold copy every edge more often the more edges there are;
beyond ``MOST_COPIES`` there is no grid, and the caller joins vertex by vertex.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that a cell holds on average, and candidates that it looks at at once.
CELL_EDGES, BLOCK = 2_000_000, 1_000_000
#: Copies of an edge on average that a grid may make.
MOST_COPIES = 4


def sides(n_vertices: int, edges: list[tuple[int, int]], sizes: dict[tuple[int, int], int], cells: int) -> list[int]:
    """Lengths of the grid's sides, with at least as many cells, that copy the fewest edges."""
    best, least = [1] * n_vertices, math.inf
    top = max(1, math.ceil(cells ** (1 / 2)))
    options = sorted({1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, top, cells})
    # The sides of a pattern are few; longer ones than the cells asked for are no use.
    for shape in product([x for x in options if x <= cells], repeat=n_vertices) if n_vertices <= 5 else []:
        total = math.prod(shape)
        if cells <= total < 4 * cells:
            copied = sum(sizes[e] * total // (shape[e[0]] * shape[e[1]]) for e in edges)
            if (copied, total) < (least, math.prod(best)) or least == math.inf:
                best, least = list(shape), copied
    if least == math.inf:
        side = max(1, math.ceil(cells ** (1 / n_vertices)))
        best = [side] * n_vertices
    return best


def copies(shape: list[int], edge: tuple[int, int]) -> int:
    return math.prod(shape) // (shape[edge[0]] * shape[edge[1]])


def grid(n_vertices: int, sizes: dict[tuple[int, int], int], cells: int) -> list[int] | None:
    """Sides of a grid with at least so many cells if the bounds on copies allow them, and with no more edges in a cell than it may hold; None where none keeps both bounds."""
    edges, total, best, wanted = sorted(sizes), sum(sizes.values()), None, 1
    while True:
        shape = sides(n_vertices, edges, sizes, wanted)
        copied = sum(sizes[e] * copies(shape, e) for e in edges)
        if copied > MOST_COPIES * total:
            return best
        if copied <= CELL_EDGES * math.prod(shape):
            best = shape
            if math.prod(shape) >= cells:
                return best
        wanted = max(2 * wanted, math.prod(shape))


class _Cell:
    """The edges of one cell, by pattern edge, with vertices as small numbers."""

    def __init__(self, edge: np.ndarray, src: np.ndarray, dst: np.ndarray, edges: list[tuple[int, int]]):
        self.ids, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
        src, dst = both[: len(src)], both[len(src) :]
        n = len(self.ids)
        self.n, self.first, self.list, self.pairs = n, {}, {}, {}
        for k, (u, w) in enumerate(edges):
            mine = edge == k
            for a, b, x, y in ((u, w, src[mine], dst[mine]), (w, u, dst[mine], src[mine])):
                code = np.sort(x * n + y)
                self.pairs[a, b] = code
                self.list[a, b] = code % n
                self.first[a, b] = np.searchsorted(code, np.arange(n + 1) * n)

    def degree(self, a: int, b: int, x: np.ndarray) -> np.ndarray:
        return self.first[a, b][x + 1] - self.first[a, b][x]

    def has(self, a: int, b: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        code, known = x * self.n + y, self.pairs[a, b]
        if not len(known):
            return np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        return known[at] == code

    def grow(self, rows: np.ndarray, order: list[tuple[int, list[int]]], unequal: list[tuple[int, int]]):
        """Blocks of whole rows (columns in the given order of vertices) that begin with these."""
        depth = rows.shape[1]
        if not len(rows):
            return
        if depth == len(order):
            yield rows
            return
        place = {u: k for k, (u, _) in enumerate(order)}
        u, before = order[depth]
        degrees = np.stack([self.degree(b, u, rows[:, place[b]]) for b in before])
        best, size = degrees.argmin(0), degrees.min(0)
        ends = np.cumsum(size)
        at = 0
        while at < len(rows):
            # At least one row, whose list is no longer than the cell's vertices.
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
            out = []
            for k, b in enumerate(before):
                picked = at + np.flatnonzero((best[at:upto] == k) & (size[at:upto] > 0))
                if not len(picked):
                    continue
                n = size[picked]
                start = self.first[b, u][rows[picked, place[b]]]
                new = self.list[b, u][np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)]
                held = np.repeat(rows[picked], n, axis=0)
                keep = np.ones(len(new), bool)
                for other in before:
                    if other != b:
                        keep[keep] = self.has(other, u, held[keep][:, place[other]], new[keep])
                for a, c in unequal:
                    if u in (a, c) and (v := a if c == u else c) in place and place[v] < depth:
                        keep &= held[:, place[v]] != new
                out.append(np.column_stack([held[keep], new[keep]]))
            if out:
                yield from self.grow(np.concatenate(out), order, unequal)
            at = upto


def joined(slices: dict[tuple[int, int], DataFrame], order: list[tuple[int, list[int]]], unequal: list[tuple[int, int]], rows: bool, shape: list[int]) -> DataFrame:
    """Embeddings u0, u1, ... of a pattern with at least one edge, or with rows=False their number by cell (n).

    slices has (u<a>, u<b>) for each pattern edge (a, b); order gives each vertex and its
    neighbours before it.  Whole rows leave a cell in blocks.
    """
    edges, n = sorted(slices), len(order)
    weight = [math.prod(shape[u + 1 :]) for u in range(n)]
    dealt = None
    for k, (a, b) in enumerate(edges):
        # Each end has a place on its side; the other sides are open.
        own = lambda u: F.pmod(F.xxhash64(f"u{u}", F.lit(u)), F.lit(shape[u])) * weight[u]  # noqa: B023, E731
        open_ = [sum(x) for x in product(*[[i * weight[u] for i in range(shape[u])] for u in range(n) if u not in (a, b)])]
        part = slices[a, b].select(F.lit(k).alias("edge"), F.col(f"u{a}").alias("src"), F.col(f"u{b}").alias("dst"), F.explode(F.transform(F.lit(open_).cast("array<bigint>"), lambda x, base=own(a) + own(b): x + base)).alias("cell"))
        dealt = part if dealt is None else dealt.unionByName(part)
    names = [f"u{u}" for u in range(n)]
    place = [next(k for k, (u, _) in enumerate(order) if u == v) for v in range(n)]
    schema = ", ".join(f"{x} bigint" for x in names) if rows else "n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _found(batches, edges, order, unequal, place if rows else None)

    return dealt.groupBy("cell").applyInArrow(run, schema)


def _found(batches, edges: list[tuple[int, int]], order, unequal, place: list[int] | None):
    """A cell's whole rows by block, with the place in the order of u0, u1, ...; without places their number."""
    table = pa.Table.from_batches(list(batches))
    cell = _Cell(table.column("edge").to_numpy(), table.column("src").to_numpy(), table.column("dst").to_numpy(), edges)
    (first, _), (second, _) = order[0], order[1]
    pairs, total = cell.pairs[first, second], 0
    for at in range(0, len(pairs), BLOCK):
        code = pairs[at : at + BLOCK]
        for block in cell.grow(np.column_stack([code // cell.n, code % cell.n]), order, unequal):
            total += len(block)
            if place is not None:
                yield pa.RecordBatch.from_arrays([pa.array(cell.ids[block[:, k]]) for k in place], [f"u{u}" for u in range(len(place))])
    if place is None:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])
