"""Embeddings of patterns: injective, label-preserving, not induced, every automorphic image counted.

The edges are written once, in a folder for each pair of labels or, where candidates
are filtered, for each pattern edge, so each join reads only its own slice and Spark
knows the slice's true size.  Embeddings grow by
one pattern vertex for each step.  A vertex with one neighbour before it comes from that
neighbour's list.  Where there are more, either the shortest list gives the vertex and
the other edges filter, or the lists of two neighbours are joined to wedges first, which
meet the rows on both columns at once; whichever is expected to hold fewer rows.
Inequality is tested between vertices of equal label that have no edge, all others
differ anyway.  Where a list is long enough to make its vertex a hub, the join on it is
cut in a grid of rows against pieces of lists.

Counting first folds trees away: a leaf whose label no other vertex has cannot collide,
so it multiplies what it hangs on by the length of its list, and need not be joined.
Leaves of one label that hang on the same vertex collide only with each other, so what
they multiply it by comes from sums over the list, by inclusion and exclusion.
A part that hangs on one vertex and shares no label with the rest cannot collide with it
either: it is counted by that vertex's image, and its rows never multiply with others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import filtering, one_round
from graphloom.operators.hubs import grid_join
from graphloom.operators.primitives import Ordered
from graphloom.plans.pattern import Pattern
from graphloom.plans.planner import MatchPlan, Stats, plan
from graphloom.sources.graphs import PropertyGraph
from graphloom.sources.shared import exists, remove, written


#: Filtering is worth its passes over the edges if the joins are expected to exceed them so many times.
LIGHT = 8
#: One shuffle of copied edges is worth it if the chain's rows are expected to exceed them so many times.
ONE_ROUND = 2
#: Leaves of one label on the same vertex that are folded together; their sums grow as 2 to this.
TWINS = 5
#: Pairs at a key on average beyond which a join is cut in grids, be its lists short: few keys would leave most tasks idle.
MOST_PAIRS = 100_000
#: Jobs that batches are written by, at most.
BATCH_JOBS = 16
#: Rows whose fan-out is looked at before the next vertex is chosen.
FAN_SAMPLE = 10_000


@dataclass(frozen=True)
class Options:
    method: str = "BFS-DFS"
    refine: bool = True
    refine_rounds: int = 1
    refine_start: int | None = None  # only ever an order of pruning; the result is the same
    adaptive: bool = True
    #: By neighbour labels: True, False, or None to filter where the joins are expected to grow large.
    filter: bool | None = None
    fold: bool = True  # trees, when counting
    #: All joins in one shuffle: True (where a grid can hold the edges), False, or None where the chain is expected to hold so many more rows.
    one_round: bool | None = None
    #: Choose each vertex after the rows before it are written, by their true fan-out.
    replan: bool = False
    #: Lists longer than this make their vertex a hub: joins on it are cut in grids, as are those with more than MOST_PAIRS expected at a key.  None: never.
    hubs: int | None = 1_000_000


class Match:
    """Embeddings of a pattern in a graph; filters and plans when first asked for."""

    def __init__(self, graph: PropertyGraph, pattern: Pattern, options: Options = Options()):
        self.graph, self.pattern, self.options = graph, pattern, options
        self._relevant: DataFrame | None = None
        self._edges: DataFrame | None = None
        self._plan: MatchPlan | None = None
        self._stats = Stats()
        self._longest: dict[tuple[int, int], int] = {}
        self._apart: list[tuple[set[int], DataFrame]] | None = None

    def _prepare(self) -> None:
        """Writes the relevant edges, and the filtered ones if filtering promises to pay."""
        if self._plan is not None:
            return
        o, p = self.options, self.pattern
        # One direction is enough for ends of different labels.
        relevant = filtering.relevant_edges(self.graph, p).filter("ls <= ld").select("src", "dst", "ls", "ld")
        self._relevant, _ = written(relevant, "relevant-edges", "ls", "ld")
        self._stats = self._label_stats()
        self._plan = plan(p, self._stats, o.method, o.adaptive)
        if o.filter if o.filter is not None else self._expected() > LIGHT * sum(self._stats.pairs.values()):
            back = self._relevant.filter("ls < ld").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("ld").alias("ls"), F.col("ls").alias("ld"))
            both = PropertyGraph(self.graph.vertices, self._relevant.select("src", "dst"), self._relevant.select("src", "dst", "ls", "ld").union(back))
            self._edges = filtering.matching_edges(both, p, o.refine_rounds if o.refine else 0)
            self._stats = filtering.collected_stats(self._edges)
            self._plan = plan(p, self._stats, o.method, o.adaptive)

    def _label_stats(self) -> Stats:
        """Sizes of each pattern edge's relation by the labels of its ends."""
        out, found = Stats(), {}
        sizes = self._relevant.groupBy("ls", "ld").agg(F.count("*").alias("n"), F.approx_count_distinct("src").alias("s"), F.approx_count_distinct("dst").alias("d"))
        for r in sizes.collect():  # one row for each pair of the pattern's labels
            found[r["ls"], r["ld"]] = (r["n"], r["s"])
            found[r["ld"], r["ls"]] = (r["n"], r["d"])
        for _, u, w in self.pattern.directed():
            out.pairs[u, w], out.keys[u, w] = found.get((self.pattern.labels[u], self.pattern.labels[w]), (0, 0))
        return out

    def _steps(self, order: list[tuple[int, list[int]]]):
        """(vertex, neighbour whose list gives it, second neighbour of a wedge or None, other neighbours, pairs at a key of the join, rows held at most)."""
        stats, p = self._stats, self.pattern
        rows = stats.size(order[0][0], p) if order else 0
        for u, before in order[1:]:
            best, *others = sorted(before, key=lambda b: (stats.list_size(b, u), b))
            held, second = rows * stats.list_size(best, u), None
            at_key = held / max(1, stats.keys.get((best, u), 1))
            if others:
                # Pairs of an image of b and one of c that share an image of u.
                wedges = {(b, c): stats.pairs.get((b, u), 0) * stats.list_size(u, c) for b in before for c in before if b < c}
                pair = min(wedges, key=lambda bc: (wedges[bc], bc))
                if wedges[pair] < held:
                    held, (best, second) = wedges[pair], pair
                    at_key = held / max(1, stats.keys.get((u, best), 1))
                    others = [b for b in before if b not in pair]
            rows *= stats.list_size(best, u)
            for b in before:
                if b != best:
                    rows *= stats.list_size(b, u) / max(1, stats.size(u, p))
            yield u, best, second, others, at_key, max(held, rows)

    def _expected(self) -> float:
        """The most rows that the join chain is expected to hold, edges taken as independent."""
        return max((held for *_, held in self._steps(self._plan.backward())), default=1.0)

    @property
    def plan(self) -> MatchPlan:
        self._prepare()
        return self._plan

    def explain(self) -> str:
        return self.plan.explain()

    def slice(self, u: int, w: int) -> DataFrame:
        """(u<u>, u<w>): images of one pattern edge."""
        self._prepare()
        if self._edges is not None:
            qe = sorted(self.pattern.edges).index((min(u, w), max(u, w)))
            ends = ("src", "dst") if u < w else ("dst", "src")
            return self._edges.filter(F.col("qe") == qe).select(F.col(ends[0]).alias(f"u{u}"), F.col(ends[1]).alias(f"u{w}"))
        a, b = self.pattern.labels[u], self.pattern.labels[w]
        e = self._relevant.filter((F.col("ls") == min(a, b)) & (F.col("ld") == max(a, b)))
        ends = ("src", "dst") if a <= b else ("dst", "src")
        return e.select(F.col(ends[0]).alias(f"u{u}"), F.col(ends[1]).alias(f"u{w}"))

    def _joined(self, order: list[tuple[int, list[int]]], weights: dict[int, DataFrame], start_rows: DataFrame | None = None) -> DataFrame:
        """Rows over the ordered vertices, with a column f<u> for each folded weight; start_rows (u<start>) restricts where they begin."""
        self._prepare()
        start = order[0][0]
        out, placed = start_rows, {start}
        for step in self._steps(order):
            out = self._extended(out, placed, *step[:5])
        if out is None:
            if start in weights:
                return weights[start]
            return self._starts(start)
        for u, w in weights.items():
            out = out.join(w, f"u{u}")
        return out

    def _starts(self, start: int) -> DataFrame:
        """(u<start>): its candidates."""
        cand = filtering.candidates(self.graph, self.pattern)
        return cand.filter(F.col("u") == start).select(F.col("v").alias(f"u{start}"))

    def _extended(self, out: DataFrame | None, placed: set[int], u: int, best: int, second: int | None, others: list[int], at_key: float) -> DataFrame:
        """The rows with an image of u, which is then placed."""
        step, most = self.slice(best, u), self.options.hubs
        heavy = most is not None and at_key > MOST_PAIRS
        least = min(most, MOST_PAIRS) if heavy else most
        if second is not None:
            other = self.slice(second, u)
            hub = heavy or (self._has_hub(u, best) and self._has_hub(u, second))
            wedges = grid_join(step, other, f"u{u}", least) if hub else step.join(other, f"u{u}")
            out = out.join(wedges, [f"u{best}", f"u{second}"])
        elif out is None:
            out = step
        elif heavy or self._has_hub(best, u):
            # The true number of rows at each hub decides how they are cut.
            out = grid_join(written(out, "hub-rows")[0], step, f"u{best}", least)
        else:
            out = out.join(step, f"u{best}")
        for b in others:
            out = out.join(self.slice(b, u), [f"u{b}", f"u{u}"], "left_semi")
        for a, b in self.pattern.same_label_pairs():
            if u in (a, b) and (a if b == u else b) in placed:
                out = out.filter(F.col(f"u{a}") != F.col(f"u{b}"))
        placed.add(u)
        return out

    def _has_hub(self, u: int, w: int) -> bool:
        """Whether an image of u has so long a list of images of w that it is a hub; asked of the data only where there are enough edges for one."""
        most = self.options.hubs
        if most is None or self._stats.pairs.get((u, w), 0) <= most:
            return False
        if (u, w) not in self._longest:
            lists = self.slice(u, w).groupBy(f"u{u}").agg(F.count("*").alias("n"))
            self._longest[u, w] = lists.agg(F.max("n")).first()[0] or 0
        return self._longest[u, w] > most

    def _replanned(self, start: int, inside: set[int]) -> DataFrame:
        """All embeddings of the pattern's vertices inside, which hang together; the next vertex is that of the least true fan-out of the rows so far, by a sample of them.

        Rows are written after each vertex, so none is joined twice and the size is known.
        """
        p = self.pattern
        placed, order, out, path, n = {start}, [(start, [])], None, None, 0
        while placed < inside:
            ready = sorted(u for u in inside - placed if p.neighbours(u) & placed)
            steps = {u: list(self._steps([*order, (u, sorted(p.neighbours(u) & placed))]))[-1][:5] for u in ready}
            if out is None:
                u = min(ready, key=lambda w: (self._stats.pairs.get((start, w), 0), w))
            elif len(ready) == 1 or not n:
                u = ready[0]
            else:
                some, some_path = written(out.sample(min(1.0, FAN_SAMPLE / n), seed=n), "sampled-rows")
                counts = [self._extended(some, set(placed), *steps[w]).agg(F.count("*").alias("n")).select(F.lit(w).alias("u"), "n") for w in ready]
                fan = {r["u"]: r["n"] for r in reduce(DataFrame.union, counts).collect()}  # one row for each vertex that may be next
                remove(some.sparkSession, some_path)
                u = min(ready, key=lambda w: (fan[w], w))
            order.append((u, sorted(p.neighbours(u) & placed)))
            (out, next_path), old = written(self._extended(out, placed, *steps[u]), "partial-rows"), path
            if old:
                remove(out.sparkSession, old)
            path, n = next_path, out.count()
            self.sizes.append((u, n))
        return self._starts(start) if out is None else out

    def _rows_apart(self, order) -> list[tuple[set[int], DataFrame]]:
        """(vertices, rows, written) of the parts that one vertex joins, two of which at least have a ring; none where no vertex does.

        The vertex is in all of them, so the rows of the pattern are their rows joined on
        its image, and none of a part's rows is made anew for each row of the others.
        """
        if self._apart is None:
            self._apart, p = [], self.pattern
            for b in range(len(p)):
                parts, rest = [], set(range(len(p))) - {b}
                while rest:
                    inside, todo = set(), [min(rest)]
                    while todo:
                        inside.add(u := todo.pop())
                        todo += p.neighbours(u) - inside - {b}
                    rest -= inside
                    parts.append(inside | {b})
                if sum(sum(a in x and c in x for a, c in p.edges) >= len(x) for x in parts) > 1:
                    break
            else:
                return self._apart
            for x in parts:
                own = [u for u, _ in order if u in x]
                steps = [(u, [w for w in own[:k] if w in p.neighbours(u)]) for k, u in enumerate(own)]
                self._apart.append((x, written(self._joined(steps, {}), "part-rows")[0]))
        return self._apart

    def rows(self, limit: int | None = None) -> DataFrame:
        """One row u0, u1, ... for each embedding; ``limit`` is a cut on request only."""
        order = self.plan.backward()
        if self.options.replan:
            self.sizes: list[tuple[int, int]] = []
            out = self._replanned(order[0][0], set(range(len(self.pattern)))).select(*[f"u{u}" for u in range(len(self.pattern))])
        elif self._in_one_round(order, {}):
            out = self._one_round(order, rows=True)
        else:
            out = self._joined(order, {}).select(*[f"u{u}" for u in range(len(self.pattern))])
        return out if limit is None else out.limit(limit)

    def count(self) -> DataFrame:
        """One row: matches."""
        if self.options.replan:
            return self._replanned_count()
        order, weights = self.plan.backward(), {}
        if self.options.fold:
            order, weights = self._folded(order)
        if self._in_one_round(order, weights):
            return self._one_round(order, rows=False).agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("matches"))
        return self._total(self._joined(order, weights), weights)

    def _replanned_count(self) -> DataFrame:
        """The count by true fan-outs.  A part of several vertices that hangs on one and shares no label with the rest is counted by that vertex, so its rows never multiply with others."""
        self.sizes = []
        left, weights = {u: self.pattern.neighbours(u) for u in range(len(self.pattern))}, {}
        start = self.plan.backward()[0][0]
        while self.options.fold and (part := self._hanging(left, 2)) is not None:
            b, inside = part
            rows, own = self._replanned(b, inside | {b}), {u: weights.pop(u) for u in inside & set(weights)}
            for u, w in own.items():
                rows = rows.join(w, f"u{u}")
            sums, _ = written(rows.groupBy(f"u{b}").agg(F.sum(self._product(own)).alias("n")), "hanging-sums")
            weights[b] = self._times(weights.get(b), sums, b)
            start = b if start in inside else start
            for u in inside:
                del left[u]
            left[b] = left[b] - inside
        out = self._replanned(start, set(left))
        for u, w in weights.items():
            out = out.join(w, f"u{u}")
        return self._total(out, weights)

    def _in_one_round(self, order, weights) -> bool:
        """Whether all joins go in one shuffle; trees are folded instead, and two vertices need no grid."""
        if weights or len(order) < 3 or len(order) < len(self.pattern) or self.options.one_round is False:
            return False
        shape = self._grid()
        if shape is None or self.options.one_round:
            return shape is not None
        if len(self.pattern.edges) < len(self.pattern):
            return False  # in a tree hardly a row is dropped, so the chain holds little but results, which few cells would list alone
        copied = sum(n * one_round.copies(shape, e) for e, n in self._sizes().items())
        return max((held for *_, held in self._steps(order)), default=0) > ONE_ROUND * copied

    def _sizes(self) -> dict[tuple[int, int], int]:
        return {e: self._stats.pairs.get(e, 0) for e in self.pattern.edges}

    def _grid(self) -> list[int] | None:
        return one_round.grid(len(self.pattern), self._sizes(), int(self.graph.vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def _one_round(self, order, rows: bool) -> DataFrame:
        slices = {(a, b): self.slice(a, b) for a, b in self.pattern.edges}
        return one_round.joined(slices, order, self.pattern.same_label_pairs(), rows, self._grid())

    def partial_counts(self) -> DataFrame:
        """(group, vertices, rows): partial embeddings after each group of the plan; statistics on request.

        A group's rows are written and the next group goes on from them, so no prefix is
        joined twice, and a task that runs again counts nothing twice.
        """
        order, counts = self.plan.backward(), []
        steps, out, path = list(self._steps(order)), None, None
        placed = {order[0][0]}
        for k, group in enumerate(self.plan.groups):
            done = sum(map(len, self.plan.groups[:k]))
            if done == 0 and len(group) == 1:
                counts.append((k, 1, self._starts(group[0]).count()))
                continue
            for step in steps[max(done, 1) - 1 : done + len(group) - 1]:
                out = self._extended(out, placed, *step[:5])
            (out, next_path), old = written(out, "partial-rows"), path
            if old:
                remove(out.sparkSession, old)
            path = next_path
            counts.append((k, done + len(group), out.count()))
        return self.graph.vertices.sparkSession.createDataFrame(counts, "group int, vertices int, rows bigint")

    def rows_in_batches(self, path: str, budget: int) -> DataFrame:
        """The same rows as ``rows()``, written to path batch by batch; a stopped run goes on where it ended.

        Start vertices are cut, in order, into batches whose rows are expected to stay
        within budget (a vertex that is expected to exceed it alone has a batch of its
        own).  The cut is written first and read again by a later run.  Where there are more
        than BATCH_JOBS batches, some side by side are written by one job; its batches are
        there when its folder is whole.
        """
        spark, order = self.graph.vertices.sparkSession, self.plan.backward()
        start = order[0][0]
        table = f"{path}/batches"
        if not exists(spark, f"{table}/_SUCCESS"):
            u = order[1][0] if len(order) > 1 else start
            lists = self.slice(start, u).groupBy(f"u{start}").agg(F.count("*").alias("n")) if u != start else self._starts(start).withColumn("n", F.lit(1).cast("bigint"))
            # What a first edge is expected to grow to, at most, in the steps after it.
            growth = max(1.0, self._expected() / max(1, self._stats.pairs.get((start, u), 1)))
            weight = (F.col("n") * growth).cast("bigint") + 1
            Ordered(lists, f"u{start}").scan(weight, "upto").select(f"u{start}", F.floor((F.col("upto") - 1) / budget).cast("bigint").alias("batch")).write.mode("overwrite").parquet(table)
        cut = spark.read.parquet(table)
        # Every job reads the edges anew, so batches share jobs where there are many; the cut alone decides which, for later runs.
        most = cut.agg(F.max("batch")).first()[0] or 0
        jobs = F.floor(F.col("batch") / (1 + most // BATCH_JOBS))
        for r in cut.select(jobs.alias("job")).distinct().orderBy("job").toLocalIterator():
            target = f"{path}/rows/job={r['job']}"
            if not exists(spark, f"{target}/_SUCCESS"):
                self._batch(order, cut.filter(jobs == r["job"]).select(f"u{start}")).write.mode("overwrite").parquet(target)
        names = [f"u{u}" for u in range(len(self.pattern))]
        return spark.read.schema(", ".join(f"{x} bigint" for x in names)).parquet(f"{path}/rows").select(*names) if exists(spark, f"{path}/rows") else self.rows().limit(0)

    def _batch(self, order, starts: DataFrame) -> DataFrame:
        names, start = [f"u{u}" for u in range(len(self.pattern))], order[0][0]
        parts = sorted(self._rows_apart(order), key=lambda x: start not in x[0])
        if not parts:
            return self._joined(order, {}, starts).select(*names)
        (placed, rows), *others = parts
        out = starts.join(rows, f"u{start}")
        for inside, rows in others:
            out = out.join(rows, [f"u{u}" for u in inside & placed])
            for a, b in self.pattern.same_label_pairs():
                if a in placed | inside and b in placed | inside and not {a, b} <= placed and not {a, b} <= inside:
                    out = out.filter(F.col(f"u{a}") != F.col(f"u{b}"))
            placed = placed | inside
        return out.select(*names)

    def _total(self, out: DataFrame, weights) -> DataFrame:
        return out.agg(F.coalesce(F.sum(self._product(weights)), F.lit(0).cast("bigint")).alias("matches"))

    def _product(self, weights):
        return reduce(lambda x, u: x * F.col(f"f{u}"), weights, F.lit(1).cast("bigint"))

    def _times(self, weight: DataFrame | None, sums: DataFrame, b: int) -> DataFrame:
        """(u<b>, f<b>): a weight, where there is one, times sums(u<b>, n)."""
        if weight is None:
            return sums.select(f"u{b}", F.col("n").alias(f"f{b}"))
        return weight.join(sums, f"u{b}").select(f"u{b}", (F.col(f"f{b}") * F.col("n")).alias(f"f{b}"))

    def _hanging(self, left: dict[int, set[int]], least: int = 1) -> tuple[int, set[int]] | None:
        """A vertex and the least of the parts, of so many vertices at least, that hang on it alone and share no label with what else is left."""
        found, labels = [], self.pattern.labels
        for b in sorted(left):
            rest = set(left) - {b}
            while rest:
                inside, todo = set(), [min(rest)]
                while todo:
                    inside.add(u := todo.pop())
                    todo += left[u] - inside - {b}
                rest -= inside
                others = set(left) - inside
                if len(inside) >= least and len(others) > 1 and not {labels[u] for u in inside} & {labels[u] for u in others}:
                    found.append((len(inside), b, sorted(inside)))
        return (min(found)[1], set(min(found)[2])) if found else None

    def _folded(self, order):
        """The order without leaves of unique label and parts that share no label, and for what they hung on (u<u>, f<u>)."""
        p, weights = self.pattern, {}
        left = {u: p.neighbours(u) for u in range(len(p))}
        while len(left) > 1:
            leaf = next((u for u, _ in reversed(order) if u in left and len(left[u]) == 1 and p.labels.count(p.labels[u]) == 1), None)
            twins = [leaf] if leaf is not None else self._twins(left)
            if not twins:
                break
            (b,) = left[twins[0]]
            for u in twins:
                del left[u]
            left[b] = left[b] - set(twins)
            sums = self._leaf_sums(b, twins, weights)
            weights[b] = self._times(weights.get(b), sums, b)
        while (part := self._hanging(left)) is not None:
            b, inside = part
            own = [u for u, _ in order if u in inside or u == b]
            factors = {u: weights.pop(u) for u in own if u != b and u in weights}
            rows = self._joined([(u, [w for w in own[:k] if w in left[u]]) for k, u in enumerate(own)], factors)
            sums = rows.groupBy(f"u{b}").agg(F.sum(self._product(factors)).alias("n"))
            weights[b] = self._times(weights.get(b), sums, b)
            for u in inside:
                del left[u]
            left[b] = left[b] - inside
        kept = [u for u, _ in order if u in left]
        if kept and kept[0] != order[0][0]:
            # The start was folded away: begin at what is left, each after a neighbour.
            todo, kept = set(left), []
            while todo:
                u = next(u for u in sorted(todo) if not kept or left[u] & set(kept))
                kept.append(u)
                todo.discard(u)
        return [(u, [w for w in kept[:k] if w in left[u]]) for k, u in enumerate(kept)], weights

    def _twins(self, left: dict[int, set[int]]) -> list[int]:
        """Leaves that hang on one vertex and are all that the pattern has of their label."""
        labels = self.pattern.labels
        for label in sorted(set(labels)):
            same = [u for u in range(len(labels)) if labels[u] == label]
            hold = {b for u in same for b in left.get(u, ())}
            if 1 < len(same) <= TWINS and all(len(left.get(u, ())) == 1 for u in same) and len(hold) == 1 and not hold & set(same):
                return same
        return []

    def _leaf_sums(self, b: int, leaves: list[int], weights: dict[int, DataFrame]) -> DataFrame:
        """(u<b>, n): in how many ways the leaves take different images beside an image of b, times their weights."""
        if len(leaves) == 1 and leaves[0] in weights:
            (leaf,) = leaves
            return self.slice(b, leaf).join(weights.pop(leaf), f"u{leaf}").groupBy(f"u{b}").agg(F.sum(f"f{leaf}").alias("n"))
        if len(leaves) == 1 or (self._edges is None and not set(leaves) & set(weights)):
            # Without weights, all choose from one list.
            lists = self.slice(b, leaves[0]).groupBy(f"u{b}").agg(F.count("*").alias("n"))
            ways = reduce(lambda a, k: a * (F.col("n") - k), range(1, len(leaves)), F.col("n"))
            return lists.filter(F.col("n") >= len(leaves)).select(f"u{b}", ways.alias("n"))
        parts = []
        for k, leaf in enumerate(leaves):
            list_, own = self.slice(b, leaf), F.lit(1)
            if leaf in weights:
                list_, own = list_.join(weights.pop(leaf), f"u{leaf}"), F.col(f"f{leaf}")
            parts.append(list_.select(f"u{b}", F.col(f"u{leaf}").alias("v"), *[(own if j == k else F.lit(0)).cast("bigint").alias(f"w{j}") for j in range(len(leaves))]))
        each = reduce(DataFrame.union, parts).groupBy(f"u{b}", "v").agg(*[F.sum(f"w{j}").alias(f"w{j}") for j in range(len(leaves))])
        name = lambda block: "s" + "_".join(map(str, block))
        blocks = [c for k in range(1, len(leaves) + 1) for c in combinations(range(len(leaves)), k)]
        sums = each.groupBy(f"u{b}").agg(*[F.sum(reduce(lambda x, y: x * y, [F.col(f"w{j}") for j in c])).alias(name(c)) for c in blocks])
        ways = F.lit(0).cast("bigint")
        for parting in _partings(list(range(len(leaves)))):
            sign = math.prod((-1) ** (len(c) - 1) * math.factorial(len(c) - 1) for c in parting)
            ways = ways + reduce(lambda x, y: x * y, [F.col(name(c)) for c in parting], F.lit(sign).cast("bigint"))
        return sums.select(f"u{b}", ways.alias("n")).filter("n > 0")


def _partings(items: list[int]):
    """All ways to part the items into blocks, each in ascending order."""
    if not items:
        yield []
        return
    first, rest = items[0], items[1:]
    for k in range(len(rest) + 1):
        for beside in combinations(rest, k):
            for others in _partings([x for x in rest if x not in beside]):
                yield [(first, *beside), *others]


def match(graph: PropertyGraph, pattern: Pattern, **options) -> Match:
    return Match(graph, pattern, Options(**options))
