"""Structure of patterns: orders, cores, nuclei and components of at most a few vertices."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from itertools import combinations

Adjacency = dict[int, set[int]]


def degeneracy_order(adj: Adjacency) -> list[int]:
    """Vertices by repeated removal of one of least remaining degree, lowest id first."""
    left, out = {u: set(n) for u, n in adj.items()}, []
    while left:
        u = min(left, key=lambda v: (len(left[v]), v))
        for w in left.pop(u):
            left[w].discard(u)
        out.append(u)
    return out


def bfs_order(adj: Adjacency, start: int) -> list[int]:
    seen, queue, out = {start}, deque([start]), []
    while queue:
        out.append(u := queue.popleft())
        for w in sorted(adj[u] - seen):
            seen.add(w)
            queue.append(w)
    return out


def k_core(adj: Adjacency, k: int) -> set[int]:
    """The vertices left when those of degree below k are removed again and again."""
    left = {u: set(n) for u, n in adj.items()}
    while low := [u for u, n in left.items() if len(n) < k]:
        for u in low:
            for w in left.pop(u):
                if w in left:
                    left[w].discard(u)
    return set(left)


def components(adj: Adjacency, within: set[int]) -> list[set[int]]:
    out, left = [], set(within)
    while left:
        part, todo = set(), [min(left)]
        while todo:
            u = todo.pop()
            if u not in part:
                part.add(u)
                todo += (adj[u] & left) - part
        out.append(part)
        left -= part
    return out


def cliques(adj: Adjacency, size: int) -> list[tuple[int, ...]]:
    return [c for c in combinations(sorted(adj), size) if all(b in adj[a] for a, b in combinations(c, 2))]


@dataclass(frozen=True)
class Nucleus:
    k: int
    vertices: frozenset[int]
    n_edges: int
    parent: int | None  # number of the nucleus around it

    @property
    def density(self) -> float:
        n = len(self.vertices)
        return 2 * self.n_edges / (n * (n - 1)) if n > 1 else 0.0


def nuclei(adj: Adjacency, r: int, s: int) -> list[Nucleus]:
    """The (r, s) nuclei: (1, 2) gives cores, (2, 3) trusses, (3, 4) the K4-based nuclei.

    Every r-clique has the largest k at which peeling keeps it in at least k s-cliques;
    cliques of k or more that are joined through such s-cliques form a nucleus.
    """
    if (r, s) not in ((1, 2), (2, 3), (3, 4)):
        raise ValueError("(r, s) must be (1, 2), (2, 3) or (3, 4)")
    big = [set(combinations(c, r)) for c in cliques(adj, s)]
    number = dict.fromkeys(cliques(adj, r), 0)
    left, alive, k = set(number), list(big), 0
    while left:
        support = {c: sum(c in b for b in alive) for c in left}
        c = min(left, key=lambda x: (support[x], x))
        k = max(k, support[c])
        number[c] = k
        left.discard(c)
        alive = [b for b in alive if c not in b]
    out: list[Nucleus] = []
    for level in range(1, max(number.values(), default=0) + 1):
        held = [b for b in big if all(number[c] >= level for c in b)]
        while held:
            part = held.pop()
            while joined := [b for b in held if b & part]:
                part = part.union(*joined)
                held = [b for b in held if b not in joined]
            if level < max(number[c] for c in part) and all(number[c] > level for c in part):
                continue  # the same nucleus returns at a higher level
            vertices = frozenset(v for c in part for v in c)
            edges = {e for c in part for e in combinations(sorted(c), 2)} if r > 1 else {e for e in combinations(sorted(vertices), 2) if e[1] in adj[e[0]]}
            around = [i for i, n in enumerate(out) if vertices <= n.vertices and n.k < level]
            out.append(Nucleus(level, vertices, len(edges), max(around, key=lambda i: out[i].k, default=None)))
    return out


def nuclei_rows(adj: Adjacency, r: int, s: int) -> list[tuple]:
    """(id, parent, k, r, s, n_vertices, n_edges, density) of every nucleus of a pattern."""
    return [(i, n.parent, n.k, r, s, len(n.vertices), n.n_edges, n.density) for i, n in enumerate(nuclei(adj, r, s))]


def densest_core(adj: Adjacency) -> set[int]:
    """Where matching starts: the densest (3, 4) nucleus, else a triangle, else an edge, of greatest degree sum."""
    best = max(nuclei(adj, 3, 4), key=lambda n: (n.density, len(n.vertices), -min(n.vertices)), default=None)
    if best:
        return set(best.vertices)
    for size in (3, 2):
        if found := cliques(adj, size):
            return set(max(found, key=lambda c: (sum(len(adj[u]) for u in c), [-u for u in c])))
    return set(adj)
