"""Query patterns: small connected undirected graphs with vertex labels."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

MOST_VERTICES, MOST_EDGES = 16, 32


@dataclass(frozen=True)
class Pattern:
    """labels[u] is the label of vertex u; edges are unordered pairs of vertices."""

    labels: tuple[int, ...]
    edges: tuple[tuple[int, int], ...]

    def __init__(self, labels, edges, most_vertices: int = MOST_VERTICES, most_edges: int = MOST_EDGES):
        labels = tuple(int(x) for x in labels)
        pairs = {(min(a, b), max(a, b)) for a, b in edges}
        if not labels:
            raise ValueError("a pattern needs a vertex")
        if any(a == b or a < 0 or b >= len(labels) for a, b in pairs):
            raise ValueError("edges must join two different vertices of the pattern")
        if len(labels) > most_vertices or len(pairs) > most_edges:
            raise ValueError(f"a pattern has at most {most_vertices} vertices and {most_edges} edges")
        object.__setattr__(self, "labels", labels)
        object.__setattr__(self, "edges", tuple(sorted(pairs)))
        seen, todo = {0}, [0]
        while todo:
            new = self.neighbours(todo.pop()) - seen
            seen |= new
            todo += new
        if len(seen) < len(labels):
            raise ValueError("a pattern must be connected")

    def __len__(self) -> int:
        return len(self.labels)

    def neighbours(self, u: int) -> set[int]:
        return {b if a == u else a for a, b in self.edges if u in (a, b)}

    def degree(self, u: int) -> int:
        return len(self.neighbours(u))

    def directed(self) -> list[tuple[int, int, int]]:
        """(number, u, w) of each directed edge, by ascending (u, w)."""
        both = sorted({*self.edges, *((b, a) for a, b in self.edges)})
        return [(k, u, w) for k, (u, w) in enumerate(both)]

    def label_needs(self) -> list[tuple[int, int, int, int]]:
        """(u, its label, label of neighbours, how many of them u has)."""
        return [(u, self.labels[u], label, n) for u in range(len(self)) for label, n in sorted(Counter(self.labels[w] for w in self.neighbours(u)).items())]

    def same_label_pairs(self) -> list[tuple[int, int]]:
        """Pairs whose images could coincide: no edge, which the graph has no loop for, but one label."""
        return [(a, b) for a, b in combinations(range(len(self)), 2) if self.labels[a] == self.labels[b] and (a, b) not in self.edges]

    def adjacency(self) -> dict[int, set[int]]:
        return {u: self.neighbours(u) for u in range(len(self))}
