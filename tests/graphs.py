"""Random graphs and brute-force answers."""

import random
from itertools import combinations, permutations

from graphloom.plans.pattern import Pattern
from graphloom.sources.graphs import from_tables


def random_graph(seed, n=9, p=0.45, labels=3):
    rng = random.Random(seed)
    return {v: rng.randrange(labels) for v in range(n)}, {e for e in combinations(range(n), 2) if rng.random() < p}


def random_pattern(seed, n=4, labels=3):
    rng = random.Random(seed)
    edges = {(rng.randrange(k), k) for k in range(1, n)} | {e for e in combinations(range(n), 2) if rng.random() < 0.3}
    return Pattern([rng.randrange(labels) for _ in range(n)], edges)


def frames(spark, graph):
    labels, edges = graph
    v = spark.createDataFrame(sorted(labels.items()), "id bigint, label bigint")
    return from_tables(v, spark.createDataFrame(sorted(edges), "src bigint, dst bigint"))


def embeddings(graph, pattern):
    labels, edges = graph
    both = edges | {(b, a) for a, b in edges}
    return sorted(m for m in permutations(labels, len(pattern)) if all(labels[v] == x for v, x in zip(m, pattern.labels, strict=True)) and all((m[a], m[b]) in both for a, b in pattern.edges))
