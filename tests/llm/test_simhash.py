import random

import numpy as np
import pytest
import xxhash

from graphloom.llm import simhash
from tests.llm.conftest import words


def slow_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, radius=4):
    prints = [(i, slow_print(t)) for i, t in rows]
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(prints):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, p, least[find(k)]) for k, (i, p) in enumerate(prints)), key=repr)


def result(df, **how):
    return sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df, **how).collect()), key=repr)


def test_fingerprint_matches_definition():
    for t in ["", "a", "A b C", "a b c d", "a b c d e a b c d e", "é ü ß x y z", "x" * 5000]:
        assert simhash.fingerprint(t.encode()) == slow_print(t)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    texts = [words(rng, 300) for _ in range(30)]
    for k in range(60):  # near copies: a few words changed
        w = texts[k % 12].split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"new{k}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert result(df) == slow_components(rows)
    # Small shards and parts take the paths of large inputs.
    assert result(df, leaf=4, most=8) == slow_components(rows)


def test_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert result(odd_docs) == slow_components(rows)


def test_empty_table(no_docs):
    assert result(no_docs) == []


def test_drop_keeps_columns_and_one_of_each(odd_docs):
    out = simhash.drop_near_duplicates(odd_docs)
    assert out.columns == odd_docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert 0 in kept and 2 not in kept and 11 not in kept


@pytest.mark.parametrize("leaf", [3, 50])
def test_trees_let_every_near_pair_meet(leaf):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
    points = []
    for b in base:
        points.append(b)
        for _ in range(4):
            p = int(b)
            for bit in rng.choice(64, 4, replace=False):
                p ^= 1 << int(bit)
            points.append(np.uint64(p))
    points = np.unique(np.array(points, np.uint64))
    masks, radius = simhash.block_masks(4, 3)
    met = set()
    for m in masks:
        row, shard, guest = simhash.route(points, simhash.grow(points, m, leaf), m, radius)
        for s in np.unique(shard):
            home, visit = row[(shard == s) & ~guest], row[(shard == s) & guest]
            met |= {(min(a, b), max(a, b)) for a in home for b in [*home, *visit] if a != b}
    near = {(a, b) for a in range(len(points)) for b in range(a + 1, len(points)) if int(simhash.distance(points[a], points[b])) <= 4}
    assert near and near <= met


def test_names_that_the_operator_uses(spark):
    df = spark.createDataFrame([(1, "one two three", 1, 2, 3), (2, "one two three", 1, 2, 3), (None, "other words here", 1, 2, 3)], "doc_id bigint, text string, `_gone` int, row int, fp int")
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1]


def compared(n):
    """Pairs that are compared in all shards, and the members of the largest shard, for n made fingerprints."""
    fp = np.unique(np.random.default_rng(0).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    (mask, *_), radius = simhash.block_masks(4, 3)
    row, shard, guest = simhash.route(fp, simhash.grow(fp[:: max(1, len(fp) // 50_000)], mask, max(4, simhash.LEAF * 50_000 // n)), mask, radius)
    order = np.argsort(shard, kind="stable")
    head = np.flatnonzero(np.diff(shard[order], prepend=-1))
    pairs = most = 0
    for part in np.split(order, head[1:]):
        home, visit = fp[row[part[~guest[part]]]], fp[row[part[guest[part]]]]
        most = max(most, len(part))
        pairs += sum(len(a) * len(b) for a, b in simhash.meetings(home, visit, mask, radius))
    return pairs, most


def test_comparisons_grow_like_the_fingerprints():
    """Beyond the sample, trees within shards keep comparisons far from the square of 8, and shards in a task's bound."""
    (small, _), (large, most) = compared(50_000), compared(400_000)
    assert large <= 8**1.5 * small and most <= simhash.MOST


def test_trees_within_shards(spark):
    rng = random.Random(7)
    texts = [words(rng, 60, 40) for _ in range(120)]
    texts += [" ".join([*t.split()[:-1], "other"]) for t in texts[:60]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = slow_components(rows)
    assert result(df, local=5, inner=3, leaf=10, sample=20) == want
    assert result(df, local=5, inner=3, leaf=10, blocks=2) == want
