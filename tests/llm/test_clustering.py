import random

import numpy as np
import pytest

from graphloom.llm import clustering


def plain(rows, k=8, rounds=10, dims=64):
    """The same by Python integers, every vector against every centroid."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else clustering.seed_hash(r[0]), r[1]))
    centroids = [v for _, v in order[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((gap(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(held[j]) for x in zip(*held[j], strict=True)] if j in held else c for j, c in enumerate(centroids)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    inertia = {}
    for _, j, d in out:
        inertia[j] = inertia.get(j, 0) + d
    fits = lambda x: x if x < 1 << 63 else None
    return sorted([(i, j, fits(d), fits(inertia[j]), fits(sum(inertia.values())), [str(x) for x in centroids[j]]) for i, j, d in out], key=repr)


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, cluster int, vector int").repartition(3)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted((tuple(r) for r in clustering.cluster(df, **options).collect()), key=repr)
    assert got == plain(rows, **options)
    return got


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted((tuple(r) for r in clustering.cluster(df).collect()), key=repr) == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(1)
    v = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    rows = [(i, v()) for i in range(40)] + [(None, v()), (None, v()), (3, v()), (50, None), (51, [1.0]), (52, [None, 1.0, 1.0, 1.0]), (53, [float("nan")] * 4), (54, [float("inf")] * 4), (55, [0.0] * 4), (56, []), (57, [1.0] * 5), (58, [-1e-20, 1e-20, -0.0, -1 / 1024])]
    rows += [rows[0], rows[0]]
    assert len(check(spark, rows, dims=4, k=5)) == 47
    check(spark, rows[:3], dims=4, k=8)
    assert check(spark, [], dims=4) == []
    assert check(spark, [(1, None)], dims=4) == []


def test_ties_and_empty_centroids(spark):
    """Equal vectors seed equal centroids: all go to the smaller number, the others stay empty where they are."""
    rows = [(i, [float(i % 2), 0.0]) for i in range(30)]
    got = check(spark, rows, dims=2, k=6)
    assert len({r[1] for r in got}) == 2
    grid = [(i, [float(i % 7), float(i // 7)]) for i in range(49)]
    check(spark, grid, dims=2, k=8)


@pytest.mark.parametrize("size", [1e5, 1e9, 1e30])
def test_large_components(spark, size):
    """Beyond 64 bits all stays exact; what a long does not hold is null."""
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-size, size), rng.uniform(-1, 1)]) for i in range(30)]
    got = check(spark, rows, dims=2, k=3)
    assert size < 1e8 or any(r[2] is None for r in got) == (size > 1e10) or size == 1e9


def test_annulus_leaves_most_centroids_uncompared():
    rng = np.random.default_rng(4)
    spread = np.exp(rng.uniform(0, 8, 200))[:, None] * rng.normal(size=(200, 8))
    values = np.floor(spread * 100).astype(np.int64)
    x = values[rng.integers(0, 200, 3000)] + rng.integers(-5, 5, (3000, 8))
    own = clustering.Centroids(values.tolist(), True)
    best, d, compared = own.nearest(x)
    all_ = ((x[:, None] - values[None]) ** 2).sum(2)
    assert (best == all_.argmin(1)).all() and (d == all_.min(1)).all()
    assert compared < 0.1 * all_.size
