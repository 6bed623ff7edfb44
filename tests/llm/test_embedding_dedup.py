import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import embedding_dedup
from graphloom.llm.links import components


def slow(rows, cosine=0.9):
    ids, units = [], []
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(1)
        ids.append(i)
        units.append(x / np.linalg.norm(x) if np.isfinite(x).all() and np.linalg.norm(x) > 0 else None)
    n, root = [0] * len(ids), list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine:
                n[a] += 1
                n[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, n[k], least[find(k)], i == least[find(k)]) for k, i in enumerate(ids))


def made(seed=0, groups=25, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = rng.normal(size=dim)
        for _ in range(1 + g % 9):
            rows.append((c + rng.normal(size=dim) * 0.2 * (g % 3)).tolist())
    rows += [rows[3], rows[3], [2 * x for x in rows[5]], None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0]]
    return [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None) for i, v in enumerate(rows)]


@pytest.mark.parametrize("most", [7, 2048])
def test_against_brute_force(spark, most):
    rows = made()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, `key` string").repartition(3)
    got = embedding_dedup.near_duplicates(df, most=most)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got, want = sorted(map(tuple, got.collect())), slow(rows)
    found, all_ = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found <= all_ and found >= 0.95 * all_
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.95 * len(want)


def partners(rng, x, top=0.95):
    """For each row of x, a vector at a cosine from 0.90 to the top."""
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    c = rng.uniform(0.9, top, (len(x), 1))
    return c * x + np.sqrt(1 - c**2) * u / np.linalg.norm(u, axis=1, keepdims=True)


def frame(spark, rows):
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(rows)), "embedding": pa.array(list(rows), pa.list_(pa.float64()))})).repartition(4)


def counts(rows, cosine=0.9):
    x = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return np.concatenate([(x[a : a + 2000] @ x.T >= cosine).sum(1) - 1 for a in range(0, len(x), 2000)])


@pytest.mark.parametrize(("seed", "n_pairs"), [(0, 10), (2, 0)])
def test_recall_of_rare_pairs(spark, seed, n_pairs):
    """Few pairs, or none, of a cosine of 0.90 to 0.93 among 20,000 vectors: no luck with a sample would find them."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = np.concatenate([x, partners(rng, x[:n_pairs], 0.93)])
    got = np.array([r["n_links"] for r in embedding_dedup.near_duplicates(frame(spark, rows)).orderBy("vec_id").collect()])
    want = counts(rows)
    assert want.sum() >= 2 * n_pairs and (got <= want).all()
    assert got.sum() >= 0.99 * want.sum()


@pytest.mark.parametrize(("n_hot", "n_pairs", "spread"), [(3_000, 100, 0.004), (1_500, 100, 0.022)])
def test_recall_beside_a_crowd(spark, n_hot, n_pairs, spread):
    """Loose pairs beside a third of near copies, and the counts of the crowd itself, some of it outside the ball."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3 * n_hot, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hot = x[:1] + spread * rng.normal(size=(n_hot, 64))
    rows = np.concatenate([x, partners(rng, x[1 : n_pairs + 1]), hot])
    got = np.array([r["n_links"] for r in embedding_dedup.near_duplicates(frame(spark, rows)).orderBy("vec_id").collect()])
    want = counts(rows)
    assert (got <= want).all() and got.sum() >= 0.999 * want.sum()
    loose = slice(1, len(x) + n_pairs)
    assert got[loose].sum() >= 0.98 * want[loose].sum()


@pytest.mark.parametrize("most", [50, 2048])
def test_balls_against_brute_force(spark, most):
    """Crowds of several widths, some within reach of each other, become balls; every count is still exact."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 16))
    base[1] = base[0] + 0.5 * rng.normal(size=16) * np.linalg.norm(base[0]) / 4
    base[2] = base[0] + 0.3 * rng.normal(size=16) * np.linalg.norm(base[0]) / 4
    rows = np.concatenate([b + w * rng.normal(size=(70, 16)) * np.linalg.norm(b) / 4 for b, w in zip(base, (0.05, 0.1, 0.2, 0.25, 0.3, 1.0), strict=True)])
    at = embedding_dedup.pivots(embedding_dedup.units(rows), 0.9, 8)
    assert len(at) >= 4
    df = frame(spark, np.concatenate([rows, rows[:3]]))
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df, most=most).collect()))
    want = slow([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(r[1] for r in got) >= 0.998 * sum(r[1] for r in want)


def near_groups(rng, groups, members, to_each_other, dim=64):
    """Tight groups whose centres have about this cosine to each other."""
    shared = np.eye(1, dim)
    own = rng.normal(size=(groups, dim))
    own[:, 0] = 0
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    centres = to_each_other**0.5 * shared + (1 - to_each_other) ** 0.5 * own
    return np.repeat(centres, members, 0) + 0.01 * rng.normal(size=(groups * members, dim))


@pytest.mark.parametrize("to_each_other", [0.75, 0.82, 0.87])
def test_groups_near_each_other_visit_few_balls(spark, to_each_other):
    rows = near_groups(np.random.default_rng(8), 200, 50, to_each_other)
    x = embedding_dedup.units(rows)
    at = embedding_dedup.pivots(x[np.random.default_rng(1).permutation(len(x))], 0.9)
    assert len(at) > 100
    some = embedding_dedup.afforded(x, at, 0.9)
    placed = lambda p: (len(x) + len(embedding_dedup.met_shells(x @ p.T, 0.9)[3])) / len(x)
    assert placed(some) < 20 and (to_each_other < 0.8 or placed(at) > 100)
    # Another order of the same points, and vectors that the sample lacks, visit as few.
    assert placed(embedding_dedup.afforded(x[::3], at, 0.9)) < 20


def test_recall_of_groups_near_each_other(spark):
    rows = near_groups(np.random.default_rng(9), 60, 40, 0.87)
    got = np.array([r["n_links"] for r in embedding_dedup.near_duplicates(frame(spark, rows)).orderBy("vec_id").collect()])
    want = counts(rows)
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_the_largest_crowd_stays_a_ball():
    rng = np.random.default_rng(10)
    hot = near_groups(rng, 1, 3_000, 0.87)
    x = embedding_dedup.units(np.concatenate([hot, near_groups(rng, 100, 50, 0.87)]))
    x = x[np.random.default_rng(2).permutation(len(x))]
    kept = embedding_dedup.afforded(x, embedding_dedup.pivots(x, 0.9), 0.9)
    assert (kept @ embedding_dedup.units(hot).mean(0)).max() > 0.99


def test_null_and_repeated_ids(spark):
    rows = [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (None, [1.0, 0.01]), (None, [0.0, -1.0]), (9, [0.0, 2.0]), (3, None)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, node string, copies int")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(7, 1, 7, True), (7, 1, 7, True), (None, 1, 7, False), (None, 0, None, True), (9, 1, 7, False), (3, 0, 3, True)], key=repr)


def test_empty_and_unusable(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embedding_dedup.near_duplicates(empty).collect() == []
    one = spark.createDataFrame([(1, [0.0]), (2, None)], "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(one).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_vectors_of_one_part(spark):
    """The first half is empty then."""
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [-1.0]), (4, None)], "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(20, 60)] + [(3, 7), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 3 for k in [3, 7, *range(20, 60)]}}
