"""Near vectors against all pairs in double precision."""

import numpy as np
import pytest

from veinmap.llm.near_vectors import BLOCK, Codes, encode, forest, linked, near_vectors, plan, unit
from veinmap.llm import near_vectors as N


def brute(ids, vectors, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in vectors]
    n = len(ids)
    link = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                link[i][j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    a, b = np.nonzero(np.array(link))
    root = forest(n, a, b) if n else []
    least = {}
    for i in range(n):
        least[root[i]] = min(least.get(root[i], ids[i]), ids[i])
    return sorted((ids[i], int(sum(link[i])), least[root[i]]) for i in range(n))


def clustered(seed, n=400, dim=32, noise=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((n // 5, dim))
    x = centers[rng.integers(0, len(centers), n)] + noise * rng.standard_normal((n, dim)) * rng.random((n, 1)) * 4
    return x.astype(np.float32)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    x = clustered(seed).tolist()
    x += [x[0], x[0], [2 * c for c in x[1]]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect())
    want = brute(list(range(len(x))), [np.float32(v).tolist() for v in x])
    links = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.99 * links and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    if sum(g[1] for g in got) == links:
        assert got == want


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1e30, 1e-30]), (7, [1e38, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0]), (10, [1e-40, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    assert got == {(i, 0, i, True) for i in (1, 2, 3, 4, 5, 8, 9)} | {(6, 3, 6, True), (7, 3, 6, False), (10, 3, 6, False)}
    assert near_vectors(df.limit(0)).count() == 0


def test_large_bucket_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = np.ones((100, 16)) + 0.02 * rng.standard_normal((100, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = near_vectors(df).collect()
    assert {r.n_links for r in got} == {99} and {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    assert BLOCK > 16


def test_no_task_gets_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 1000)
    u = unit(np.random.default_rng(8).standard_normal((20_000, 8)))
    rows = [(8, i.to_bytes(16, "little"), c.tobytes()) for i, c in enumerate(encode(u, 8))]
    coded = spark.createDataFrame(rows, "dim int, node binary, code binary")
    sizes = [r["count"] for r in N._blocks(coded, 0, 1).groupBy(*N.BLOCK_KEYS).count().collect()]
    assert len(sizes) == 20 * 21 // 2 and max(sizes) < 2.4 * 1000


def test_several_tables_and_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "PER_BUCKET", 8)
    x = clustered(9, 600, 24).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = brute(list(range(len(x))), [np.float32(v).tolist() for v in x])
    links = sum(w[1] for w in want)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect())
    assert plan(600)[1] * plan(600)[0] > 24 and links > 300
    assert sum(g[1] for g in got) >= 0.99 * links and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    monkeypatch.setattr(N, "BLOCK", 100)
    assert plan(600, miss=0) == (0, 1)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df, miss=0).collect()) == want


def test_estimate_is_unbiased_and_bounds_hold():
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((2, 3000, 64))
    b = 0.3 * b + a
    u = unit(np.concatenate([a, b]))
    codes = Codes([c.tobytes() for c in encode(u, 200)], 64)
    assert codes.bits.shape[1] >= 200 and abs(codes.factor.mean() - 0.8) < 0.02
    estimate = (codes.signs[:3000] * codes.steps[3000:]).sum(axis=1) / codes.factor[:3000, 0]
    true = (u[:3000] * u[3000:]).sum(axis=1)
    assert abs((estimate - true).mean()) < 0.003
    left, right = np.arange(3000), np.arange(3000, 6000)
    found = [np.concatenate(p) for p in zip(*codes.near(left, right, 0.95, 5.0), strict=True)]
    hit = linked(u, *found, 0.95)
    want = {(i, i + 3000) for i in range(3000) if true[i] >= 0.95}
    assert want <= set(zip(found[0][hit].tolist(), found[1][hit].tolist(), strict=True)) and len(hit) < 0.01 * 3000 * 3000
    assert len(np.concatenate([x for x, _ in codes.near(left[:50], None, 0.95, float("inf"))])) == 50 * 49 // 2


def test_deviation_covers_pairs_at_the_threshold():
    rng = np.random.default_rng(6)
    a, e = rng.standard_normal((2, 4000, 64))
    a = unit(a)
    e = unit(e - (e * a).sum(axis=1, keepdims=True) * a)
    u = np.concatenate([a, 0.95 * a + np.sqrt(1 - 0.95**2) * e])
    codes = Codes([c.tobytes() for c in encode(u, 64)], 64)
    by = (codes.signs[:4000] * codes.steps[4000:]).sum(axis=1) / codes.factor[:4000, 0]
    assert abs((by - 0.95).mean()) < 0.002
    z = (by - 0.95) / codes.deviation(0.95)[:4000, 0]
    assert z.std() < 1.1 and np.abs(z).max() < 5


def test_plan_grows_slowly():
    assert plan(100) == (0, 1) and plan(10**9)[0] == 20 and plan(10**9)[1] < 70 and plan(50_000)[1] < 15
