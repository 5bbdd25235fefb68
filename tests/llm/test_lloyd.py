import hashlib
import math

import numpy as np
import pytest

from blockmill.llm import lloyd as l


def brute(rows, k=l.K, rounds=l.ROUNDS, dims=l.DIMS, seed=l.SEED):
    """The contract in plain numpy. rows: (id, vector)."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    x = np.array([v for _, v in kept], np.int64)
    first = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, hashlib.sha256(f"{seed}:{kept[j][0]}".encode()).hexdigest(), kept[j][1]))[:k]
    c = x[first]
    for r in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        of = d.argmin(axis=1)
        if r < rounds:
            c = np.array([x[of == j].sum(axis=0) // (of == j).sum() if (of == j).any() else c[j] for j in range(len(c))])
    least = d[np.arange(len(x)), of]
    return [(kept[j][0], int(of[j]), int(least[j]), int(least[of == of[j]].sum()), int(least.sum()), hashlib.sha256(",".join(map(str, c[of[j]])).encode()).hexdigest()) for j in range(len(kept))], c


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in l.op12_clusters(spark, sf).collect())
    assert got == sorted(brute(rows)[0])


@pytest.mark.parametrize("kind", ["clouds", "copies", "noise", "line", "grid"])
def test_trees_prune_and_stay_exact(kind):
    rng = np.random.default_rng(3)
    if kind == "clouds":
        x = (rng.integers(-2000, 2000, (12, 8))[np.arange(1500) % 12] + rng.integers(-9, 9, (1500, 8))).astype(np.int64)
    elif kind == "copies":
        x = np.repeat(rng.integers(-50, 50, (5, 8)), 300, axis=0)
    elif kind == "noise":
        x = rng.integers(-500, 500, (1500, 8))
    elif kind == "line":
        x = np.repeat((2 ** np.arange(25))[:, None], 8, axis=1) * np.arange(1, 61)[:, None, None]
        x = x.reshape(-1, 8)
    else:  # many equal distances
        x = rng.integers(-1, 2, (1500, 8)) * 2
    tree = l.Tree.build(x)
    assert sorted(tree.order.tolist()) == list(range(len(x))) and (tree.points == x[tree.order]).all()
    for k in range(len(tree.centre)):
        own = tree.points[tree.first[k] : tree.last[k]]
        assert np.sqrt(((own - tree.points[tree.centre[k]]) ** 2).sum(axis=1)).max() <= tree.radius[k] * (1 + 1e-12) + 1e-9
        parts = [(tree.first[c], tree.last[c]) for c in tree.children(k)]
        if parts:
            assert parts[0][0] == tree.first[k] and parts[-1][1] == tree.last[k] and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    sums = np.array([tree.points[a:b].sum(axis=0) for a, b in zip(tree.first, tree.last)])
    for seed in range(5):
        c = x[np.random.default_rng(seed).choice(len(x), 8)]
        if kind == "clouds":
            c = x[seed * 100 + np.arange(8)]  # of clouds of their own
        if seed == 4:
            c = np.concatenate([c[:4], c[:4]])  # equal centroids: the smaller number wins
        want = ((tree.points[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        whole, of, compared = l.assign(tree, c, l.Tree.build(c, 1))
        n, total = l.totals(tree, sums, whole, of, 8)
        for node, k in whole:
            of[tree.first[node] : tree.last[node]] = k
        assert (of == want).all() and (n == np.bincount(want, minlength=8)).all()
        assert all((total[k] == tree.points[want == k].sum(axis=0)).all() for k in range(8))
        if kind in ("clouds", "copies") and seed < 4:
            assert compared < len(x) / 2


def test_several_blocks_and_hot_copies(spark):
    rng = np.random.default_rng(9)
    hot = rng.normal(size=64).astype(np.float32).tolist()
    rows = [(k, rng.normal(size=64).astype(np.float32).tolist() if k % 3 else hot) for k in range(900)] + [(5, hot)] * 3
    found, c = l.cluster(vectors(spark, rows).repartition(3), block=64)
    want, centroids = brute(rows)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == sorted(w[:3] for w in want)
    assert (c == centroids).all()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    one = [0.5] * 64
    bad = [(1, None), (2, []), (3, [1.0] * 63), (4, [nan] + one[1:]), (5, [inf] + one[1:]), (6, [None] + one[1:]), (7, [1.0] * 65)]
    good = [(8, one), (8, one), (None, [-0.3] * 64), (9, [0.0] * 64)]
    df = vectors(spark, bad + good).selectExpr("vec_id", "embedding", "1 as cluster", "'x' as v")
    found, c = l.cluster(df)
    assert len(c) == 4
    want, _ = brute(good)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=key) == sorted((w[:3] for w in want), key=key)
    assert l.cluster(vectors(spark, bad))[0].count() == 0 and l.cluster(vectors(spark, []))[0].columns == ["vec_id", "cluster", "distance"]
    with pytest.raises(Exception, match="or more"):
        l.cluster(vectors(spark, [(1, [1e9] * 64)]))
