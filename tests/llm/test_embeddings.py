import numpy as np

from blockmill.llm import embeddings as e


def brute(rows):
    """n_links and component of each id by all pairs."""
    ids = sorted({r[0] for r in rows if r[0] is not None})
    vec, label = {}, {}
    for i, v, y in rows:
        if i is not None and i not in vec:
            ok = v is not None and y is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
            u = np.array(v, float) / max(map(abs, v)) if ok else None
            vec[i], label[i] = (u / np.linalg.norm(u) if ok else None), y
    links, root = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if vec[a] is not None and vec[b] is not None and label[a] == label[b] and len(vec[a]) == len(vec[b]) and vec[a] @ vec[b] >= e.LINK:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i in ids}


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in e.near_duplicates(df).collect()}


def near(rng, v, by):
    out = v + rng.normal(size=len(v)) * by * np.linalg.norm(v) / np.sqrt(len(v))
    return [float(np.float32(x)) for x in out]


def cloud(rng, n, dim=16):
    bases = rng.normal(size=(6, dim))
    rows = [(k, near(rng, bases[k % 6], 0.1 if k % 3 else 0.7), k % 2) for k in range(n)]
    return rows


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 2), (4, [1.0, 0.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [0.0, 0.0, 0.0], 1),
        (8, [1.0, None, 0.0], 1), (9, [1.0, nan, 0.0], 1), (10, [inf, 0.0, 0.0], 1), (11, [], 1), (12, [1.0, 0.0], 1), (13, [1.0, 0.0], 1), (14, [1e-38, 0.0, 0.0], 1), (15, [3e38, 0.0, 0.0], 1),
        (None, [1.0, 0.0, 0.0], 1), (16, [1.0, 0.1, 0.0], 1), (16, [1.0, 0.1, 0.0], 1), (17, [1.0, 0.0, 0.0], 1), (-5, [-1.0, 0.0, 0.0], 1),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:0]) == {}


def test_clouds_and_cells_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = cloud(rng, 400)
    want = brute(rows)
    assert max(v[0] for v in want.values()) > 20
    assert run(spark, rows) == want
    monkeypatch.setattr(e, "CELL", 60)
    monkeypatch.setattr(e, "SHARD", 100)
    got = run(spark, rows)
    found, there = sum(min(got[i][0], want[i][0]) for i in want), sum(v[0] for v in want.values())
    assert found >= 0.98 * there and all(got[i][0] <= want[i][0] for i in want)


def test_robust_pruning_keeps_degree_and_reach():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges = e.prune(x)
    assert all(len(row) <= e.DEGREE and k not in row for k, row in enumerate(edges))
    near_ = (x @ x.T >= 0.9).sum() - 300
    got = sum(len(e.search(x, edges, q, 0, link=0.9)) - 1 for q in range(300))
    assert got >= 0.95 * near_


def test_audit_against_brute_force(spark):
    df = spark.createDataFrame(cloud(np.random.default_rng(9), 900), "vec_id long, embedding array<float>, label int")
    df = df.unionByName(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id + 1000 as vec_id", "slice(embedding, 1, 16) as embedding", "label"))
    result = e.near_duplicates(df)
    found, there = e.audit(df, result, every=1)
    assert found == there == result.agg({"n_links": "sum"}).first()[0] > 0
    lost = result.withColumn("n_links", result["n_links"] - 1)
    assert e.audit(df, lost, every=1)[0] < there


def all_links(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (x @ x.T >= e.LINK).sum(axis=1) - 1


def found(spark, x):
    x = x.astype(np.float32).astype(float)
    rows = [(k, v, 1) for k, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in e.near_duplicates(df).collect()}
    return np.array([got[k].n_links for k in range(len(x))]), {r.component_id for r in got.values()}, all_links(x)


def test_many_near_copies_lose_no_link(spark):
    """More near copies than one cell holds, among vectors without a cluster: several centres, cells of two blocks."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=32)
    tight = base + rng.normal(size=(5000, 32)) * 0.08 * np.linalg.norm(base) / np.sqrt(32)
    got, parts, want = found(spark, np.concatenate([tight, rng.normal(size=(1500, 32))]))
    assert want.sum() > 20_000_000 and (got == want).all() and len(parts) > 1000


def test_clusters_that_the_bound_parts_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(6)
    bases = rng.normal(size=(12, 32))
    x = np.concatenate([b + rng.normal(size=(150, 32)) * by for b, by in zip(bases, np.linspace(0.05, 0.5, 12))])
    monkeypatch.setattr(e, "CELL", 120)
    monkeypatch.setattr(e, "SHARD", 100)
    cut = []
    monkeypatch.setattr(e, "fitted", lambda rows, f=e.fitted: cut.append(f(rows)) or cut[-1])
    got, _, want = found(spark, x)
    assert cut[0] is not None and len(cut[0]) > 5 and (got == want).all() and want.sum() > 10_000


def test_two_dense_groups_are_linked(spark):
    """Each member has 99 links within its group, more than the graph's candidates, and 100 across."""
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 64))
    a /= np.linalg.norm(a)
    b -= a * (a @ b)
    b = 0.987 * a + np.sqrt(1 - 0.987**2) * b / np.linalg.norm(b)
    groups = [c + rng.normal(size=(100, 64)) * 0.002 for c in (a, b)]
    for others in (0, 50, 200):
        got, parts, want = found(spark, np.concatenate([*groups, rng.normal(size=(others, 64))]))
        assert (got == want).all() and want.sum() == 39_800 and len(parts) == 1 + others


def test_dense_clouds_lose_and_add_no_link(spark):
    """One cloud of 2,000 vectors about as far apart as links reach, and three of 8,000 in all, in one label."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(3, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    cloud_ = lambda b, n: b + rng.normal(size=(n, 64)) * 0.145 / np.sqrt(64)
    for x in (cloud_(base[0], 2000), np.concatenate([cloud_(b, n) for b, n in zip(base, (4000, 2500, 1500))])):
        got, _, want = found(spark, x)
        assert (got == want).all() and 0.2 < want.mean() / len(x) * (1 if len(x) == 2000 else 3) < 1.5


def test_equal_label_hashes_are_no_matter(spark):
    rows = [(1, [1.0, 0.0], 12), (2, [1.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 12), (4, [1.0, 0.01], 12)]
    assert run(spark, rows) == brute(rows)
