import numpy as np
import pytest

from rankmill.llm import vector_graph
from rankmill.llm.vector_graph import build_graph, near_duplicates, range_search, robust_prune

DDL = "vec_id long, embedding array<float>, label int, kept int"


def sample(seed=1, n=700, dims=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for group in range(12):
        size = rng.integers(2, 40)
        x[rng.choice(n, size, replace=False)] = rng.normal(size=dims) + 0.08 * rng.normal(size=(size, dims)) * rng.integers(1, 4)
    x[5] = x[6] = x[7]
    return x.astype(np.float32), rng.integers(0, 3, n)


def slow(ids, x, labels, cosine):
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= cosine) & (labels[:, None] == labels[None, :])
    comp = np.array(ids)
    while True:
        new = np.where(near, comp[None, :], max(ids) + 1).min(axis=1)
        if (new == comp).all():
            return {i: (int(d) - 1, int(c)) for i, d, c in zip(ids, near.sum(axis=1), comp)}
        comp = new


@pytest.mark.parametrize("limits", [None, (40, 90, 30)])
def test_matches_brute_force(spark, monkeypatch, limits):
    """Small bounds force several rounds of dealing and counting in block pairs."""
    if limits:
        for name, value in zip(("SHARD", "SHARD_LIMIT", "BLOCK"), limits):
            monkeypatch.setattr(vector_graph, name, value)
    x, labels = sample()
    rows = [(i, [float(v) for v in x[i]], int(labels[i]), 0) for i in range(len(x))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, DDL).repartition(4)).collect()}
    want = slow(list(range(len(x))), x, labels, 0.93)
    total, same = sum(n for n, _ in want.values()), sum(min(got[i][0], want[i][0]) for i in want)
    assert all(got[i][0] <= want[i][0] for i in want) and same >= (0.9 if limits else 1.0) * total
    if not limits:
        assert got == want


def test_special_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1, 0), (2, [0.0, 0.0], 1, 0), (3, [1.0, nan], 1, 0), (4, [1.0, None], 1, 0), (5, [inf, 1.0], 1, 0), (6, [], 1, 0), (7, [1.0, 0.0], None, 0),
        (8, [1.0, 0.0], 1, 0), (9, [2.0, 0.0], 1, 0), (10, [1.0, 0.1], 1, 0), (11, [1.0, 0.0], 2, 0), (12, [1.0, 0.0, 0.0], 1, 0), (None, [3.0, 0.0], 1, 0), (8, [1.0, 0.0], 1, 0),
    ]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, DDL)).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 11, 12)]
    assert got == sorted([*alone, (8, 4, 8, True), (8, 4, 8, True), (9, 4, 8, False), (10, 4, 8, False), (None, 4, 8, False)], key=str)
    assert near_duplicates(spark.createDataFrame([], DDL)).count() == 0


def test_pruning_and_search():
    x, _ = sample(3, 300)
    x = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    distance = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    kept = robust_prune(np.argsort(distance[0])[1:50], distance, 0, 10, 1.2)
    assert kept[0] == np.argsort(distance[0])[1] and all(1.2 * distance[a, b] > distance[0, b] for k, b in enumerate(kept) for a in kept[:k])
    a, b = range_search(x, build_graph(x), 0.93, 32)
    assert len(set(zip(a, b))) == len(a)
    found, true = set(zip(a.tolist(), b.tolist())), {(int(i), int(j)) for i, j in np.argwhere(x @ x.T >= 0.93) if i != j}
    assert found <= true and len(found) >= 0.95 * len(true)


def test_tight_group_is_divided_or_compared_in_blocks(spark):
    """Over SHARD_LIMIT distinct near copies of one vector, and others of the same label, at the production bounds."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=16) + 0.05 * rng.normal(size=(3300, 16)), rng.normal(size=(300, 16))]).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(unit)], "label string, cid long, unit array<double>").repartition(4)
    shards, tight = (t.cache() for t in vector_graph.deal(vectors))
    assert all(r["count"] <= vector_graph.SHARD_LIMIT for r in shards.groupBy("shard").count().collect())
    assert {r.cid for r in shards.union(tight).select("cid").collect()} == set(range(len(x)))
    assert shards.count() + tight.count() <= vector_graph.NEAREST * len(x)
    rows = [(i, [float(v) for v in x[i]], 1, 0) for i in range(len(x))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, DDL).repartition(4)).collect()}
    want = slow(list(range(len(x))), x, np.ones(len(x)), 0.93)
    total, same = sum(n for n, _ in want.values()), sum(min(got[i][0], want[i][0]) for i in want)
    assert all(got[i][0] <= want[i][0] for i in want) and same >= 0.999 * total


def test_blocks_connect_all_links(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "BLOCK", 50)
    x, _ = sample(3, 300)
    x = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    shard = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "shard string, cid long, unit array<double>")
    edges = {(r.a, r.b) for r in vector_graph.block_edges(shard, 0.93).collect()}
    root = np.arange(len(x))
    for _ in range(50):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(x[a] @ x[b] >= 0.93 or root[a] == root[b] for a, b in edges)
    assert all(root[i] == root[j] for i, j in np.argwhere(x @ x.T >= 0.93))
