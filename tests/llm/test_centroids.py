import hashlib
import math

import numpy as np
import pytest

from rankmill.llm.centroids import Simplex, cluster, integer_vectors, nearest, smallest_hashes, squared_distances


def slow(rows, clusters=8, rounds=10, dimensions=64):
    kept = [
        (i, [math.floor(1024 * x) for x in v]) for i, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) and abs(x) <= 131072 for x in v)
    ]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:clusters]]
    if not centres:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centres)]
    found = [(i, *near(v)) for i, v in kept]
    total = {k: sum(d for _, d, c in found if c == k) for k in range(clusters)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, d, total[k], sum(total.values()), sha[k]) for i, d, k in found), key=str)


def got(frame):
    return sorted((tuple(r)[:6] for r in frame.collect()), key=str)


def blobs(seed, n, spread, dimensions=64):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(5, dimensions))
    return [(i, [float(x) for x in np.float32(heads[rng.integers(5)] + spread * rng.normal(size=dimensions))]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_equals_plain_rounds(spark, spread):
    rows = blobs(4, 500, spread)
    rows += [(500 + i, rows[i][1]) for i in range(40)] + [(7, rows[9][1]), (7, rows[7][1]), (None, rows[3][1])]
    bad = [None, [], [0.1] * 63, [0.1] * 65, [None] + [0.1] * 63, [float("nan")] + [0.1] * 63, [float("-inf")] + [0.1] * 63, [1e30] * 64]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + [(2000 + j, b) for j, b in enumerate(bad)]], "vec_id long, embedding array<float>, cluster int, v string")
    result = cluster(frame.repartition(5))
    assert got(result) == slow(rows)
    row = result.first()
    assert hashlib.sha256(",".join(map(str, row.centroid)).encode()).hexdigest() == row.centroid_sha256


def test_ties_few_and_no_vectors(spark):
    ddl = "vec_id long, embedding array<float>"
    same = [(i, [1.0] * 64) for i in range(30)] + [(99, [-131072.0] * 64), (98, [131072.0] * 64)]
    assert got(cluster(spark.createDataFrame(same, ddl))) == slow(same)
    three = blobs(1, 3, 1.0)
    assert got(cluster(spark.createDataFrame(three, ddl))) == slow(three)
    assert got(cluster(spark.createDataFrame([(1, [2.5] * 64)], ddl))) == slow([(1, [2.5] * 64)])
    empty = cluster(spark.createDataFrame([], ddl))
    assert empty.count() == 0 and empty.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert cluster(spark.createDataFrame([(None, [2.5] * 64)], ddl)).count() == 0


def test_bounds_hold_and_filter(spark):
    rows = integer_vectors(spark.createDataFrame(blobs(2, 400, 0.3), "vec_id long, embedding array<float>"))
    sample = smallest_hashes(rows, 64)
    simplex, points = Simplex(sample), np.array([r.v for r in rows.collect()], np.int64)
    assert len(simplex.pivots) == 6
    centres = np.array(sample[:8])
    apexes, tops = simplex.apexes(points), simplex.apexes(centres)
    for j, centre in enumerate(centres):
        true = squared_distances(points, centre)
        flat = ((apexes[:, :-1] - tops[j, :-1]) ** 2).sum(1)
        slack = 1e-9 * (true + 1) + 1
        assert (flat + (apexes[:, -1] - tops[j, -1]) ** 2 <= true + slack).all()
        assert (flat + (apexes[:, -1] + tops[j, -1]) ** 2 >= true - slack).all()
    best, distance, compared = nearest(points, apexes, centres, tops)
    full = np.stack([squared_distances(points, c) for c in centres], 1)
    assert (best == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert compared < 0.7 * full.size  # the bounds rule centres out


def test_flat_and_repeated_pivots():
    line = [[i] + [0] * 63 for i in range(20)]
    assert len(Simplex(line).pivots) == 2 and len(Simplex([[3] * 64] * 5).pivots) == 1
    points = np.array(line)
    simplex = Simplex(line)
    best, distance, _ = nearest(points, simplex.apexes(points), points[[2, 2, 9]], simplex.apexes(points[[2, 2, 9]]))
    assert best.tolist() == [0] * 6 + [2] * 14 and distance[5] == 9
