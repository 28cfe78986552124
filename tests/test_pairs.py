"""Nearest, counted and radial pairs on the grid plan, against brute force."""

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from rankmill.functions import pairs
from rankmill.operators import dense as dn


def data(seed: int, n: int, dims: int) -> np.ndarray:
    """Vectors of which some are copies, opposite or zero."""
    rng = np.random.default_rng(seed)
    found = np.round(rng.standard_normal((n, dims)), 1)
    found[n // 2 : n // 2 + n // 5] = found[3]
    found[-1] = 0.0
    return found


def scores_of(found: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        unit = found / np.linalg.norm(found, axis=1, keepdims=True)
    return np.floor((1 + unit @ unit.T) / 2 * 1e6 + 0.5) / 1e6


@pytest.mark.parametrize("least", [None, 0.6])
def test_grid_search_is_brute_force_with_copies(rows, monkeypatch, least):
    monkeypatch.setattr(dn, "QUERY_VALUES", 60)
    monkeypatch.setattr(dn, "STRIPE_VALUES", 360)
    monkeypatch.setattr(dn, "STRIPE_LEAST", 20)
    monkeypatch.setattr(pairs, "SIDE", 16)
    monkeypatch.setattr(pairs, "AGAIN", 50)
    found = data(5, 130, 6)
    scores, n, k = scores_of(found), len(found), 4
    vectors = rows([(str(i), [float(x) for x in v]) for i, v in enumerate(found)], "document_id string, embedding array<double>")
    got = dn.exact_knn(vectors.withColumnRenamed("document_id", "query_id"), vectors, k, min_score=least, exclude_self=least is not None)
    want = []
    for q in range(n):
        near = [d for d in range(n) if scores[q, d] >= (least or 0) and not (least and d == q)]
        want += [(str(q), str(d), r, scores[q, d]) for r, d in enumerate(sorted(near, key=lambda d: (-scores[q, d], d))[:k], 1)]
    assert table(got, "query_id", "document_id", "rank", "score") == sorted(want)


def test_pair_counts_are_brute_force(rows, monkeypatch):
    monkeypatch.setattr(dn, "STRIPE_VALUES", 300)
    monkeypatch.setattr(dn, "STRIPE_LEAST", 20)
    monkeypatch.setattr(pairs, "SIDE", 16)
    found = data(6, 120, 5)
    scores, n = scores_of(found), len(found)
    vectors = rows([(str(i), [float(x) for x in v]) for i, v in enumerate(found)], "document_id string, embedding array<double>")
    kinds = np.arange(3)[:, None], np.arange(4)[None, :]
    marks = {"every": np.ones((3, 4), bool), "even": (kinds[0] + kinds[1]) % 2 == 0}
    number = F.col("document_id").cast("long")
    got = dn.pair_counts(
        vectors.select(F.col("document_id").alias("query_id"), "embedding", (number % 3).alias("kind")),
        vectors.withColumn("kind", number % 4), [0.5, 0.7], marks,
    )
    want = []
    for q in range(n):
        for least in (0.5, 0.7):
            near = [d for d in range(n) if d != q and scores[q, d] >= least]
            want.append((str(q), least, len(near), sum((q % 3 + d % 4) % 2 == 0 for d in near)))
    assert table(got, "query_id", "min_score", "every", "even") == sorted(want)
    assert "cogroup" in got._jdf.queryExecution().toString().lower()


def test_recall_from_best_lists_equals_recall_from_hits(rows):
    from rankmill.operators import radial as rd

    cases = [(least, c, ["x"], [1.0] * 4, 0) for least in (0.5, 0.8) for c in "abc"]
    cases = rows(cases, "min_score double, case_id string, slices array<string>, radial_latency_ms array<double>, exact_total long")
    near = [("a", i, 1.0 - i / 100, i != 3) for i in range(1, 31)] + [("b", 1, 0.6, False), ("b", 2, 0.55, True)]
    hits = [(least, *h[:3], True, h[3]) for least in (0.5, 0.8) for h in near if h[2] >= least]
    hits = rows(hits, "min_score double, case_id string, product_id long, score double, exact boolean, radial boolean")
    sides = [rows([h[:3] for h in near if keep or h[3]], "case_id string, product_id long, score double") for keep in (True, False)]
    best = [s.orderBy(F.col("score").desc()).where(F.col("score") > 0.94) if i == 0 else s.where((F.col("score") > 0.93) | (F.col("case_id") == "b")) for i, s in enumerate(sides)]
    best[0] = best[0].unionByName(sides[0].where("case_id = 'b'"))
    columns = ("min_score", "slice", "recall", "cases")
    want = table(rd.slice_recall(cases, hits, 5), *columns)
    assert table(rd.slice_recall(cases, None, 5, rd.best_recall(*best, [0.5, 0.8], 5)), *columns) == want


def test_repeated_pairs_are_brute_force(rows, monkeypatch):
    """Ids that are there more than once, on both sides, with other vectors each; two of them without a pair."""
    monkeypatch.setattr(dn, "STRIPE_VALUES", 300)
    monkeypatch.setattr(dn, "STRIPE_LEAST", 20)
    monkeypatch.setattr(pairs, "SIDE", 16)
    found = data(7, 90, 5)
    scores, ids = scores_of(found), [str(i if i < 60 else i - 60 if i < 75 else 7) for i in range(90)]
    frame = rows([(ids[i], i % 2, i % 3, [float(x) for x in v]) for i, v in enumerate(found)], "id string, a int, b int, embedding array<double>")
    mark = (np.arange(2)[:, None] + np.arange(3)[None, :]) % 2 == 0
    got = dn.pair_counts(
        frame.select(F.col("id").alias("query_id"), "embedding", F.col("a").alias("kind")),
        frame.select(F.col("id").alias("document_id"), "embedding", F.col("b").alias("kind")), [0.5, 0.8], {"every": np.ones((2, 3))},
        repeated={"marked": mark, "all": np.ones((2, 3))},
    )
    met = {}
    for least in (0.5, 0.8):
        for q in range(90):
            for d in range(90):
                if ids[q] != ids[d] and scores[q, d] >= least:
                    for name, counts in (("marked", mark[q % 2, d % 3]), ("all", True)):
                        key = (ids[q], least, name)
                        met.setdefault(key, {}).setdefault(ids[d], 0)
                        met[key][ids[d]] += int(counts)
    many = lambda q, least, name: sum(n > 1 for n in met.get((q, least, name), {}).values())
    want = [(q, least, many(q, least, "marked"), many(q, least, "all")) for q in set(ids) for least in (0.5, 0.8)]
    assert table(got, "query_id", "min_score", "marked", "all") == sorted(want)
    assert any(w[2] != w[3] for w in want) and any(w[3] == 0 for w in want)
