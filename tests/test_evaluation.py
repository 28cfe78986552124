import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import table
from rankmill.operators import evaluation as ev
from rankmill.operators import selection as sl
from rankmill.operators import significance as sg

QRELS = "query_id string, document_id string, relevance int"
RUN = "query_id string, document_id string, rank int, score double, tag string"


def random_case(seed, queries=9):
    """Judgments and a run of several queries, with unjudged documents, and both as dictionaries."""
    rng = random.Random(seed)
    gains, ranking = {}, {}
    for q in range(queries):
        pool = [f"d{i}" for i in range(rng.randint(4, 30))]
        gains[f"k{q}"] = {d: rng.choice([0, 0, 1, 2]) for d in rng.sample(pool, rng.randint(2, len(pool)))}
        ranking[f"k{q}"] = rng.sample(pool, rng.randint(1, len(pool)))
    qrels = [(q, d, g) for q, own in gains.items() for d, g in own.items()]
    return gains, ranking, qrels, [r for q, docs in ranking.items() for r in run_rows(q, docs)]


def discounted(values):
    return sum(g / math.log2(i + 1) for i, g in enumerate(values, 1))


def run_rows(query, documents, tag="t"):
    return [(query, d, i, float(100 - i), tag) for i, d in enumerate(documents, 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_metrics_against_definitions(rows, seed):
    gains, ranking, qrels, run = random_case(seed)
    got = {r["query_id"]: r for r in ev.evaluate(rows(run, RUN), rows(qrels, QRELS)).collect()}
    for q, own in gains.items():
        docs = ranking[q]
        ideal = discounted(sorted(own.values(), reverse=True)[:10])
        relevant = [d for d, g in own.items() if g > 0]
        assert got[q]["ndcg@10"] == pytest.approx(discounted([own.get(d, 0) for d in docs[:10]]) / ideal if ideal else 0)
        assert got[q]["recall@100"] == pytest.approx(sum(d in docs for d in relevant) / len(relevant) if relevant else 0)
        first = [i for i, d in enumerate(docs[:10], 1) if own.get(d) == 2]
        assert got[q]["mrr_exact@10"] == pytest.approx(1 / first[0] if first else 0)
        assert got[q]["judged@10"] == pytest.approx(sum(d in own for d in docs[:10]) / 10)


def test_exact_gain_is_a_parameter(rows):
    qrels = rows([("lamp", "p7", 5), ("lamp", "p8", 4), ("lamp", "p9", 1)], QRELS)
    run = rows(run_rows("lamp", ["p9", "p1", "p8", "p7"]), RUN)
    for gain, place in ((5, 4), (4, 3), (1, 1)):
        assert ev.evaluate(run, qrels, exact_gain=gain).first()["mrr_exact@10"] == pytest.approx(1 / place)


def test_queries_without_results_or_gain_count_as_zero(rows):
    qrels = rows([("a", "d", 2), ("b", "d", 2), ("c", "d", 0)], QRELS)
    run = rows(run_rows("a", ["d"]) + run_rows("c", ["d"]), RUN)
    (mean,) = ev.macro(ev.evaluate(run, qrels)).collect()
    assert mean["queries"] == 3
    assert mean["ndcg@10"] == pytest.approx(1 / 3)


def test_ideal_uses_judgments_that_were_not_retrieved(rows):
    qrels = rows([("a", "d", 1), ("a", "missed", 2)], QRELS)
    run = rows(run_rows("a", ["d"]), RUN)
    assert ev.evaluate(run, qrels).first()["ndcg@10"] == pytest.approx(1 / (2 + 1 / math.log2(3)))


def test_judged_only_closes_gaps(rows):
    gains, ranking, qrels, run = random_case(7)
    want = sorted((q, d, i) for q, docs in ranking.items() for i, d in enumerate([d for d in docs if d in gains[q]], 1))
    assert table(ev.judged_only(rows(run, RUN), rows(qrels, QRELS)), "query_id", "document_id", "rank") == want


def test_mappings(rows):
    qrels = rows([("q", "a", 2), ("q", "b", 1), ("q", "c", 0)], QRELS)
    assert table(ev.map_qrels(qrels, "strict_binary", 2), "document_id", "relevance") == [("a", 1), ("b", 0), ("c", 0)]
    assert table(ev.map_qrels(qrels, "broad_binary", 2), "document_id", "relevance") == [("a", 1), ("b", 1), ("c", 0)]
    with pytest.raises(ValueError):
        ev.map_qrels(qrels, "primary", 3)


def test_run_faults(rows):
    bad = rows([("q", "a", 1, 1.0, "t"), ("q", "a", 3, 0.5, "u")], RUN)
    assert {r["fault"] for r in ev.run_faults(bad).collect()} == {"duplicate_document", "rank_gap", "several_tags"}
    assert ev.run_faults(rows(run_rows("q", ["a", "b"]), RUN)).isEmpty()


def test_cross_check_spread(rows):
    values = [0.31274, 0.31301, 0.31299, 0.31262]
    df = rows([(f"tool{i}", "recall", v) for i, v in enumerate(values)], "method string, metric string, value double")
    got = ev.cross_check(df).first()
    assert got["max_delta"] == pytest.approx(max(values) - min(values)) and got["agrees"]
    assert not ev.cross_check(rows([("a", "recall", 0.2), ("b", "recall", 0.9)], "method string, metric string, value double")).first()["agrees"]


def test_holm_against_its_definition(rows):
    rng = random.Random(5)
    values = {f"s{i}": rng.random() ** 3 for i in range(9)}
    ordered, want, top = sorted(values, key=values.get), {}, 0.0
    for i, name in enumerate(ordered):
        top = max(top, min(1.0, (len(values) - i) * values[name]))
        want[name] = top
    df = rows(list(values.items()), "system string, p_value double")
    assert {r["system"]: r["adjusted_p_value"] for r in sg.holm(df).collect()} == pytest.approx(want)


@pytest.mark.parametrize("wins, losses, ties", [(0, 0, 4), (3, 9, 2), (11, 4, 0), (0, 14, 1)])
def test_sign_test_against_the_binomial_tail(rows, wins, losses, ties):
    pairs = [(0.2, 0.7)] * wins + [(0.9, 0.4)] * losses + [(0.3, 0.3)] * ties
    df = rows([(f"t{i}", a, b) for i, (a, b) in enumerate(pairs)], "query_id string, baseline double, candidate double")
    n = wins + losses
    tail = sum(math.comb(n, k) for k in range(losses, n + 1)) / 2**n
    assert sg.sign_test(df).first()["p_value"] == pytest.approx(tail)


def test_student_p_value_against_published_values():
    from rankmill.functions.special import student_two_sided

    for t, df, p in ((2.228, 10, 0.05), (12.706, 1, 0.05), (1.96, 10**6, 0.05), (3.169, 10, 0.01)):
        assert student_two_sided(t, df) == pytest.approx(p, abs=5e-5)


def test_identical_runs_are_not_significant(rows):
    metrics = rows([(s, q, 0.5) for s in "ab" for q in "xyz"], "system string, query_id string, value double")
    got = sg.compare_family(metrics, "a").first()
    assert got["p_value"] == 1.0 and not got["supports"]


def test_ranking_stability_against_sets(rows):
    rng = random.Random(11)
    a = {f"v{i}": rng.sample("klmnopqr", 6) for i in range(8)}
    b = {q: rng.sample(docs, 6) if i % 2 else rng.sample("klmnopqrstu", 6) for i, (q, docs) in enumerate(a.items())}
    frames = [rows([r for q, docs in x.items() for r in run_rows(q, docs)], RUN) for x in (a, b)]
    overlap = sorted(len(set(a[q][:3]) & set(b[q][:3])) / 3 for q in a)
    got = sl.ranking_stability(*frames, 3).first()
    assert got["mean_overlap"] == pytest.approx(sum(overlap) / 8)
    spot = 7 * 0.05
    assert got["p05_overlap"] == pytest.approx(overlap[0] + (overlap[1] - overlap[0]) * spot)
    assert got["top1_agreement"] == pytest.approx(sum(a[q][0] == b[q][0] for q in a) / 8)


def test_ann_recall_and_effort(rows):
    rng = random.Random(13)
    exact = {f"u{i}": rng.sample("abcdefghijkl", 5) for i in range(6)}
    found = {q: docs[: rng.randint(1, 5)] + ["z"] for q, docs in exact.items()}
    frames = [rows([r for q, docs in x.items() for r in run_rows(q, docs)], RUN) for x in (exact, found)]
    want = sum(len(set(exact[q]) & set(found[q][:5])) / 5 for q in exact) / 6
    assert sl.recall_summary(sl.ann_recall(*frames, 5)).first()["mean_recall"] == pytest.approx(want)
    grid = rows([(16, 0.5), (32, 0.97), (48, 0.981), (64, 0.982)], "effort int, recall double")
    assert tuple(sl.pick_effort(grid).first()) == (48, True)
    assert tuple(sl.pick_effort(grid.where("effort < 48")).first()) == (32, False)


def test_first_registered_wins_ties(rows):
    grid = rows([("late", 7, 0.61), ("low", 2, 0.6), ("early", 3, 0.61)], "setting string, position int, value double")
    assert sl.pick_best(grid).first()["setting"] == "early"


def test_guard_and_drift(rows):
    stability = rows([(3, 0.9, 0.7, 0.8)], "queries int, mean_overlap double, p05_overlap double, top1_agreement double")
    assert sl.quality_guard(stability, F.lit(0.5), F.lit(0.495)).first()["status"] == "passed"
    assert sl.quality_guard(stability, F.lit(0.5), F.lit(0.48)).first()["status"] == "failed"


def test_robustness_meets_each_judgment_once(rows):
    """Every mapping and view equals an evaluation of its own, and runs are joined to judgments by document once."""
    from pyspark.sql import functions as F

    from rankmill.operators import evaluation as ev
    from rankmill.operators import significance as sg

    run = rows([(s, f"q{q}", f"d{(q * 7 + r * k) % 40}", r) for k, s in ((3, "a"), (7, "b")) for q in range(4) for r in range(1, 30)], "system string, query_id string, document_id string, rank int")
    qrels = rows([(f"q{q}", f"d{d}", (d * 3 + q) % 3) for q in range(1, 6) for d in range(0, 40, 2)], "query_id string, document_id string, relevance int")
    got = sg.robustness_metrics(run, qrels, 2)
    shown = ["system", "query_id", *(f"`{m}`" for m in ev.METRICS)]
    for mapping in ev.MAPPINGS:
        for view, seen in (("full_corpus", run), ("rerank_within_judged", ev.judged_only(run, qrels, ["system"]))):
            want = ev.evaluate(seen, ev.map_qrels(qrels, mapping, 2), ["system"], 2 if mapping == "primary" else 1, run)
            mine = got.where((F.col("mapping") == mapping) & (F.col("view") == view))
            rounded = lambda df: sorted((r[0], r[1], *(round(x, 9) for x in r[2:])) for r in df.select(*shown).collect())
            assert rounded(mine) == rounded(want) and mine.count() == 10
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line and "document_id" in line for line in plan.splitlines()) == 1


def test_ideal_gain_counts_gains(rows):
    from math import log2

    from rankmill.operators import evaluation as ev

    gains = [2] * 4 + [1] * 7 + [0] * 3 + [None]
    (r,) = ev.ideal_gain(rows([("q", f"d{i}", g) for i, g in enumerate(gains)], "query_id string, document_id string, relevance int")).collect()
    for k in (10, 50):
        assert abs(r[f"__ideal_{k}"] - sum(g / log2(i + 2) for i, g in enumerate(gains[:k]) if g)) < 1e-12
    assert r["__relevant"] == 11
