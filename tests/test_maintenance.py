import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import table
from rankmill.functions.ids import natural_order
from rankmill.operators import changes as ch
from rankmill.operators import joins as jn
from rankmill.operators import monitoring as mn
from rankmill.operators import preparation as pp
from rankmill.operators import radial as rd
from rankmill.operators.ordering import dense_index, exact_percentiles, spanning_sample
from rankmill.streaming import apply as ap

STORE = "store_id long, product_id long, generation_id long, revision long, status string, source_hash string, vector binary"


def entry(revision, status="COMPLETE", source="a", sequence=None, product=1):
    row = (1, product, 1, revision, status, source, b"v")
    return row if sequence is None else (*row, sequence)


@pytest.mark.parametrize(
    "incoming, expected",
    [
        (entry(4, sequence=0), (5, "COMPLETE", "a")),
        (entry(5, sequence=0), (5, "COMPLETE", "a")),
        (entry(6, source="b", sequence=0), (6, "COMPLETE", "b")),
        (entry(5, "DELETED", sequence=0), (5, "DELETED", None)),
        (entry(4, "DELETED", sequence=0), (5, "COMPLETE", "a")),
    ],
)
def test_embedding_revisions(rows, incoming, expected):
    got = ch.apply_embeddings(rows([entry(5)], STORE), rows([incoming], STORE + ", sequence long")).first()
    assert (got["revision"], got["status"]) == expected[:2]
    if expected[2]:
        assert got["source_hash"] == expected[2]


def test_tombstone_beats_save_and_conflicts_are_reported(rows):
    stored = rows([entry(5, "DELETED"), entry(5, product=2)], STORE)
    saves = rows([entry(5, sequence=0), entry(5, source="z", sequence=1, product=2)], STORE + ", sequence long")
    got = {r["product_id"]: r["status"] for r in ch.apply_embeddings(stored, saves).collect()}
    assert got == {1: "DELETED", 2: "COMPLETE"}
    assert table(ch.embedding_conflicts(stored, saves), "product_id", "source_hash", "kept_hash") == [(2, "z", "a")]


def test_replayed_batches_change_nothing(rows, spark, tmp_path):
    path = f"file://{tmp_path}/store"
    batches = [rows([entry(i, sequence=i)], STORE + ", sequence long") for i in (3, 1, 2)]
    for i, batch in enumerate(batches):
        ap.apply_batch(batch, i, path)
    first = table(ap.read_store(spark, path), "product_id", "revision")
    ap.apply_batch(batches[2], 2, path)
    assert table(ap.read_store(spark, path), "product_id", "revision") == first == [(1, 3)]


def test_watermark_stops_at_the_first_gap(rows):
    journal = rows([(1, i, "PENDING" if i in (3, 6) else "COMPLETED") for i in range(1, 9)] + [(2, 4, "COMPLETED"), (3, 1, "PENDING")],
                   "store_id long, change_id long, hybrid_state string")
    assert table(ch.safe_watermark(journal), "store_id", "watermark") == [(1, 2), (2, 4), (3, 0)]


def test_superseded_jobs_hand_over_their_boundary(rows):
    items = rows(
        [(1, 1, 1, "PRIORITY", 7, 10, 10, "PENDING"), (2, 1, 1, "PRIORITY", 7, 20, 20, "PENDING"), (3, 1, 1, "PRIORITY", 8, 15, 15, "COMPLETED")],
        "job_id long, store_id long, generation_id long, lane string, product_id long, revision long, earliest_change_id long, state string",
    )
    assert table(ch.supersede_jobs(items), "job_id", "live_items", "done", "earliest_change_id") == [(1, 0, True, 10), (2, 1, False, 10), (3, 0, True, 15)]


def test_votes_and_conflicts(rows):
    names = {2: "Exact", 1: "Partial", 0: "Irrelevant"}
    data = [(str(q), "p", names[g], i) for q, gains in enumerate(([2], [2, 1], [0, 1], [2, 1, 1])) for i, g in enumerate(gains)]
    judgments = rows(data, "query_id string, product_id string, label string, id int")
    assert table(pp.aggregate_labels(judgments), "query_id", "relevance") == [("0", 2), ("1", 1), ("2", 0), ("3", 1)]
    conflicts = table(pp.label_conflicts(judgments), "query_id", "id", "label", "chosen_gain")
    assert conflicts == [
        ("1", 0, "Exact", 1), ("1", 1, "Partial", 1), ("2", 0, "Irrelevant", 0), ("2", 1, "Partial", 0),
        ("3", 0, "Exact", 1), ("3", 1, "Partial", 1), ("3", 2, "Partial", 1),
    ]


def test_split_is_half_and_order_free(rows):
    ids = [(str(i),) for i in range(8)]
    one = table(pp.hash_split(rows(ids, "query_id string"), "s"), "query_id", "split")
    two = table(pp.hash_split(rows(ids[::-1], "query_id string").repartition(7), "s"), "query_id", "split")
    assert one == two and sum(s == "dev" for _, s in one) == 4


def test_orphan_rate(rows):
    judged = rows([("q", "1"), ("q", "2"), ("q", "2")], "query_id string, product_id string")
    got = pp.orphan_rate(judged, rows([("1",)], "product_id string")).first()
    assert (got["orphan_judgments"], got["orphan_products"], got["within_limit"]) == (2, 1, False)


def test_positions_and_spanning_sample(rows):
    df = rows([(str(i),) for i in list(range(100)) + ["b", "a"]], "id string")
    placed = {r["id"]: r["position"] for r in dense_index(df, natural_order("id")).collect()}
    assert placed["0"] == 0 and placed["99"] == 99 and placed["a"] == 100 and placed["b"] == 101
    assert [r[0] for r in sorted(spanning_sample(df, natural_order("id"), 3).select("position").collect())] == [0, 50, 101]


@pytest.mark.parametrize("bins", [1, 3, 4096])
def test_percentiles_match_both_rules(rows, bins):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=300).round(1), [1e6]])
    df = rows([("hot", float(v)) for v in values] + [("one", 2.0), ("same", 3.0), ("same", 3.0)], "k string, v double")
    linear = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.99}, bins=bins).collect()}
    assert linear["hot"]["a"] == pytest.approx(np.percentile(values, 50))
    assert linear["hot"]["b"] == pytest.approx(np.percentile(values, 95))
    assert linear["hot"]["c"] == pytest.approx(np.percentile(values, 99))
    assert linear["one"]["b"] == 2.0 and linear["same"]["b"] == 3.0
    nearest = {r["k"]: r["b"] for r in exact_percentiles(df, ["k"], "v", {"b": 0.95}, "nearest", bins).collect()}
    assert nearest["hot"] == np.sort(values)[int(np.ceil(301 * 0.95)) - 1]


def test_percentiles_do_not_depend_on_quartile_estimates(spark, rows, monkeypatch):
    """Estimates change from one evaluation to the next, as the parts of a shuffle arrive in any order."""
    import pandas as pd

    @F.pandas_udf("array<double>")
    def estimate(lists: pd.Series) -> pd.Series:
        return lists.map(lambda v: np.sort(np.random.default_rng().choice(v, 3)))

    monkeypatch.setattr(F, "percentile_approx", lambda column, *_: estimate(F.collect_list(column)))
    values = np.random.default_rng(6).normal(size=400)
    df = rows([(f"k{i}", float(v) + i) for i in range(8) for v in values], "k string, v double")
    spark.conf.set("spark.sql.exchange.reuse", "false")  # every mention of the estimates is evaluated
    try:
        got = {r["k"]: r["b"] for r in exact_percentiles(df, ["k"], "v", {"b": 0.95}, "nearest").collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == {f"k{i}": float(np.sort(values)[379]) + i for i in range(8)}


def test_salted_join_equals_plain_join(rows, monkeypatch):
    large = rows([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(50)], "k string, n long")
    small = rows([("hot", "x"), ("hot", "y"), ("k3", "z")], "k string, v string")
    plain = table(large.join(small, "k"), "k", "n", "v")
    monkeypatch.setattr(jn, "fits", lambda *_: False)
    assert table(jn.skew_safe_join(large, small, ["k"], F.col("n"), 8), "k", "n", "v") == plain


def test_closure_of_long_chains_and_rings(rows):
    chain = rows([(i, i + 1) for i in range(90)] + [(i, (i - 200) % 7 + 200) for i in range(201, 207)] + [(200, 206), (300, 300)], "child long, parent long")
    up = lambda *nodes: [r[0] for r in table(jn.ancestors_closure(rows([(n,) for n in nodes], "node long"), chain), "node")]
    assert up(3, 40) == list(range(3, 91))
    assert up(300, 88) == [88, 89, 90, 300]
    ring = rows([(i, (i + 1) % 7) for i in range(7)], "child long, parent long")
    assert [r[0] for r in table(jn.ancestors_closure(rows([(4,)], "node long"), ring), "node")] == list(range(7))
    many = rows([(i, j) for i in range(12) for j in (i + 1, i + 2)], "child long, parent long")
    assert [r[0] for r in table(jn.ancestors_closure(rows([(5,)], "node long"), many), "node")] == list(range(5, 14))


def test_closure_handles_cycles(rows):
    edges = rows([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "child string, parent string")
    assert table(jn.ancestors_closure(rows([("a",)], "node string"), edges), "node") == [("a",), ("b",), ("c",)]


def brute_failures(events, memory):
    runs, out = {}, []
    for store, ts, seq, ok in sorted(events, key=lambda e: (e[1], e[2])):
        count, last = runs.get(store, (0, None))
        if ok:
            runs[store] = (0, None)
            continue
        if last is not None and (ts - last).total_seconds() > memory:
            count = 0
        runs[store] = (count + 1, ts)
        out.append((store, seq, count + 1))
    return sorted(out)


def test_failure_runs_across_days(rows):
    start = dt.datetime(2024, 1, 1, 20)
    rng = np.random.default_rng(6)
    events = [(1 + i % 2, start + dt.timedelta(minutes=int(7 * i)), i, bool(rng.random() < 0.1)) for i in range(600)]
    df = rows(events, "store_id long, ts timestamp, sequence long, success boolean")
    for memory in (10**7, 1200):
        assert table(mn.failure_runs(df, memory_seconds=memory), "store_id", "sequence", "failures") == brute_failures(events, memory)


def test_alert_must_hold(rows):
    df = rows([("a", t, not 600 <= t < 900) for t in range(0, 2000, 60)], "k string, t long, firing boolean")
    held = {r["t"] for r in mn.held_alerts(df, ["k"], 300).collect() if r["held"]}
    assert held == set(range(300, 600, 60)) | set(range(1200, 2000, 60))


def test_counter_reset(rows):
    df = rows([("a", 0, 100, 1), ("a", 60, 150, 2), ("a", 120, 30, 0), ("a", 86_500, 40, 1)], "k string, t long, total long, errors long")
    got = {r["t"]: (r["request_increase"], r["error_increase"]) for r in mn.error_rate(df, ["k"], 300).collect()}
    assert got == {0: (0, 0), 60: (50, 1), 120: (80, 1), 86_500: (10, 1)}


CASES = "min_score double, case_id string, slices array<string>, radial_latency_ms array<double>, exact_total long"
HITS = "min_score double, case_id string, product_id long, score double, exact boolean, radial boolean"


def test_radial_gates(rows):
    cases = rows([(0.8, "a", ["head"], [5.0] * 4, 2), (0.8, "b", ["tail"], [6.0] * 4, 0)], CASES)
    hits = rows([(0.8, "a", 1, 0.9, True, True), (0.8, "a", 2, 0.85, True, True)], HITS)
    none = rows([], "case_id string, product_id long")
    got = rd.calibrate(cases, hits, none).first()
    assert got["eligible"] and got["technical_eligible"] and got["mean_recall"] == 1.0 and got["empty_rate"] == 0.5
    got = rd.calibrate(cases, hits, none, complete=False, representative=False).first()
    assert got["technical_eligible"] and not got["eligible"] and not got["judgments_ok"]
    assert not rd.calibrate(cases, hits, none, registered_scope=False).first()["technical_eligible"]
    wrong = rows([(0.8, "a", 1, 0.9, True, True), (0.8, "a", 2, 0.85, True, False), (0.8, "a", 3, 0.81, False, True)], HITS)
    got = rd.calibrate(cases.where("case_id = 'a'"), wrong, rows([("a", 3), ("a", 2), ("b", 1)], "case_id string, product_id long")).first()
    assert (got["mean_recall"], got["unsafe_hits"], got["false_positives"], got["technical_eligible"]) == (0.5, 1, 1, False)


def test_recall_looks_at_the_first_places_only(rows):
    cases = rows([(0.5, "a", ["x", "x"], [1.0] * 4, 30), (0.5, "b", ["x"], [1.0] * 4, 0)], CASES)
    hits = rows([(0.5, "a", i, 1.0 - i / 100, True, i != 3) for i in range(1, 31)] + [(0.5, "b", 1, 0.6, False, True)], HITS)
    assert table(rd.slice_recall(cases, hits, 5), "slice", "recall", "cases") == [("x", 0.4, 2)]


def test_captures_that_must_not_be_used(rows):
    cases = rows(
        [(0.8, "ok", ["s"], [1.0] * 4, 1), (0.8, "cut", ["s"], [1.0] * 4, 3), (0.8, "few", ["s"], [1.0] * 3, 0), (0.8, "neg", ["s"], [1.0, -1.0, 0.0, 1.0], 0),
         (0.8, "slice", [], [1.0] * 4, 0), (0.8, "twice", ["s"], [1.0] * 4, 0), (0.8, "twice", ["s"], [1.0] * 4, 0), (0.8, "ids", ["s"], [1.0] * 4, 2), (0.8, "null", None, None, None)], CASES)
    hits = rows([(0.8, "ok", 1, 0.9, True, True), (0.8, "ok", 2, 0.9, False, True), (0.8, "cut", 4, 0.9, True, False), (0.8, "ids", 5, 0.9, True, False), (0.8, "ids", 5, 0.9, True, False)], HITS)
    assert table(rd.capture_faults(cases, hits, maximum_results=1), "case_id", "fault") == [
        ("cut", "truncated"), ("few", "latency_samples"), ("ids", "product_ids"), ("neg", "latency_samples"), ("null", "latency_samples"), ("null", "slices"), ("null", "truncated"),
        ("ok", "too_many_results"), ("slice", "slices"), ("twice", "repeated_case"),
    ]


def test_capture_faults_from_counts(rows, spark):
    """The same faults when the hits were counted where they arose; the query exchanges no hit."""
    import os

    import __spark_entry__ as entry

    cases = rows([(0.8, "ok", ["s"], [1.0] * 4, 1), (0.8, "cut", ["s"], [1.0] * 4, 3), (0.8, "ids", ["s"], [1.0] * 4, 2), (0.8, "bad", ["s"], [1.0] * 4, 1), (0.8, "none", ["s"], [1.0] * 4, 0)], CASES)
    hits = [(0.8, "ok", 1, 0.9, True, True), (0.8, "ok", 2, 0.9, False, True), (0.8, "cut", 4, 0.9, True, False), (0.8, "ids", 5, 0.9, True, False), (0.8, "ids", 5, 0.9, True, False), (0.8, "bad", 0, 0.9, True, True)]
    counts = rows([(0.8, "ok", 1, 2, 0, 0), (0.8, "cut", 1, 0, 0, 0), (0.8, "ids", 2, 0, 0, 1), (0.8, "bad", 1, 1, 1, 0)], "min_score double, case_id string, exact long, radial long, bad_ids long, repeated long")
    want = table(rd.capture_faults(cases, rows(hits, HITS), 1), "case_id", "fault")
    assert table(rd.capture_faults(cases, None, 1, counts=counts), "case_id", "fault") == want == [
        ("bad", "product_ids"), ("cut", "truncated"), ("ids", "product_ids"), ("ok", "too_many_results")]
    if os.path.isdir(entry.SMOKE_DIR):
        assert "MapInArrow" not in entry.queries()["e27_capture_faults"](spark, entry.SMOKE_DIR)._jdf.queryExecution().toString()


def test_differing_rows_are_found_by_ranges(rows):
    expected = rows([(i, f"v{i}") for i in range(200)], "k long, v string")
    live = rows([(i, "other" if i in (7, 150) else f"v{i}") for i in range(200) if i not in (0, 99, 199)] + [(-5, "x"), (500, "y")], "k long, v string")
    for ranges in (1, 2, 16, 500):
        assert table(pp.differing_rows(expected, live, "k", ranges), "k", "fault") == [
            (-5, "unexpected"), (0, "missing"), (7, "changed"), (99, "missing"), (150, "changed"), (199, "missing"), (500, "unexpected")]
    assert table(pp.differing_rows(expected, expected, "k", 8), "k", "fault") == []
    assert table(pp.differing_rows(expected.limit(0), live.limit(0), "k"), "k", "fault") == []
    assert len(table(pp.differing_rows(expected.limit(0), live, "k"), "k", "fault")) == 199


def test_order_faults(rows):
    corpus = rows([("a", 0), ("b", 1), ("c", 2)], "product_id string, position long")
    moved = rows([("a", 0), ("c", 1), ("b", 2), ("x", 3)], "product_id string, position long")
    assert table(pp.order_faults(moved, corpus), "product_id", "position") == [("b", 2), ("c", 1), ("x", 3)]


def test_capture_pairs_are_not_stored(spark):
    import os

    import __spark_entry__ as entry
    from rankmill.plans.tables import Tables
    from rankmill.plans.vector_queries import captures

    if not os.path.isdir(entry.SMOKE_DIR):
        pytest.skip("no test tables")
    _, hits = captures(Tables(spark, entry.SMOKE_DIR))
    assert "ExistingRDD" not in hits._jdf.queryExecution().toString()  # what a checkpoint leaves


def test_judgment_faults_of_every_kind(rows):
    pool = rows([("a", i, f"t{i}") for i in range(1, 6)], "case_id string, product_id long, title string")
    labels = rows(
        [("a", 1, "acceptable", "t1"), ("a", 2, "great", "t2"), ("a", 3, "unsafe", "other"), ("a", 4, "unsafe", "t4"), ("a", 4, "unsafe", "t4"), ("b", 1, "unsafe", "t1")],
        "case_id string, product_id long, label string, title string",
    )
    got = table(rd.judgment_faults(pool, labels, ["title"]), "case_id", "product_id", "fault")
    assert got == [("a", 2, "label"), ("a", 3, "context"), ("a", 4, "repeated"), ("a", 5, "missing"), ("b", 1, "not_pooled")]


def test_pairs_that_hold_their_judgments_have_the_same_faults(rows):
    kinds = "case_id string, product_id long, title string, pooled boolean, judgments array<struct<label:string,context:struct<title:string>>>"
    held = [
        ("a", 1, "t1", True, [("acceptable", ("t1",))]), ("a", 2, "t2", True, [("great", ("t2",))]), ("a", 3, "t3", True, [("unsafe", ("other",))]),
        ("a", 4, "t4", True, [("unsafe", ("t4",))] * 2), ("a", 5, "t5", True, []), ("a", 6, "t6", True, None), ("a", 7, None, True, [("unsafe", (None,))]),
        ("b", 1, None, False, [("unsafe", ("t1",))]), ("b", 2, None, False, []),
    ]
    got = table(rd.nested_faults(rows(held, kinds), ["title"]), "case_id", "product_id", "fault")
    assert got == [("a", 2, "label"), ("a", 3, "context"), ("a", 4, "repeated"), ("a", 5, "missing"), ("a", 6, "missing"), ("b", 1, "not_pooled")]


def test_pairs_can_hold_what_their_faults_depend_on(rows):
    held = [("a", 1, 1, "acceptable", False), ("a", 2, 1, "great", False), ("a", 3, 1, "unsafe", True), ("a", 4, 2, "unsafe", False), ("a", 5, 0, None, None), ("a", 6, None, None, None)]
    held = [(*h, True) for h in held] + [("b", 1, 1, "unsafe", False, False), ("b", 2, 0, None, None, False)]
    got = rd.nested_faults(rows(held, "case_id string, product_id long, judged int, label string, altered boolean, pooled boolean"), ["title"])
    assert table(got, "case_id", "product_id", "fault") == [("a", 2, "label"), ("a", 3, "context"), ("a", 4, "repeated"), ("a", 5, "missing"), ("a", 6, "missing"), ("b", 1, "not_pooled")]


def test_unsafe_labels_with_their_thresholds(rows):
    cases = rows([(least, c) for least in (0.5, 0.6) for c in "ab"], "min_score double, case_id string")
    labels = rows([("a", 1, "unsafe"), ("a", 2, "acceptable"), ("b", 1, "unsafe"), ("b", 3, "unsafe")], "case_id string, product_id long, label string")
    want = table(rd.bind_unsafe(cases, labels), "min_score", "case_id", "product_id")
    assert len(want) == 6 and table(rd.bind_unsafe(cases, labels, single=True), "min_score", "case_id", "product_id") == want
    assert table(rd.bind_unsafe(cases, labels.join(cases, "case_id"), single=True), "min_score", "case_id", "product_id") == want


def test_unsafe_pairs_are_not_exchanged(spark):
    import __spark_entry__ as entry

    if not os.path.isdir(entry.SMOKE_DIR):
        pytest.skip("no test tables")
    plan = entry.queries()["e30_bound_unsafe_ids"](spark, entry.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan[: plan.index("MapInArrow")] for x in ("Join", "Aggregate", "Repartition", "Sort", "Distinct"))


@pytest.mark.parametrize("name", ["e29_judgment_pool", "e30_bind_judgments", "e30_bound_unsafe_ids"])
def test_judgment_queries_are_the_same_in_blocks(spark, monkeypatch, tmp_path, name):
    """Also with vector ids that are there twice."""
    import __spark_entry__ as entry
    from rankmill.operators import dense as dn

    if not os.path.isdir(entry.SMOKE_DIR):
        pytest.skip("no test tables")
    few = spark.read.parquet(f"{entry.SMOKE_DIR}/embeddings.parquet").limit(60)
    few.union(few.limit(3)).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.read.parquet(f"{entry.SMOKE_DIR}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    whole = entry.queries()[name](spark, str(tmp_path))
    want = table(whole, *whole.columns)
    assert want
    monkeypatch.setattr(dn, "QUERY_VALUES", 64)
    assert table(entry.queries()[name](spark, str(tmp_path)), *whole.columns) == want


def test_judgment_pairs_are_not_exchanged(spark, monkeypatch):
    """Vectors go to the squares of a grid; after that no pair of a case and a product moves."""
    import __spark_entry__ as entry
    from rankmill.operators import dense as dn

    if not os.path.isdir(entry.SMOKE_DIR):
        pytest.skip("no test tables")
    monkeypatch.setattr(dn, "QUERY_VALUES", 64)
    for name in ("e29_judgment_pool", "e30_bind_judgments"):
        plan = entry.queries()[name](spark, entry.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("MapInArrow")]
        assert not any(x in above for x in ("Join", "Aggregate", "Repartition", "Sort", "Distinct"))
