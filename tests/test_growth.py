"""Steps whose work per row must not grow with the table."""

import hashlib

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from rankmill.functions import vectors as vx
from rankmill.operators import monitoring as mn


def test_error_rate_keeps_a_running_sum(rows):
    rng = np.random.default_rng(8)
    samples = [(k, int(t), int(rng.integers(0, 50)), int(rng.integers(0, 9))) for k in "ab" for t in rng.choice(4000, 300, replace=False)]
    got = mn.error_rate(rows(samples, "k string, t long, total long, errors long"), ["k"], 300)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan  # a moving frame is summed anew for each row
    want = []
    for k in "ab":
        own = sorted(s[1:] for s in samples if s[0] == k)
        steps = [(t, *(n if n < b else n - b for n, b in zip(now, before))) for (_, *before), (t, *now) in zip(own, own[1:])]
        steps.insert(0, (own[0][0], 0, 0))
        want += [(k, t, *(sum(s[i] for s in steps if t - 300 <= s[0] <= t) for i in (1, 2))) for t, _, _ in steps]
    assert table(got, "k", "t", "request_increase", "error_increase") == sorted(want)


def test_running_sums_count_equal_times_together(rows):
    samples = [("a", t, 1) for t in (0, 0, 5, 10, 10, 11, 86_399, 86_400, 86_405, 86_410)]
    got = mn._trailing_sums(rows(samples, "k string, t long, n long"), ["k"], 10, ["n"])
    assert table(got, "t", "__w0") == sorted((t, sum(t - 10 <= s[1] <= t for s in samples)) for _, t, _ in samples)


def test_deterministic_embedding_continues_one_digest(rows):
    made = rows([("x y",), ("",), (None,), ("é" * 90,)], "t string").select("t", vx.deterministic_embedding(F.col("t"), 5).alias("e"))
    assert "sha2" not in made._jdf.queryExecution().toString()
    for text, got in made.collect():
        if text is None:
            assert got is None
            continue
        raw = np.array([int(hashlib.sha256(f"{text}:{i}".encode()).hexdigest()[:4], 16) / 65535 * 2 - 1 for i in range(5)])
        assert got == pytest.approx(raw / np.linalg.norm(raw))


def test_stems_are_made_in_slices_and_positions_meet_in_the_row(spark, rows, monkeypatch):
    from rankmill.functions import text as tx
    from rankmill.plans.registry import QUERIES

    monkeypatch.setattr(tx, "STEM_ROWS", 2)
    monkeypatch.setattr(tx, "STEM_MEMORY", 3)
    texts = [["running", "dogs", "run"], None, [], ["dogs"], ["relational", "running"]]
    made = rows([(i, words) for i, words in enumerate(texts)], "i int, w array<string>").select("i", tx.stems(F.col("w")).alias("s"))
    want = [None if words is None else [tx.porter_stem(w) for w in words] for words in texts]
    assert [r.s for r in sorted(made.collect())] == want
    plan = QUERIES["t13_stemmed_positions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan


def test_words_are_counted_in_the_row(spark, rows, tmp_path):
    from collections import Counter

    from rankmill.functions.sparse import counts_in_row
    from rankmill.plans.tables import Tables

    texts = [["b", "a", "b"], None, [], ["a"], ["c", "b", "a", "a", "a", "c"]]
    made = rows([(i, w) for i, w in enumerate(texts)], "i int, w array<string>").select("i", counts_in_row(F.col("w")).alias("m"))
    assert [r.m for r in sorted(made.collect())] == [dict(Counter(w)) if w else None for w in texts]
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    for name, ids in (("once", (1, 2, 3)), ("shared", (1, 1, 3))):
        data = [(i, t, "en", "s", 1) for i, t in zip(ids, ("x y x", "y z", "--"))]
        spark.createDataFrame(data, docs).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        vectors = Tables(spark, f"{tmp_path}/{name}").sparse_vectors
        want = {"1": {"x": 2.0, "y": 1.0}, "2": {"y": 1.0, "z": 1.0}} if name == "once" else {"1": {"x": 2.0, "y": 2.0, "z": 1.0}}
        assert {r.document_id: r.embedding for r in vectors.collect()} == want
        assert ("Aggregate" in vectors._jdf.queryExecution().analyzed().toString()) == (name == "shared")


def test_log_chunks_have_the_same_number_of_files(spark, monkeypatch):
    import os

    from rankmill.plans import stream_queries as sq
    from rankmill.plans.tables import Tables

    monkeypatch.setattr(sq, "_FILE_ROWS", 30)
    t = Tables(spark, "/root/testdata/sf0.001")
    path = t.scratch("log")
    files = sq.write_log(t, path)
    assert files > 1 and sum(n.endswith(".txt") for n in os.listdir(path)) == sq._CHUNKS * files


def test_runs_are_ranked_in_bounded_parts(spark, monkeypatch):
    from rankmill.plans import tables

    got = {}
    for most in (1_000_000, 1_000, 5):  # all in the default parts, more parts by query, queries that are too large for one
        monkeypatch.setattr(tables, "TASK_ROWS", most)
        t = tables.Tables(spark, "/root/testdata/sf0.001")
        plan = t.pair_numbers._jdf.queryExecution().analyzed().toString()
        assert ("RepartitionByExpression [l_suppkey" in plan) and (("l_partkey#" in plan.split("RepartitionByExpression [")[1].split("]")[0]) == (most == 5))
        parts = int(plan.split("RepartitionByExpression [")[1].split("], ")[1].split()[0].rstrip(","))
        assert parts == max(4, -(-t.raw("lineitem").count() // most))
        if most != 5:
            got[most] = table(t.runs, "system", "query_id", "document_id", "rank", "score")
    assert got[1_000_000] == got[1_000] and len(got[1_000]) > 100
