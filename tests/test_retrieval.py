import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import table
from rankmill.functions import text as tx
from rankmill.functions import vectors as vx
from rankmill.functions.sparse import prune_sparse
from rankmill.operators import dense as dn
from rankmill.operators import fusion as fu
from rankmill.operators import lexical as lx
from rankmill.operators import sparse as sp

DOCS = "document_id string, text string"


@pytest.fixture
def texts(rows):
    docs = rows(
        [("1", "red widget for the home"), ("2", "blue widget widget"), ("10", "home of the red fox and the widget red"),
         ("x", "the fox"), ("y", "")], DOCS,
    )
    return lx.field_texts(docs, "document_id", {"text": "text"})


@pytest.fixture
def queries(rows):
    return rows([("q1", "red widget"), ("q2", "the the fox"), ("q3", "nothing here matches")], "query_id string, query string")


ONE = lx.Profile("one", {"text": 1.0})


def reference_bm25(docs, query):
    words = {d: t.split() for d, t in docs.items() if t}
    n, avg = len(words), np.mean([len(w) for w in words.values()])
    out = {}
    for d, w in words.items():
        total = 0.0
        for term in query.split():
            tf, df = w.count(term), sum(term in v for v in words.values())
            if tf:
                total += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        if total:
            out[d] = round(total, 6)
    return out


def test_bm25_against_brute_force(texts, queries):
    docs = {"1": "red widget for the home", "2": "blue widget widget", "10": "home of the red fox and the widget red", "x": "the fox", "y": ""}
    got = lx.ranked_search(texts, lx.query_terms(queries), [ONE]).collect()
    for query, text in (("q1", "red widget"), ("q2", "the the fox"), ("q3", "nothing here matches")):
        mine = {r["document_id"]: r["score"] for r in got if r["query_id"] == query}
        assert mine == pytest.approx(reference_bm25(docs, text), abs=1e-6)


@pytest.mark.parametrize("profile", [ONE, lx.Profile("all", {"text": 2.0}, operator="and"), lx.Profile("m", {"text": 1.0}, 0.1, minimum_should_match=(2, 0.75))])
def test_matrix_and_join_paths_agree(texts, queries, monkeypatch, profile):
    terms = lx.query_terms(queries)
    columns = ("query_id", "document_id", "rank", "score")
    fast = table(lx.ranked_search(texts, terms, [profile], 2), *columns)
    monkeypatch.setattr(lx, "MATRIX_CELLS", 0)
    assert table(lx.ranked_search(texts, terms, [profile], 2), *columns) == fast


def test_all_words_equals_filtered_bm25(texts, queries):
    terms = lx.query_terms(queries)
    full = lx.bm25(texts, terms).where("matched = terms")
    anchored = lx.bm25_all_words(texts, terms, lx.term_stats(texts))
    columns = ("query_id", "document_id", F.round("score", 9))
    assert table(anchored, *columns) == table(full, *columns)


def test_phrases(texts, rows):
    phrases = lx.phrase_terms(rows([("a", "red widget"), ("b", "widget red"), ("c", "red fox"), ("d", "the red widget")], "query_id string, query string"))
    assert table(lx.phrase_match(texts, phrases), "query_id", "document_id", "frequency") == [
        ("a", "1", 1), ("b", "10", 1), ("c", "10", 1),
    ]
    loose = lx.phrase_match(texts, phrases, slop=1)
    assert ("d", "10") not in table(loose, "query_id", "document_id")
    assert ("a", "1") in table(loose, "query_id", "document_id")


def test_phrase_prefix_and_fuzzy(texts, rows):
    stats = lx.term_stats(texts)
    begun = lx.phrase_prefix_terms(lx.phrase_terms(rows([("a", "red wid")], "query_id string, query string")), stats)
    assert table(lx.phrase_match(texts, begun), "document_id") == [("1",)]
    near = lx.fuzzy_terms(lx.query_terms(rows([("a", "widgit fxo")], "query_id string, query string")), stats)
    assert table(near, "source_term", "term", "edits") == [("widgit", "widget", 1)]


def test_stemmer_and_stacked_positions(rows):
    words = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "motoring": "motor", "probate": "probat",
             "happy": "happi", "generalizations": "gener", "sky": "sky", "controlling": "control"}
    assert {w: tx.porter_stem(w) for w in words} == words
    df = rows([("<b>Running</b> dogs &amp; cats",)], "text string").select(F.inline(tx.stemmed_occurrences(F.col("text"))))
    assert table(df, "position", "term") == [(0, "run"), (0, "running"), (1, "dog"), (1, "dogs"), (2, "cat"), (2, "cats")]


def test_text_functions(rows):
    df = rows([("  Ｆｕｌｌ  ﬁne\tÀ  ",)], "t string")
    assert df.select(tx.canonicalize(F.col("t"))).first()[0] == "full fine à"
    assert df.select(F.lit("Crème brûlée Ǻ")).select(tx.fold(F.lit("Crème brûlée Ǻ"))).first()[0] == "Creme brulee A"
    assert df.select(tx.plain_text(F.lit("<p>a &lt;b&gt;&nbsp; c</p>\n d"))).first()[0] == "a c d"
    unended = "and&amp<i>p</i> &ampx; R&#38D &#38; &#x26; &notit; &middot;"  # only what ends in a semicolon is a reference
    assert df.select(tx.plain_text(F.lit(unended))).first()[0] == "and&ampp &ampx; R&#38D & & &notit; ·"
    model = {"b": 1, "a": "x"}
    import hashlib
    import json

    expected = hashlib.sha256(json.dumps({"document_text": "é\x0b\"", "model": model}, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
    assert df.select(tx.cache_key(F.lit("é\x0b\""), model)).first()[0] == expected


def test_exact_knn_is_brute_force_on_both_plans(spark, rows, monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((200, 8)).astype("f4")
    data[50] = data[7]
    vectors = rows([(str(i), [float(x) for x in v]) for i, v in enumerate(data)], "document_id string, embedding array<float>")
    queries = vectors.withColumnRenamed("document_id", "query_id")
    unit = data.astype("f8") / np.linalg.norm(data.astype("f8"), axis=1, keepdims=True)
    scores = np.round((1 + unit @ unit.T) / 2, 6)
    expected = sorted(
        (str(q), str(d), r) for q in range(200) for r, d in enumerate(sorted(range(200), key=lambda d: (-scores[q][d], d))[:5], 1)
    )
    columns = ("query_id", "document_id", "rank")
    assert table(dn.exact_knn(queries, vectors, 5), *columns) == expected
    monkeypatch.setattr(dn, "QUERY_VALUES", 80)
    monkeypatch.setattr(dn, "STRIPE_VALUES", 400)
    assert table(dn.exact_knn(queries, vectors, 5), *columns) == expected


def test_ann_with_full_effort_is_exact(rows):
    rng = np.random.default_rng(4)
    data = rng.standard_normal((120, 6))
    vectors = rows([(str(i), [float(x) for x in v]) for i, v in enumerate(data)], "document_id string, embedding array<double>")
    queries = vectors.withColumnRenamed("document_id", "query_id")
    centers, assigned = dn.build_cells(vectors, 4)
    found = dn.ann_knn(queries, assigned, centers, 3, 4, group_rows=10)
    columns = ("query_id", "document_id", "rank")
    assert table(found, *columns) == table(dn.exact_knn(queries, vectors, 3), *columns)


@pytest.mark.parametrize("threshold", [0.5, 0.62, 0.75])
def test_radial_search_is_brute_force(rows, threshold):
    rng = np.random.default_rng(21)
    data = rng.standard_normal((60, 5))
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores = np.round((1 + unit @ unit.T) / 2, 6)
    vectors = rows([(f"v{i}", [float(x) for x in v]) for i, v in enumerate(data)], "document_id string, embedding array<double>")
    seeds = vectors.where("document_id < 'v2'").withColumnRenamed("document_id", "query_id")
    names = [r[0] for r in seeds.select("query_id").collect()]
    want = sorted((q, f"v{d}") for q in names for d in range(60) if f"v{d}" != q and scores[int(q[1:]), d] >= threshold)
    assert table(dn.radial_search(seeds, vectors, threshold, 60), "query_id", "document_id") == want


@pytest.mark.parametrize("stripe", [16_000_000, 400])
def test_threshold_pairs_are_all_pairs(rows, monkeypatch, stripe):
    monkeypatch.setattr(dn, "STRIPE_VALUES", stripe)
    rng = np.random.default_rng(31)
    data = rng.standard_normal((70, 4))
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores = np.round((1 + unit @ unit.T) / 2, 6)
    vectors = rows([(f"v{i}", [float(x) for x in v]) for i, v in enumerate(data)], "document_id string, embedding array<double>")
    got = table(dn.threshold_pairs(vectors.withColumnRenamed("document_id", "query_id"), vectors, 0.6), "query_id", "document_id")
    assert got == sorted((f"v{a}", f"v{b}") for a in range(70) for b in range(70) if a != b and scores[a, b] >= 0.6)


def test_percentiles_with_outliers_on_both_sides(rows):
    from rankmill.operators.ordering import exact_percentiles

    rng = np.random.default_rng(32)
    values = {"heavy": [*rng.random(900) * 100, 1e9, -1e12, 5e7], "flat": [3.0] * 40 + [9.0], "one": [7.5], "wide": list(rng.standard_normal(500) * 1e6)}
    df = rows([(k, float(v)) for k, own in values.items() for v in own], "k string, v double")
    got = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", {"p05": 0.05, "p50": 0.5, "p99": 0.99}).collect()}
    for k, own in values.items():
        assert [got[k][n] for n in ("p05", "p50", "p99")] == pytest.approx(list(np.quantile(own, [0.05, 0.5, 0.99])))


def test_vector_helpers(rows):
    df = rows([([3.0, 4.0],)], "v array<double>")
    assert df.select(vx.l2_normalize(F.col("v"))).first()[0] == pytest.approx([0.6, 0.8])
    coded = df.select(vx.to_base64(F.col("v"))).first()[0]
    assert vx.decode_base64_numpy(coded).tolist() == [3.0, 4.0]
    assert df.select(vx.canonical_float32(F.col("v"))).first()[0] == ["40400000", "40800000"]
    bad = rows([([1.0],), ([float("nan"), 0.0],), ([3.0, 4.0],), ([0.6, 0.8],)], "v array<double>")
    assert {r[0] for r in bad.select(vx.vector_fault(F.col("v"), 2, 1e-3)).collect()} == {"dimension", "not_finite", "not_unit_length", None}


def test_sparse_prune_and_search(rows):
    rng = np.random.default_rng(22)
    weights = {f"w{i}": float(x) for i, x in enumerate(np.round(rng.random(30) ** 3, 4))} | {"none": 0.0}
    kept = {k for k, v in weights.items() if v > 0 and v >= 0.25 * max(weights.values())}
    pruned = rows([(weights,)], "m map<string,double>").select(prune_sparse(F.col("m"), 0.25)).first()[0]
    assert set(pruned) == kept and all(pruned[k] == weights[k] for k in kept)
    documents = {f"s{i}": {f"w{j}": float(rng.integers(1, 9)) for j in rng.choice(12, 4, replace=False)} for i in range(25)}
    query = ["w1", "w4", "w4", "w9"]
    want = sorted(((-sum(own.get(t, 0.0) for t in set(query)), d) for d, own in documents.items()), key=lambda x: (x[0], x[1]))
    want = [(d, -v) for v, d in want if v < 0]
    vectors = rows(list(documents.items()), "document_id string, embedding map<string,double>")
    got = sp.sparse_search(rows([("q", t) for t in query], "query_id string, token string"), vectors, 25)
    assert [(r["document_id"], r["score"]) for r in got.orderBy("rank").collect()] == want


SCORED = "query_id string, document_id string, score double"


def test_minmax_edges(rows):
    one = rows([("q", "a", 5.0)], SCORED)
    other = rows([("q", "a", 2.0), ("q", "b", 2.0), ("q", "c", 2.0)], SCORED)
    assert table(fu.minmax_fuse([one, other], (0.3, 0.7)), "document_id", "rank", "score") == [("a", 1, 1.0), ("b", 2, 0.7), ("c", 3, 0.7)]
    for weights in ((0.5, 0.6), (1.0,), (-0.1, 1.1), (float("nan"), 1.0)):
        with pytest.raises(ValueError):
            fu.minmax_fuse([one, other], weights)
    with pytest.raises(ValueError):
        fu.rrf_fuse([one], 0)


def test_rerank_orders_the_head_and_keeps_the_tail(rows):
    rng = np.random.default_rng(23)
    docs = [f"r{i}" for i in range(12)]
    values = {d: float(v) for d, v in zip(docs[:8], rng.permutation(8))}
    run = rows([("q", d, i, 0.0, "t") for i, d in enumerate(docs, 1)], "query_id string, document_id string, rank int, score double, tag string")
    got = fu.rerank(run, rows([("q", d, v) for d, v in values.items()], SCORED), depth=8, result_depth=12).orderBy("rank").collect()
    assert [r["document_id"] for r in got] == sorted(values, key=values.get, reverse=True) + docs[8:]
    assert all(a["score"] > b["score"] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("size", [7, 24, 100])
def test_pages_show_every_product_once(rows, size):
    native = rows([("q", str(i), i) for i in range(1, 200)], "query_id string, document_id string, rank int")
    head = native.where("rank <= 100").withColumn("rank", 101 - F.col("rank"))
    seen = []
    for start in range(0, 99, size):
        request = rows([("q", start, size)], "query_id string, start int, size int")
        seen += [r["document_id"] for r in fu.page(head, native, request).orderBy("position").collect()]
    assert len(seen) == len(set(seen))
    assert seen[:100] == [str(100 - i) for i in range(100)]
    assert seen[100:] == [str(i) for i in range(101, 101 + len(seen) - 100)]


def test_sparse_search_scores_vectors_where_they_lie(rows, monkeypatch):
    from rankmill.operators import sparse as sp

    vectors = rows(
        [(str(i), {"all": 1.0, f"t{i % 3}": float(i % 5) - 1.0, "odd": 0.5} if i % 2 else {"all": 1.0, f"t{i % 3}": 2.0}) for i in range(40)] + [("none", {}), ("null", None)],
        "document_id string, embedding map<string,double>",
    )
    tokens = rows([("a", "all"), ("a", "t1"), ("a", "t1"), ("b", "odd"), ("b", "t2"), ("c", "unknown")], "query_id string, token string")
    found = sp.sparse_search(tokens, vectors, 7)
    assert "MapInPandas" in found._jdf.queryExecution().toString()
    monkeypatch.setattr(sp, "HELD_CELLS", 0)
    joined = sp.sparse_search(tokens, vectors, 7)
    columns = ("query_id", "document_id", "rank", "score")
    assert table(found, *columns) == table(joined, *columns) and {r.query_id for r in found.collect()} == {"a", "b"}
    assert sp.sparse_search(tokens.where("query_id = 'c'"), vectors, 7).count() == 0
