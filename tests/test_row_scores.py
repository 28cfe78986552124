"""Scoring inside rows against the join paths, brute force and the plans it must have."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill.functions import row_scores
from rankmill.functions.topk import natural_rows
from rankmill.operators import dense as dn
from rankmill.operators import facets as fc
from rankmill.operators import lexical as lx
from conftest import table

WORDS = "red blue widget fox the and of home lamp chair oak".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = [(str(i), " ".join(rng.choices(WORDS, k=rng.randint(0, 30))), " ".join(rng.choices(WORDS, k=rng.randint(0, 4))), rng.choice("abc"), rng.choice(["x", "y", None, ""])) for i in range(300)]
    return spark.createDataFrame(rows + [("n", None, None, None, "x"), ("long", "lamp oak " * 3000, "fox", "a", "y")], "id string, body string, title string, kind string, maker string").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(9)
    return spark.createDataFrame([(f"q{i}", " ".join(rng.choices(WORDS + ["nowhere"], k=rng.randint(1, 4)))) for i in range(40)] + [("e", ""), ("z", None)], "query_id string, query string")


FIELDS = {"title": "title", "body": "body"}
GRID = [lx.Profile("p", {"title": 3.0, "body": 1.0}, 0.2), lx.Profile("and", {"title": 1.0, "body": 2.0}, 0.0, "and"), lx.Profile("m", {"body": 1.0}, 0.1, minimum_should_match=(2, 0.75))]


def rounded(df, *columns):
    return table(df, *[F.round(c, 9) if c == "score" else F.col(c) for c in columns])


def on_both_paths(monkeypatch, build):
    inside = build()
    monkeypatch.setattr(lx, "ROW_ENTRIES", 0)
    monkeypatch.setattr(fc, "ROW_ENTRIES", 0)
    joined = build()
    monkeypatch.undo()
    return inside, joined


def test_pairs_all_words_and_fuzzy_agree_with_joins(spark, corpus, queries, monkeypatch):
    texts, terms = lx.field_texts(corpus, "id", FIELDS), lx.query_terms(queries)
    columns = ("query_id", "field", "document_id", "score", "matched", "terms")
    for build in (lambda: lx.bm25(texts, terms), lambda: lx.bm25_all_words(texts, terms, lx.term_stats(texts)), lambda: lx.fuzzy_bm25(texts, terms)):
        inside, joined = on_both_paths(monkeypatch, lambda build=build: rounded(build(), *columns))
        assert inside == joined and inside
    monkeypatch.setattr(row_scores, "PAIRS", 7)  # many small blocks
    small = [b for b in row_scores._blocks(np.repeat(np.arange(9), 3), np.full(27, 2), 7)]
    assert small[0][0] == 0 and small[-1][1] == 27 and all(a[1] == b[0] for a, b in zip(small, small[1:]))


def test_fuzzy_search_keeps_its_best_inside_the_task(corpus, monkeypatch, spark):
    texts = lx.document_texts(corpus, "id", FIELDS)
    asked = spark.createDataFrame([("a", "widgte lamp lamp"), ("b", "chairs foxy"), ("c", "hone oaks blve"), ("d", "nowhere"), ("e", None)], "query_id string, query string")
    inside, joined = on_both_paths(monkeypatch, lambda: table(lx.fuzzy_search(texts, lx.query_terms(asked), GRID[0], 7), "query_id", "document_id", "rank", "score"))
    assert inside == joined and len(inside) == 21
    plan = lx.fuzzy_search(texts, lx.query_terms(asked), GRID[0], 7)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # no pair is exchanged before the best are kept


def test_phrases_agree_with_joins(corpus, queries, monkeypatch):
    texts, phrases = lx.document_texts(corpus, "id", FIELDS), lx.phrase_terms(queries)
    for slop in (0, 1, 3):
        inside, joined = on_both_paths(monkeypatch, lambda slop=slop: table(lx.phrase_match(texts, phrases, slop), "query_id", "field", "document_id", "frequency", "length"))
        assert inside == joined and inside


def test_profiles_and_clauses_agree_with_joins(corpus, queries, monkeypatch):
    wide, long, terms = lx.document_texts(corpus, "id", FIELDS), lx.field_texts(corpus, "id", FIELDS), lx.query_terms(queries)
    columns = ("profile", "query_id", "document_id", "rank", "score")
    for added in (None, "sum"):
        inside, joined = on_both_paths(monkeypatch, lambda added=added: table(lx.ranked_search(wide, terms, GRID, 7, added=added), *columns))
        assert inside == joined
        assert table(lx.ranked_search(long, terms, GRID, 7, added=added), *columns) == inside
    monkeypatch.setattr(lx, "BLOCK_CELLS", 1)
    assert table(lx.ranked_search(wide, terms, GRID, 7), *columns) == table(lx.ranked_search(long, terms, GRID, 7), *columns)


def test_matching_pairs_against_brute_force(corpus, queries, monkeypatch):
    texts, terms = lx.document_texts(corpus, "id", FIELDS), lx.query_terms(queries)
    columns = ("query_id", "field", "document_id", "matched", "occurrences")
    inside, joined = on_both_paths(monkeypatch, lambda: table(lx.matching_pairs(texts, terms, ["body"]), *columns))
    want = []
    for q in queries.collect():
        words = set((q.query or "").split())
        for d in corpus.collect():
            body = (d.body or "").split()
            hit = [w for w in body if w in words]
            if hit:
                want.append((q.query_id, "body", d.id, len(set(hit)), len(hit)))
    assert inside == joined == sorted(want)


def test_facets_agree_with_joins_and_brute_force(corpus, queries, monkeypatch):
    texts, terms = lx.document_texts(corpus, "id", FIELDS, keep=("kind", "maker")), lx.query_terms(queries)
    build = lambda: table(fc.lexical_facet_counts(texts, terms, ["title", "body"], "x", ("kind", "maker"), "maker"), "query_id", "state", "field", F.coalesce("key", F.lit("~")), "documents")
    inside, joined = on_both_paths(monkeypatch, build)
    want = {}
    for q in queries.collect():
        words = set((q.query or "").split())
        for d in corpus.collect():
            if words & set(f"{d.body or ''} {d.title or ''}".split()):
                for state in ("unfiltered", "filtered")[: 2 if d.maker == "x" else 1]:
                    for field, key in (("", ""), ("kind", d.kind), ("maker", d.maker)):
                        at = (q.query_id, state, field, "~" if key is None else key)
                        want[at] = want.get(at, 0) + 1
    assert inside == joined == sorted((*k, v) for k, v in want.items())


def test_containing_against_brute_force(spark, corpus, monkeypatch):
    rows = [(r.id, r.body) for r in corpus.collect()] + [("u", "Ein Été  #1 (of) red-fox; redfox"), ("v", "x red fox the\nlamp")]
    docs = spark.createDataFrame(rows, "document_id string, text string").repartition(4)
    rng = random.Random(1)
    asked = [("a", "té  #1 (of) red"), ("b", "red fox the\nla"), ("c", "fox"), ("d", "d f"), ("e", ""), ("f", "edfo"), ("g", "(of) red-fox; redf")]
    for i in range(40):
        text = rng.choice([t for _, t in rows if t])
        start = rng.randrange(len(text))
        asked.append((f"s{i}", text[start : start + rng.randint(1, 60)]))
    queries = spark.createDataFrame(asked, "query_id string, query string")
    want = sorted((q, d) for q, query in asked for d, text in rows if query and text and query in text)
    assert table(lx.containing(docs, queries), "query_id", "document_id") == want
    monkeypatch.setattr(lx, "ROW_ENTRIES", 100)  # several slices of the queries
    assert table(lx.containing(docs, queries), "query_id", "document_id") == want


def exchanged(df):
    """The output columns of every exchange in the plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"\bExchange (hash|range|round|single)", line, re.I)], plan


def test_no_text_or_word_is_exchanged(spark, tmp_path, corpus, queries):
    path = str(tmp_path / "texts")
    corpus.write.parquet(path)
    docs, terms = spark.read.parquet(path), lx.query_terms(queries)
    texts = lx.document_texts(docs, "id", FIELDS)
    for found in (lx.ranked_search(texts, terms, GRID, 5), lx.bm25(texts, terms).groupBy("query_id").count(), lx.term_stats(texts, terms), lx.phrase_match(texts, lx.phrase_terms(queries)), lx.containing(docs.selectExpr("id document_id", "body text"), queries)):
        moves, plan = exchanged(found)
        for line in moves:
            assert not re.search(r"\b(body|title|occurrences|words|fields)#", line), line
        above = plan.split("MapInArrow")[-1] if "MapInArrow" in plan else ""
        assert "Exchange" not in above  # nothing moves between the scan and the scores


def vectors(spark, n, seed, spread, dims=16):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(6, dims))
    rows = [(str(i), [float(x) for x in heads[rng.integers(6)] + spread * rng.normal(size=dims)]) for i in range(n)]
    return rows + [("zero", [0.0] * dims), ("same", rows[0][1])]


def brute(queries, rows, least):
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    out = []
    for q, a in queries:
        for d, b in rows:
            if q != d and any(a) and any(b):
                score = np.floor((1 + unit(a) @ unit(b)) / 2 * 1e6 + 0.5) / 1e6
                if score >= least:
                    out.append((q, d))
    return sorted(out)


@pytest.mark.parametrize("least", [0.55, 0.6, 0.97])
def test_threshold_joins_equal_brute_force(spark, monkeypatch, least):
    rows = vectors(spark, 220, 3, 0.25)
    frame = spark.createDataFrame(rows, "document_id string, embedding array<double>").repartition(4)
    queries = frame.withColumnRenamed("document_id", "query_id")
    want = brute(rows, rows, least)
    assert table(dn.threshold_pairs(queries, frame, least), "query_id", "document_id") == want
    counts = dn.skipped_cells(queries, frame, least).first()
    assert counts.skipped > (0.5 if least > 0.9 else 0.2) * (counts.skipped + counts.compared)
    monkeypatch.setattr(dn, "QUERY_VALUES", 16)
    monkeypatch.setattr(dn, "PART_QUERIES", 9)
    monkeypatch.setattr(dn, "PART_VECTORS", 11)
    assert table(dn.threshold_pairs(queries, frame, least), "query_id", "document_id") == want


def test_pairs_carry_columns_of_both_sides(spark, monkeypatch):
    rows = vectors(spark, 60, 3, 0.25)
    frame = spark.createDataFrame(rows, "document_id string, embedding array<double>").withColumn("title", F.concat(F.lit("t"), "document_id")).repartition(4)
    queries = frame.select(F.col("document_id").alias("query_id"), "embedding", F.length("document_id").alias("size"))
    want = [(q, len(q), d, f"t{d}") for q, d in brute(rows, rows, 0.6)]
    for limit in (2_000_000, 16):
        monkeypatch.setattr(dn, "QUERY_VALUES", limit)
        got = dn.threshold_pairs(queries, frame, 0.6, carry=["size", "title"])
        assert table(got, "query_id", "size", "document_id", "title") == sorted(want)
    # a vector has as many copies as the grid has rows, not one for each cell it can reach
    sides = dn._threshold_grid(queries, frame).groupBy("document_id").count().where("document_id is not null")
    assert sides.where("count > 5").isEmpty()


def test_large_sets_meet_in_blocks_without_copies(spark, monkeypatch):
    """Both sides are packed once and every block meets every other one: no row is sorted, copied or exchanged for that."""
    monkeypatch.setattr(dn, "QUERY_VALUES", 16)
    monkeypatch.setattr(dn, "PART_QUERIES", 7)
    monkeypatch.setattr(dn, "PART_VECTORS", 5)
    rows = vectors(spark, 90, 3, 0.25)
    frame = spark.createDataFrame(rows, "document_id string, embedding array<float>").repartition(9)
    rows = [(r.document_id, list(r.embedding)) for r in frame.collect()]
    found = dn.threshold_pairs(frame.withColumnRenamed("document_id", "query_id"), frame, 0.6)
    assert table(found, "query_id", "document_id") == brute(rows, rows, 0.6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and not any(x in plan for x in ("Exchange", "Sort", "Generate"))
    packed = dn._packed(frame, "d", 5).selectExpr("size(document_id) n", "explode(document_id) id")
    assert sorted(r.id for r in packed.collect()) == sorted(r[0] for r in rows) and packed.where("n > 5").isEmpty()


def test_pairs_of_wanted_kinds(spark, monkeypatch):
    monkeypatch.setattr(dn, "PART_QUERIES", 7)
    rows = [r for r in vectors(spark, 80, 3, 0.25)]
    number = {d: i for i, (d, _) in enumerate(rows)}
    frame = spark.createDataFrame([(d, number[d], v) for d, v in rows], "document_id string, number int, embedding array<double>").repartition(3)
    kinds = (np.arange(3)[:, None] + np.arange(4)[None, :]) % 3 == 1
    found = dn.threshold_pairs(
        frame.select(F.col("document_id").alias("query_id"), "embedding", (F.col("number") % 3).alias("kind")),
        frame.withColumn("kind", F.col("number") % 4), 0.6, carry=["number"], columns=["query_id", "number", "document_id"], kinds=kinds,
    )
    assert found.columns == ["query_id", "number", "document_id"]
    want = [(q, number[d], d) for q, d in brute(rows, rows, 0.6) if kinds[number[q] % 3, number[d] % 4]]
    assert table(found, *found.columns) == sorted(want)


def test_radial_search_skips_without_loss(spark):
    rows = vectors(spark, 150, 8, 0.4)
    frame = spark.createDataFrame(rows, "document_id string, embedding array<double>").repartition(3)
    found = dn.radial_search(frame.withColumnRenamed("document_id", "query_id"), frame, 0.6, 1000)
    assert table(found, "query_id", "document_id") == brute(rows, rows, 0.6)


def test_byte_codes_bound_scores_and_keep_the_nearest(spark):
    rows = vectors(spark, 300, 5, 0.5)
    frame = spark.createDataFrame(rows, "document_id string, embedding array<double>").repartition(3)
    centers, assigned = dn.build_cells(frame.where("document_id <> 'zero'"), 4)
    unit = {d: np.asarray(v) / np.linalg.norm(v) for d, v in rows if any(v)}
    for r in dn.encode_cells(assigned, centers).collect():
        near = centers[r.cell] + np.frombuffer(r.code, np.int8) * r.scale
        assert np.abs(near - unit[r.document_id]).max() <= r.scale / 2 + 1e-12
    queries = frame.where("document_id <> 'zero'").withColumnRenamed("document_id", "query_id")
    exact = table(dn.exact_knn(queries, frame, 5), "query_id", "document_id", "rank")
    assert table(dn.ann_knn(queries, assigned, centers, 5, 4), "query_id", "document_id", "rank") == exact
    assert table(dn.ann_knn(queries, assigned, centers, 5, 4, group_rows=13, group_queries=7), "query_id", "document_id", "rank") == exact


@pytest.mark.parametrize("size", [None, 11])
def test_efforts_probe_their_cells_only_and_completely(spark, monkeypatch, size):
    """Several efforts in one pass, with copies and a zero vector; vectors and queries are stored once and no candidate is joined."""
    if size:
        monkeypatch.setattr(dn, "STORED_ROWS", 60)
    rows = [r for r in vectors(spark, 160, 5, 0.5)]
    rows += [(f"{i}", rows[3][1]) for i in range(9000, 9014)]
    frame = spark.createDataFrame(rows, "document_id string, embedding array<double>").repartition(3)
    centers, assigned = dn.build_cells(frame.where("document_id <> 'zero'"), 5)
    assigned = spark.createDataFrame(assigned.select("document_id", "embedding", "cell").collect(), "document_id string, embedding array<double>, cell int").repartition(3)
    cells, direction = {r.document_id: r.cell for r in assigned.collect()}, np.stack(centers) / np.linalg.norm(np.stack(centers), axis=1, keepdims=True)
    unit = {d: np.asarray(v) / np.linalg.norm(v) for d, v in rows if any(v)}
    order = {d: i for i, d in enumerate(natural_rows(np.array(list(unit), dtype=object))["text"])}
    want = []
    for q, v in unit.items():
        probed = np.argsort(-(direction @ v))
        for effort in (1, 2, 4, 9):
            near = [(-np.floor((1 + unit[d] @ v) / 2 * 1e6 + 0.5) / 1e6, order[d], d) for d in unit if cells[d] in set(probed[:effort].tolist())]
            want += [(effort, q, d, rank) for rank, (_, _, d) in enumerate(sorted(near)[:6], 1)]
    queries = frame.withColumnRenamed("document_id", "query_id")
    found = dn.ann_runs(queries, assigned, centers, 6, (2, 1, 9, 4), **({"group_rows": size, "group_queries": size} if size else {}))
    assert table(found, "effort", "query_id", "document_id", "rank") == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and not any(x in plan for x in ("MergeJoin", "HashJoin", "CoGroup"))


def test_local_best_lists_stay_small():
    from rankmill.functions.topk import LocalTopK

    rng = np.random.default_rng(0)
    best = LocalTopK([str(i) for i in range(50)], 10, 6)
    every = []
    for block in range(80):
        ids = np.array([f"{block * 100 + i}" for i in range(100)], dtype=object)
        scores = np.round(rng.random((100, 50)), 2)
        every.append((ids, scores))
        best.add(ids, scores)
        assert best.rows <= 3 * 10 * 50 + 100_000 + 50 * 100
    got = best.frame()
    ids, scores = np.concatenate([i for i, _ in every]), np.concatenate([s for _, s in every])
    for q in range(50):
        want = sorted(range(len(ids)), key=lambda i: (-scores[i, q], int(ids[i])))[:10]
        assert got[got.query_id == str(q)].document_id.tolist() == [ids[i] for i in want]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_words_equal_all_distances(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abé", k=n))

    def edited(w):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("abc") + w[i:], w[:i] + rng.choice("abc") + w[i + 1 :]))
        return w or "a"

    terms = sorted({word(n) for n in (1, 2, 3, 4, 5, 6, 7, 9, 12, 29, 30, 31, 32, 45, 60) for _ in range(4)})
    words = sorted({edited(t) for t in terms for _ in range(6)} | {word(rng.randint(1, 8)) for _ in range(200)} | {"a" * 3000})
    bound = {t: 0 if len(t) < 3 else 1 if len(t) < 6 else 2 for t in terms}
    asked = spark.createDataFrame([(t, bound[t]) for t in terms], "term string, bound int")
    want = sorted((t, w, d) for t in terms for w in words if t[0] == w[0] and abs(len(t) - len(w)) <= 2 and (d := distance(t, w)) <= bound[t])
    assert table(lx.near_words(asked, spark.createDataFrame([(w,) for w in words], "word string")), "term", "word", "edits") == want
