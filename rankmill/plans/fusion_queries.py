"""Fusion, reranking, paging and facet queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmill.functions.vectors import hash_embedding
from rankmill.operators import dense as dn
from rankmill.operators import facets as fc
from rankmill.operators import filters as ft
from rankmill.operators import fusion as fu
from rankmill.operators import lexical as lx
from rankmill.operators import sparse as sp
from rankmill.operators.evaluation import evaluate, mrr_exact
from rankmill.operators.ordering import retag
from rankmill.operators.significance import sign_test
from rankmill.operators.selection import pick_best
from rankmill.plans.lexical_queries import KNOWN_SQL, known_item_queries, known_item_run, with_more
from rankmill.plans.oracle import BEST, fused, ranked, squeeze, tok, with_
from rankmill.plans.registry import query
from rankmill.session import cut_lineage

SCORED = "query_id:s document_id:s rank:i score:f6"


def lexical_run(t):
    return lx.ranked_search(t.doc_texts, t.terms, [lx.Profile("bm25", {"text": 1.0})]).drop("profile")


def dense_run(t):
    return dn.exact_knn(t.query_vectors, t.doc_vectors, 100)


def sparse_run(t):
    return sp.sparse_search(t.query_tokens, t.sparse_vectors, 100)


@query("h01_minmax_fuse", SCORED, with_("lexrun denserun", fused(["lexrun", "denserun"], [0.3, 0.7])))
def _(t):
    return fu.minmax_fuse([lexical_run(t), dense_run(t)], (0.3, 0.7))


_GRID = {f"w{int(w * 100):03d}": (w, round(1 - w, 2)) for w in (0.2, 0.3, 0.4, 0.5, 0.6)}


def _run_sql(system: str) -> str:
    return f"(SELECT query_id, document_id, score FROM runs WHERE system = '{system}')"


@query(
    "h01_weight_grid", "setting:s query_id:s document_id:s rank:i score:f6",
    with_("runs", " UNION ALL ".join(
        f"SELECT '{name}' AS setting, * FROM ({fused([_run_sql('quantity'), _run_sql('price')], list(w), 20)})" for name, w in _GRID.items())),
)
def _(t):
    return fu.minmax_grid([t.run("quantity"), t.run("price")], _GRID, 20)


@query("h02_three_way_fuse", SCORED, with_("lexrun denserun sparserun", fused(["lexrun", "denserun", "sparserun"], [0.2, 0.5, 0.3])))
def _(t):
    return fu.minmax_fuse([lexical_run(t), dense_run(t), sparse_run(t)], (0.2, 0.5, 0.3))


@query(
    "h03_rrf_fuse", "query_id:s document_id:s rank:i score:f9",
    with_("runs", ranked("(SELECT query_id, document_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM runs GROUP BY 1, 2)", "query_id", BEST, 100)),
)
def _(t):
    return fu.rrf_fuse([t.run(s) for s in ("quantity", "price", "discount")], 60)


_CANDIDATE_CTES = (
    "own AS (SELECT l.query_id, l.document_id, (1 + coalesce(s, 0)) / 2 AS score FROM lexrun l SEMI JOIN dvec USING (document_id) "
    "LEFT JOIN (SELECT query_id, document_id, sum(q.v * d.v) AS s FROM qvec q JOIN dvec d USING (bucket) GROUP BY 1, 2) x USING (query_id, document_id)), "
)


@query(
    "h04_candidate_rerank", SCORED,
    with_more("lexrun qvec dvec", _CANDIDATE_CTES.rstrip(", "), fused(["lexrun", "own"], [0.3, 0.7])),
)
def _(t):
    candidates = cut_lineage(lexical_run(t))
    vectors = hash_embedding(dn.wanted_documents(t.docs, candidates), "document_id", "text")
    dense = dn.candidate_scores(candidates, t.query_vectors, vectors)
    return fu.candidate_rerank(candidates, dense)


@query(
    "h05_universe_faults", "query_id:s document_id:s fault:s",
    with_("runs", "SELECT query_id, document_id, CASE WHEN rank % 9 = 0 THEN 'missing' WHEN rank % 9 = 1 THEN 'duplicate' WHEN rank % 9 = 2 THEN 'bad_score' ELSE 'unexpected' END AS fault FROM runs WHERE system = 'price' AND (rank % 9 <= 2 OR rank % 9 = 3)"),
)
def _(t):
    run, r = t.run("price"), F.col("rank") % 9
    candidates = run.where(r != 3)
    shown = run.where(r != 0).withColumn("score", F.when(r == 2, -1.0).otherwise(F.col("score")))
    return fu.universe_faults(candidates, shown.unionByName(shown.where(F.col("rank") % 9 == 1)))


_SALABLE = "SELECT r.query_id, r.document_id, p.is_salable, row_number() OVER (PARTITION BY query_id ORDER BY is_salable DESC, rank) AS rank FROM runs r JOIN products p USING (document_id) WHERE system = 'price'"


@query("h06_salable_first", "query_id:s document_id:s is_salable:b rank:i", with_("runs products", _SALABLE))
def _(t):
    return fu.salable_first(t.run("price"), t.products)


@query(
    "h07_page", "query_id:s document_id:s position:i",
    with_("pair_values products", "SELECT query_id, document_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS position FROM ("
          f"SELECT query_id, document_id, 0 AS part, row_number() OVER (PARTITION BY query_id ORDER BY is_salable DESC, rank) AS rank FROM ({ranked('(SELECT query_id, document_id, price AS score FROM pair_values)', 'query_id', BEST, 199)}) JOIN products USING (document_id) WHERE rank <= 100 "
          f"UNION ALL SELECT query_id, document_id, 1, rank FROM ({ranked('(SELECT query_id, document_id, price AS score FROM pair_values)', 'query_id', BEST, 199)}) WHERE rank > 100 AND rank <= greatest(100, least(199, CAST(query_id AS BIGINT) % 5 * 30 + 24))"
          ")) WHERE position > CAST(query_id AS BIGINT) % 5 * 30 AND position <= CAST(query_id AS BIGINT) % 5 * 30 + 24"),
)
def _(t):
    from rankmill.operators.ordering import score_order, top_k

    native = top_k(t.pair_values.select("query_id", "document_id", F.col("price").alias("score")), ["query_id"], score_order(), 199)
    reranked = fu.salable_first(native.where(F.col("rank") <= 100), t.products)
    requests = t.raw("supplier").selectExpr("cast(s_suppkey as string) query_id", "s_suppkey % 5 * 30 start", "24 size")
    return fu.page(reranked, native, requests)


_ROUTE_CTES = (
    KNOWN_SQL + ", routes AS (SELECT q.query_id, "
    f"CASE WHEN starts_with({squeeze('q.query')}, 'rw-') THEN 'lexical_only_sku' WHEN {squeeze('q.query')} <> '' AND {squeeze('q.query')} = {squeeze('p.title')} THEN 'lexical_only_exact_title' ELSE 'hybrid' END AS route "
    "FROM phrases q LEFT JOIN knownrun k ON k.query_id = q.query_id AND k.rank = 1 LEFT JOIN products p ON p.document_id = k.document_id)"
)


def routed(t, queries, lexical):
    top = lexical.where(F.col("rank") == 1).select("query_id", "document_id").join(
        t.products.select("document_id", "title"), "document_id"
    )
    return cut_lineage(
        queries.join(top, "query_id", "left").select(
            "query_id", ft.known_item_route(F.col("query"), F.col("title"), "RW").alias("route")
        )
    )


@query("f06_known_item_route", "query_id:s route:s",
       with_more("products ptok pdf ptf plen pstat", _ROUTE_CTES, "SELECT * FROM routes"))
def _(t):
    return routed(t, known_item_queries(t), known_item_run(t))


_MIXED = (
    "mixq AS (SELECT query_id, query FROM phrases), "
    f"mtok AS (SELECT DISTINCT query_id, unnest({tok('query')}) AS term FROM mixq), "
    "mtf AS (SELECT document_id, term, count(*) AS tf FROM (SELECT document_id, unnest(toks) AS term FROM ptok) GROUP BY 1, 2), "
    f"mrun AS ({ranked('(SELECT query_id, document_id, CAST(sum(tf) AS DOUBLE) AS score FROM mtok JOIN mtf USING (term) GROUP BY 1, 2)', 'query_id', BEST, 10)})"
)
# Query texts of the routing example: SKUs, exact titles, and titles with a brand.
_GUARD_Q = "SELECT DISTINCT 'b-' || title || ' ' || brand, title || ' ' || brand FROM products"
_GUARD_CTES = _ROUTE_CTES.replace("SELECT DISTINCT 't-' || title, title FROM products", "SELECT DISTINCT 't-' || title, title FROM products UNION ALL " + _GUARD_Q)


def guard_queries(t):
    branded = t.products.select(
        F.concat(F.lit("b-"), "title", F.lit(" "), "brand").alias("query_id"), F.concat_ws(" ", "title", "brand").alias("query")
    ).distinct()
    return known_item_queries(t).unionByName(branded)


def guarded(t):
    queries = guard_queries(t)
    lexical = cut_lineage(known_item_run(t, queries))
    from rankmill.functions.text import tokenize
    from rankmill.plans.tables import PRODUCT_FIELDS

    words = tokenize(F.concat_ws(" ", *PRODUCT_FIELDS))
    counts = t.products.select("document_id", F.explode(words).alias("token")).groupBy("document_id", "token").agg(
        F.count(F.lit(1)).cast("double").alias("w")
    )
    vectors = counts.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("embedding"))
    tokens = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("token"))
    fused_run = fu.minmax_fuse([lexical, sp.sparse_search(tokens, vectors, 10)], (0.3, 0.7), 10, 10)
    return fu.guarded_search(routed(t, queries, lexical), lexical, fused_run)


@query(
    "h08_guarded_search", "query_id:s document_id:s rank:i score:f6 route:s",
    with_more("products ptok pdf ptf plen pstat", _GUARD_CTES + ", " + _MIXED,
              "SELECT k.query_id, document_id, rank, score, route FROM knownrun k JOIN routes USING (query_id) WHERE route <> 'hybrid' UNION ALL "
              f"SELECT f.query_id, document_id, rank, score, route FROM ({fused(['knownrun', 'mrun'], [0.3, 0.7], 10)}) f JOIN routes USING (query_id) WHERE route = 'hybrid'"),
)
def _(t):
    return guarded(t)


@query("h08_route_counts", "route:s queries:i",
       with_more("products ptok pdf ptf plen pstat", _GUARD_CTES, "SELECT route, count(*) AS queries FROM routes GROUP BY 1"))
def _(t):
    queries = guard_queries(t)
    return routed(t, queries, known_item_run(t, queries)).groupBy("route").agg(F.count(F.lit(1)).alias("queries"))


def known_items(t, queries):
    """The documents a SKU or title query asks for: those with that SKU, or with exactly that title."""
    named = t.products.select(F.explode(F.array_distinct(F.array("sku", "title"))).alias("query"), "document_id")
    return queries.select("query_id", "query").join(named, "query").select("query_id", "document_id", F.lit(2).alias("relevance")).distinct()


@query(
    "e18_known_item_rr", "query_id:s value:f6",
    with_more("products ptok pdf ptf plen pstat", KNOWN_SQL,
              "SELECT q.query_id, coalesce(1.0 / min(k.rank), 0) AS value FROM phrases q JOIN products p ON p.sku = q.query OR p.title = q.query LEFT JOIN knownrun k ON k.query_id = q.query_id AND k.document_id = p.document_id GROUP BY 1"),
)
def _(t):
    queries = known_item_queries(t)
    return mrr_exact(known_item_run(t, queries), known_items(t, queries), 10)


_RERANKED = (
    "rr AS (SELECT r.query_id, r.document_id, row_number() OVER (PARTITION BY r.query_id ORDER BY CASE WHEN rank > 50 THEN 1 ELSE 0 END, CASE WHEN rank <= 50 THEN -s.score END, rank) AS rank "
    "FROM (SELECT * FROM runs WHERE system = 'price') r LEFT JOIN pair_scores s USING (query_id, document_id))"
)


@query("h09_rerank", "query_id:s document_id:s rank:i score:f6 tag:s",
       with_more("runs pair_scores", _RERANKED, "SELECT *, 100 - rank + 1 AS score, 'reranked' AS tag FROM rr"))
def _(t):
    return fu.rerank(t.run("price"), t.pair_scores, 50)


@query("h10_rerank_pairs", "query:s document:s",
       with_("runs products", "SELECT DISTINCT s_name AS query, title || ' ' || brand AS document FROM runs JOIN supplier ON CAST(s_suppkey AS VARCHAR) = query_id JOIN products USING (document_id) WHERE rank <= 50"))
def _(t):
    queries = t.raw("supplier").selectExpr("cast(s_suppkey as string) query_id", "s_name query")
    documents = t.products.select("document_id", F.concat_ws(" ", "title", "brand").alias("document"))
    return fu.rerank_pairs(t.runs, queries, documents, 50)


@query("h10_unknown_pairs", "query_id:s document_id:s unknown:s",
       with_("runs products", "SELECT DISTINCT query_id, document_id, 'document' AS unknown FROM runs WHERE document_id NOT IN (SELECT document_id FROM products WHERE p_size <> 7)"))
def _(t):
    queries = t.raw("supplier").selectExpr("cast(s_suppkey as string) query_id")
    return fu.unknown_pairs(t.runs, queries, t.products.where(F.col("p_size") != 7))


def _overlap_scores(pairs):
    """Shared words over query words; stands in for a real scorer, which the caller supplies."""
    return [
        float(len(set(q.lower().split()) & set(d.lower().split()))) / max(1, len(set(q.lower().split()))) for q, d in pairs
    ]


@query(
    "h11_score_pairs", "query:s document:s score:f6",
    "SELECT DISTINCT q.p_type || ' ' || q.p_name AS query, d AS document, len(list_intersect(list_distinct(string_split(lower(q.p_type || ' ' || q.p_name), ' ')), string_split(lower(d), ' '))) / len(list_distinct(string_split(lower(q.p_type || ' ' || q.p_name), ' '))) AS score "
    "FROM part q, LATERAL (SELECT q.p_name || ' ' || q.p_brand AS d)",
)
def _(t):
    pairs = t.raw("part").selectExpr("concat(p_type, ' ', p_name) query", "concat(p_name, ' ', p_brand) document")
    return fu.score_pairs(pairs, _overlap_scores)


@query("h12_retag", "query_id:s document_id:s rank:i tag:s", with_("runs", "SELECT query_id, document_id, rank, 'final' AS tag FROM runs WHERE system = 'price'"))
def _(t):
    return retag(t.run("price"), "final")


_GUARDED = (
    "SELECT k.query_id, document_id, rank FROM knownrun k JOIN routes USING (query_id) WHERE route <> 'hybrid' UNION ALL "
    f"SELECT f.query_id, document_id, rank FROM ({fused(['knownrun', 'mrun'], [0.3, 0.7], 10)}) f JOIN routes USING (query_id) WHERE route = 'hybrid'"
)
_HIT = "ON {0}.query_id = q.query_id AND {0}.document_id = p.document_id AND {0}.rank <= 10"
_TAIL = "list_sum(list_transform(range(losses, wins + losses + 1), lambda k: exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2))))"


@query(
    "e17_known_item_regression", "queries:i baseline_mrr:f6 candidate_mrr:f6 wins:i ties:i losses:i passes:b",
    with_more("products ptok pdf ptf plen pstat", _GUARD_CTES + ", " + _MIXED + f", guarded AS ({_GUARDED})",
              f"SELECT *, d >= -0.01 AND NOT (d < 0 AND {_TAIL} <= 0.05) AS passes FROM (SELECT count(*) AS queries, avg(b) AS baseline_mrr, avg(c) AS candidate_mrr, avg(c - b) AS d, "
              "count(*) FILTER (c > b) AS wins, count(*) FILTER (c = b) AS ties, count(*) FILTER (c < b) AS losses FROM (SELECT q.query_id, coalesce(1.0 / min(k.rank), 0) AS b, coalesce(1.0 / min(g.rank), 0) AS c "
              f"FROM phrases q JOIN products p ON p.sku = q.query OR p.title = q.query LEFT JOIN knownrun k {_HIT.format('k')} LEFT JOIN guarded g {_HIT.format('g')} GROUP BY 1))"),
)
def _(t):
    """Does guarded fusion lose known items that the lexical search finds?"""
    queries = guard_queries(t)
    expected = known_items(t, queries)
    before = mrr_exact(known_item_run(t, queries), expected, 10).withColumnRenamed("value", "baseline")
    after = mrr_exact(guarded(t), expected, 10).withColumnRenamed("value", "candidate")
    return sign_test(before.join(after, "query_id"))


_GRID_RUNS = " UNION ALL ".join(
    f"SELECT '{name}' AS setting, * FROM ({fused([_run_sql('quantity'), _run_sql('price')], list(w), 20)})" for name, w in _GRID.items()
)


@query(
    "e23_pick_fusion_weight", "setting:s value:f6",
    with_more("runs qrels ideal", f"gr AS ({_GRID_RUNS})",
              "SELECT setting, value FROM (SELECT setting, round(avg(CASE WHEN i10 > 0 THEN coalesce(d10, 0) / i10 ELSE 0 END), 6) AS value FROM ideal CROSS JOIN (SELECT DISTINCT setting FROM gr) "
              "LEFT JOIN (SELECT setting, query_id, sum(relevance / log2(rank + 1)) AS d10 FROM gr JOIN qrels USING (query_id, document_id) WHERE rank <= 10 GROUP BY 1, 2) USING (setting, query_id) GROUP BY 1) ORDER BY value DESC, setting LIMIT 1"),
)
def _(t):
    """nDCG@10 of every fusion weight in one job, best first-registered setting."""
    grid = fu.minmax_grid([t.run("quantity"), t.run("price")], _GRID, 20)
    settings = t.spark.createDataFrame([(name,) for name in _GRID], "setting string")  # known without a run
    measured = evaluate(grid, t.qrels, ["setting"], systems=settings)
    means = measured.groupBy("setting").agg(F.round(F.avg("`ndcg@10`"), 6).alias("value")).withColumn("position", F.substring("setting", 2, 3).cast("int"))
    return pick_best(means)


# -- facets --------------------------------------------------------------------------------------

@query(
    "e31_facets", "field:s key:s documents:i place:i",
    with_("products", "SELECT *, row_number() OVER (PARTITION BY field ORDER BY documents DESC, key) AS place FROM (SELECT field, key, count(*) AS documents FROM (SELECT unnest(['brand', 'category', 'product_class']) AS field, unnest([brand, category, product_class]) AS key FROM products) GROUP BY 1, 2) QUALIFY place <= 20"),
)
def _(t):
    return fc.facets(t.products)


_FACET_SQL = (
    "legs AS (SELECT DISTINCT query_id, document_id, 'lexical' AS leg FROM pfield UNION ALL SELECT query_id, document_id, 'fused' FROM top10), "
    "tc AS (SELECT category AS value FROM products GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), "
    "st AS (SELECT l.*, p.brand, p.category, p.product_class, unnest(CASE WHEN p.category = tc.value THEN ['unfiltered', 'filtered'] ELSE ['unfiltered'] END) AS state FROM legs l JOIN products p USING (document_id), tc), "
    "tot AS (SELECT query_id, leg, state, count(*) AS total_hits FROM st GROUP BY 1, 2, 3), "
    "fcx AS (SELECT query_id, leg, state, field, key, count(*) AS documents FROM (SELECT query_id, leg, state, unnest(['brand', 'category', 'product_class']) AS field, unnest([brand, category, product_class]) AS key FROM st) GROUP BY 1, 2, 3, 4, 5)"
)


@query(
    "e32_facet_compare", "query_id:s leg:s state:s field:s key:s documents:i place:i total_hits:i",
    with_more("pfield products", f"top10 AS ({ranked('(SELECT query_id, document_id, round(max(score), 6) AS score FROM pfield GROUP BY 1, 2)', 'query_id', BEST, 10)}), " + _FACET_SQL,
              "SELECT *, row_number() OVER (PARTITION BY query_id, leg, state, field ORDER BY documents DESC, key) AS place FROM fcx JOIN tot USING (query_id, leg, state) QUALIFY place <= 20"),
)
def _(t):
    terms = lx.query_terms(t.product_queries)
    best = lx.ranked_search(t.product_texts, terms, [lx.Profile("flat", dict.fromkeys(lx.NAIVE.boosts, 1.0))], 10)
    return fc.facet_compare(t.product_texts, terms, list(lx.NAIVE.boosts), best, t.products)


