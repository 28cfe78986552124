"""Lexical retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmill.operators import lexical as lx
from rankmill.operators.ordering import score_order, to_run, top_k
from rankmill.plans.oracle import BEST, IDF, SAT, ranked, tok, with_
from rankmill.plans.registry import query

SCORED = "query_id:s document_id:s rank:i score:f6"


def rounded(scored, decimals: int = 6):
    return scored.withColumn("score", F.round("score", decimals))


@query(
    "l01_postings", "field:s term:s document_id:s frequency:i first:i last:i length:i",
    with_("ptok plen", "SELECT field, term, document_id, count(*) AS frequency, min(pos) AS first, max(pos) AS last, any_value(dl) AS length FROM ("
          "SELECT field, document_id, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM ptok) JOIN plen USING (field, document_id) GROUP BY field, term, document_id"),
)
def _(t):
    return lx.postings(t.product_texts).select(
        "*", F.element_at("positions", 1).alias("first"), F.element_at("positions", -1).alias("last")
    )


@query(
    "l01_term_stats", "term:s document_frequency:i documents:i average_length:f6",
    with_("ddf dstat", "SELECT term, df AS document_frequency, n AS documents, avgdl AS average_length FROM ddf, dstat"),
)
def _(t):
    return lx.term_stats(t.doc_texts)


@query("l02_bm25", SCORED, with_("lexrun", "SELECT query_id, document_id, rank, score FROM lexrun"))
def _(t):
    return lx.ranked_search(t.doc_texts, t.terms, [lx.Profile("bm25", {"text": 1.0})])


_MATCHES = with_("bm25", "SELECT query_id, count(*) AS documents, sum(matched) AS matched, sum(score) AS total FROM bm25 GROUP BY 1")


@query("l02_bm25_all_matches", "query_id:s documents:i matched:i total:f3", _MATCHES)
def _(t):
    return lx.bm25(t.doc_texts, t.terms).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("matched").alias("matched"), F.sum("score").alias("total")
    )


def profile_sql(profile: lx.Profile, source: str = "pfield", digits: int | None = 6) -> str:
    boost = "CASE field " + " ".join(f"WHEN '{f}' THEN {float(b)}" for f, b in profile.boosts.items()) + " END"
    needed = "1"
    if profile.operator == "and":
        needed = "nt"
    elif profile.minimum_should_match:
        limit, share = profile.minimum_should_match
        needed = f"CASE WHEN nt <= {limit} THEN nt ELSE greatest(1, floor(nt * {share})) END"
    score = f"max(b) + {profile.tie_breaker} * (sum(b) - max(b))"
    if digits is not None:
        score = f"round({score}, {digits})"
    return (
        f"SELECT '{profile.name}' AS profile, query_id, document_id, {score} AS score "
        f"FROM (SELECT query_id, document_id, score * {boost} AS b FROM {source} WHERE matched >= {needed}) WHERE b IS NOT NULL GROUP BY query_id, document_id"
    )


def _search(t, profile):
    return lx.ranked_search(t.product_texts, lx.query_terms(t.product_queries), [profile], 20)


EMULATION = lx.TUNING_PROFILES[0]


@query("l03_best_fields", SCORED, with_("pfield", ranked(f"({profile_sql(EMULATION)})", "query_id", BEST, 20)))
def _(t):
    return _search(t, EMULATION)


AND = lx.Profile("all_words", dict(EMULATION.boosts, description=1.0), 0.1, "and")


@query("l04_operator_and", SCORED, with_("pfield", ranked(f"({profile_sql(AND)})", "query_id", BEST, 20)))
def _(t):
    return _search(t, AND)


MSM = lx.Profile("msm", dict(EMULATION.boosts), 0.1, minimum_should_match=(2, 0.75))


@query("l05_minimum_should_match", SCORED, with_("pfield", ranked(f"({profile_sql(MSM)})", "query_id", BEST, 20)))
def _(t):
    return _search(t, MSM)


_PAIRED = (
    "fz AS (SELECT q.query_id, q.nt, q.term AS src, d.term AS term, d.field, d.df, w * (1 - levenshtein(q.term, d.term) / least(length(q.term), length(d.term))) AS w "
    "FROM pqterm q JOIN pdf d ON substr(q.term, 1, 1) = substr(d.term, 1, 1) AND levenshtein(q.term, d.term) <= CASE WHEN length(q.term) < 3 THEN 0 WHEN length(q.term) < 6 THEN 1 ELSE 2 END), "
    f"fzfield AS (SELECT query_id, field, document_id, any_value(nt) AS nt, sum(p) AS score, count(*) AS matched FROM (SELECT query_id, field, document_id, src, any_value(nt) AS nt, max(w * {IDF} * {SAT}) AS p "
    "FROM fz JOIN ptf USING (field, term) JOIN plen USING (field, document_id) JOIN pstat USING (field) GROUP BY query_id, field, document_id, src) GROUP BY query_id, field, document_id)"
)


def with_more(names: str, more: str, body: str) -> str:
    """Named expressions plus local ones."""
    head = with_(names, "")
    return f"{head.rstrip()}, {more} {body}"


@query(
    "l06_fuzzy", SCORED,
    with_more("pqterm pdf ptf plen pstat", _PAIRED, ranked(f"({profile_sql(EMULATION, 'fzfield')})", "query_id", BEST, 20)),
)
def _(t):
    return lx.fuzzy_search(t.product_texts, lx.query_terms(t.product_queries), EMULATION, 20)


# Phrases over the documents: whole query texts, slop 0 and 1.
_PHRASE_QUERIES = (
    f"pw AS (SELECT query_id, len(t) AS slots, unnest(t) AS term, unnest(range(len(t))) AS slot FROM (SELECT query_id, {tok('query')} AS t FROM phrases)), "
    "pos AS (SELECT field, document_id, unnest(toks) AS term, unnest(range(len(toks))) AS p FROM ptok), "
)


def _phrase_sql(slop: int, words: str = "pw") -> str:
    return (
        f"votes AS (SELECT query_id, slots, field, document_id, slot, p - slot AS s FROM pos JOIN {words} USING (term)), "
        f"opened AS (SELECT *, s - unnest(range({slop + 1})) AS win FROM votes), "
        "found AS (SELECT query_id, field, document_id, win FROM opened GROUP BY query_id, slots, field, document_id, win HAVING count(DISTINCT slot) = slots AND min(s) = win), "
        "ph AS (SELECT query_id, field, document_id, count(*) AS tf FROM found GROUP BY ALL), "
        f"pidf AS (SELECT query_id, field, sum(i) AS i FROM (SELECT query_id, field, slot, min({IDF}) AS i FROM {words} JOIN pdf USING (term) JOIN pstat USING (field) GROUP BY 1, 2, 3) GROUP BY 1, 2), "
        f"phfield AS (SELECT query_id, field, document_id, 1 AS nt, 1 AS matched, i * {SAT} AS score FROM ph JOIN pidf USING (query_id, field) JOIN plen USING (field, document_id) JOIN pstat USING (field))"
    )


PHRASE = lx.Profile("phrase", {"title": 8.0, "description": 2.0})
_PQ = "phrases AS (SELECT DISTINCT replace(lower(p_name || ' ' || p_brand), ' ', '-') AS query_id, p_name || ' ' || p_brand AS query FROM part), "


def phrase_queries(t):
    return t.raw("part").selectExpr(
        "replace(lower(concat(p_name, ' ', p_brand)), ' ', '-') query_id", "concat(p_name, ' ', p_brand) query"
    ).distinct()


@query(
    "l07_phrase", SCORED,
    with_more("ptok pdf plen pstat", _PQ + _PHRASE_QUERIES + _phrase_sql(1), ranked(f"({profile_sql(PHRASE, 'phfield')})", "query_id", BEST, 20)),
)
def _(t):
    scored = lx.best_fields(lx.phrase_score(t.product_texts, lx.phrase_terms(phrase_queries(t)), slop=1), PHRASE)
    return top_k(rounded(scored), ["query_id"], score_order(), 20)


_PREFIXED = "phrases AS (SELECT DISTINCT p_name AS query_id, substr(p_name, 1, length(p_name) - 2) AS query FROM part), "
_EXPANDED = (
    "dict AS (SELECT DISTINCT term AS word FROM pdf), "
    "px AS (SELECT query_id, slots, slot, word AS term FROM pw JOIN dict ON starts_with(word, term) WHERE slot = slots - 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY word) <= 50 "
    "UNION ALL SELECT query_id, slots, slot, term FROM pw WHERE slot < slots - 1), "
)


@query(
    "l08_phrase_prefix", SCORED,
    with_more("ptok pdf plen pstat", _PREFIXED + _PHRASE_QUERIES + _EXPANDED + _phrase_sql(0, "px"), ranked(f"({profile_sql(PHRASE, 'phfield')})", "query_id", BEST, 20)),
)
def _(t):
    queries = t.raw("part").selectExpr("p_name query_id", "substr(p_name, 1, length(p_name) - 2) query").distinct()
    phrases = lx.phrase_prefix_terms(lx.phrase_terms(queries), lx.term_stats(t.product_texts))
    scored = lx.best_fields(lx.phrase_score(t.product_texts, phrases), PHRASE)
    return top_k(rounded(scored), ["query_id"], score_order(), 20)


SUM_A, SUM_B = lx.Profile("a", {"title": 2.0}), lx.Profile("b", {"brand": 1.0, "features": 1.5}, 0.3)


@query(
    "l09_clause_sum", SCORED,
    with_("pfield", ranked(
        f"(SELECT query_id, document_id, round(sum(score), 6) AS score FROM ({profile_sql(EMULATION, digits=None)} UNION ALL {profile_sql(SUM_A, digits=None)} UNION ALL {profile_sql(SUM_B, digits=None)}) GROUP BY 1, 2)",
        "query_id", BEST, 20)),
)
def _(t):
    return lx.ranked_search(t.product_texts, lx.query_terms(t.product_queries), [EMULATION, SUM_A, SUM_B], 20, added="clauses")


def known_item_queries(t):
    """Every SKU, and every distinct title."""
    p = t.products
    return p.select(F.concat(F.lit("s-"), "product_id").alias("query_id"), F.col("sku").alias("query")).unionByName(
        p.select(F.concat(F.lit("t-"), "title").alias("query_id"), F.col("title").alias("query")).distinct()
    )


KNOWN_SQL = (
    "phrases AS (SELECT 's-' || product_id AS query_id, sku AS query FROM products UNION ALL SELECT DISTINCT 't-' || title, title FROM products), "
    + _PHRASE_QUERIES + _phrase_sql(0) + ", "
    f"kq AS (SELECT query_id, term, count(*) AS w, any_value(nt) AS nt FROM (SELECT query_id, len(list_distinct({tok('query')})) AS nt, unnest({tok('query')}) AS term FROM phrases) GROUP BY query_id, term), "
    f"kfield AS (SELECT query_id, field, document_id, any_value(nt) AS nt, sum(w * {IDF} * {SAT}) AS score, count(*) AS matched FROM kq JOIN ptf USING (term) JOIN pdf USING (field, term) JOIN plen USING (field, document_id) JOIN pstat USING (field) "
    "WHERE field IN ('title', 'brand', 'description') GROUP BY query_id, field, document_id), "
    "skuhit AS (SELECT query_id, document_id, 100 * ln(1 + (n - 1 + 0.5) / (1 + 0.5)) AS score FROM phrases JOIN products ON sku = query, (SELECT count(*) AS n FROM products)), "
    f"known AS (SELECT query_id, document_id, round(sum(score), 6) AS score FROM (SELECT query_id, document_id, score FROM skuhit UNION ALL "
    "SELECT query_id, document_id, score * 20 FROM phfield WHERE field = 'title' UNION ALL "
    "SELECT query_id, document_id, max(score * CASE field WHEN 'title' THEN 8 WHEN 'brand' THEN 2 ELSE 1 END) FROM kfield WHERE matched >= nt GROUP BY 1, 2) GROUP BY 1, 2), "
    f"knownrun AS ({ranked('known', 'query_id', BEST, 10)})"
)


def known_item_run(t, queries=None):
    skus = t.products.select("document_id", "sku")
    scored = lx.known_item_search(t.product_texts, known_item_queries(t) if queries is None else queries, skus)
    return top_k(rounded(scored), ["query_id"], score_order(), 10)


@query(
    "l10_known_item_search", "query_id:s document_id:s rank:i score:f6",
    with_more("products ptok pdf ptf plen pstat", KNOWN_SQL, "SELECT * FROM knownrun"),
)
def _(t):
    return known_item_run(t)


@query("l11_top_k", "query_id:s document_id:s rank:i score:f6 tag:s",
       with_("pair_values", ranked(f"(SELECT query_id, document_id, price AS score, 'price' AS tag FROM pair_values)", "query_id", BEST, 25)))
def _(t):
    return to_run(t.pair_values.select("query_id", "document_id", F.col("price").alias("score")), "price", 25)


GRID = (*lx.TUNING_PROFILES, lx.NAIVE)


@query(
    "l12_profile_sweep", "profile:s query_id:s document_id:s rank:i score:f6",
    with_("pfield", ranked("(" + " UNION ALL ".join(profile_sql(p) for p in GRID) + ")", "profile, query_id", BEST, 10)),
)
def _(t):
    return lx.ranked_search(t.product_texts, lx.query_terms(t.product_queries), GRID, 10)


_INTEGRATOR_PARTS = (
    "phrases AS (SELECT query_id, query FROM pqueries), " + _PHRASE_QUERIES
    + _phrase_sql(1) + ", "
    + _EXPANDED.rstrip(", ") + ", "
    + _phrase_sql(0, "px").replace("votes AS", "votes2 AS").replace("FROM votes)", "FROM votes2)").replace("opened AS", "opened2 AS")
    .replace("FROM opened", "FROM opened2").replace("found AS", "found2 AS").replace("FROM found", "FROM found2").replace("ph AS", "ph2 AS")
    .replace("FROM ph ", "FROM ph2 ").replace("pidf AS", "pidf2 AS").replace("JOIN pidf ", "JOIN pidf2 ").replace("phfield AS", "phfield2 AS")
    + ", " + _PAIRED
)
_P1, _P2 = lx.Profile("p", lx.INTEGRATOR.extra["phrase"]), lx.Profile("x", lx.INTEGRATOR.extra["prefix"])


@query(
    "l12_integrator", SCORED,
    with_more(
        "pqueries ptok pqterm pdf ptf plen pstat", _INTEGRATOR_PARTS,
        ranked("(SELECT query_id, document_id, round(sum(score), 6) AS score FROM ("
               f"SELECT query_id, document_id, score FROM ({profile_sql(lx.INTEGRATOR, 'fzfield', None)}) UNION ALL "
               f"SELECT query_id, document_id, score * 2 FROM ({profile_sql(_P1, 'phfield', None)}) UNION ALL "
               f"SELECT query_id, document_id, score FROM ({profile_sql(_P2, 'phfield2', None)})) GROUP BY 1, 2)", "query_id", BEST, 10)),
)
def _(t):
    return top_k(rounded(lx.integrator_search(t.product_texts, t.product_queries)), ["query_id"], score_order(), 10)


