"""Evaluation, significance and selection queries over the judged runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmill.operators import evaluation as ev
from rankmill.operators import selection as sl
from rankmill.operators import significance as sg
from rankmill.plans.oracle import squeeze, with_
from rankmill.plans.registry import query

METRIC_SPEC = "ndcg@10:f6 ndcg@50:f6 recall@100:f6 mrr_exact@10:f6 judged@10:f6"
METRIC_SQL = 'ndcg10 AS "ndcg@10", ndcg50 AS "ndcg@50", recall100 AS "recall@100", mrr10 AS "mrr_exact@10", judged10 AS "judged@10"'


def one(metric: str) -> str:
    return with_("metrics", f"SELECT query_id, {metric} AS value FROM metrics WHERE system = 'quantity'")


@query("j01_run_with_gains", "system:s query_id:s document_id:s rank:i gain:i judged:b",
       with_("runs qrels", "SELECT system, r.query_id, r.document_id, rank, coalesce(relevance, 0) AS gain, relevance IS NOT NULL AS judged FROM runs r LEFT JOIN qrels q USING (query_id, document_id)"))
def _(t):
    return ev.judged_run(t.runs, t.qrels)


_JUDGED_ONLY = "SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY system, query_id ORDER BY rank) AS rank FROM runs SEMI JOIN qrels USING (query_id, document_id)"


@query("j02_judged_rows", "system:s query_id:s document_id:s rank:i",
       with_("runs qrels", "SELECT system, query_id, document_id, rank FROM runs SEMI JOIN qrels USING (query_id, document_id)"))
def _(t):
    return t.runs.join(t.qrels, ["query_id", "document_id"], "left_semi")


@query("e01_ndcg", "query_id:s value:f6", one("ndcg10"))
def _(t):
    return ev.ndcg(t.run("quantity"), t.qrels, 10)


@query("e02_recall", "query_id:s value:f6", one("recall100"))
def _(t):
    return ev.recall(t.run("quantity"), t.qrels, 100)


@query("e03_mrr_exact", "query_id:s value:f6", one("mrr10"))
def _(t):
    return ev.mrr_exact(t.run("quantity"), t.qrels, 10)


@query("e04_judged_at", "query_id:s value:f6", one("judged10"))
def _(t):
    return ev.judged_at(t.run("quantity"), t.qrels, 10)


@query("e05_evaluate", f"system:s query_id:s {METRIC_SPEC}", with_("metrics", f"SELECT system, query_id, {METRIC_SQL} FROM metrics"))
def _(t):
    return ev.evaluate(t.runs, t.qrels, ["system"])


_MACRO = "system, count(*) AS queries, " + ", ".join(
    f'avg({a}) AS "{b}"' for a, b in (("ndcg10", "ndcg@10"), ("ndcg50", "ndcg@50"), ("recall100", "recall@100"), ("mrr10", "mrr_exact@10"), ("judged10", "judged@10"))
)


@query("e05_macro", f"system:s queries:i {METRIC_SPEC}", with_("metrics", f"SELECT {_MACRO} FROM metrics GROUP BY 1"))
def _(t):
    return ev.macro(ev.evaluate(t.runs, t.qrels, ["system"]), ["system"])


def passage_metrics(t):
    """The flagship: BM25 of every query text over all documents, scored on known passages."""
    from rankmill.operators.lexical import Profile, ranked_search

    run = ranked_search(t.doc_texts, t.terms, [Profile("bm25", {"text": 1.0})]).drop("profile")
    return ev.evaluate(run, t.passage_qrels)


@query(
    "e05_bm25_passages", f"query_id:s {METRIC_SPEC}",
    with_("lexrun passage_qrels", "SELECT query_id, coalesce(sum(2 / log2(rank + 1)) FILTER (rank <= 10), 0) / any_value(i10) AS \"ndcg@10\", "
          "coalesce(sum(2 / log2(rank + 1)) FILTER (rank <= 50), 0) / any_value(i50) AS \"ndcg@50\", count(rank) / count(*) AS \"recall@100\", "
          "coalesce(1.0 / min(rank) FILTER (rank <= 10), 0) AS \"mrr_exact@10\", (SELECT count(*) FROM lexrun l SEMI JOIN passage_qrels p USING (query_id, document_id) WHERE rank <= 10 AND l.query_id = j.query_id) / 10.0 AS \"judged@10\" "
          "FROM (SELECT query_id, document_id, rank, sum(CASE WHEN place <= 10 THEN 2 / log2(place + 1) ELSE 0 END) OVER (PARTITION BY query_id) AS i10, sum(CASE WHEN place <= 50 THEN 2 / log2(place + 1) ELSE 0 END) OVER (PARTITION BY query_id) AS i50 "
          "FROM (SELECT q.query_id, q.document_id, rank, row_number() OVER (PARTITION BY q.query_id) AS place FROM passage_qrels q LEFT JOIN lexrun USING (query_id, document_id))) j GROUP BY query_id"),
)
def _(t):
    return passage_metrics(t)


@query("e06_cross_check", "metric:s max_delta:f9 agrees:b",
       with_("metrics", "SELECT 'ndcg@10' AS metric, max(m) - min(m) AS max_delta, max(m) - min(m) <= 0.001 AS agrees FROM (SELECT avg(ndcg10) AS m FROM metrics GROUP BY system)"))
def _(t):
    whole = ev.macro(ev.evaluate(t.runs, t.qrels, ["system"]), ["system"])
    return ev.cross_check(
        whole.select(F.col("system").alias("method"), F.lit("ndcg@10").alias("metric"), F.col("`ndcg@10`").alias("value"))
    )


@query("e06_cross_check_methods", "metric:s max_delta:f6 agrees:b",
       "SELECT unnest(['ndcg@10', 'recall@100', 'mrr_exact@10', 'judged@10']) AS metric, 0.0 AS max_delta, true AS agrees")
def _(t):
    """Two formulations of the same metrics must agree: one joint pass and one function per metric."""
    run, qrels = t.run("quantity"), t.qrels
    joint = ev.macro(ev.evaluate(run, qrels))
    single = {
        "ndcg@10": ev.ndcg(run, qrels, 10), "recall@100": ev.recall(run, qrels, 100),
        "mrr_exact@10": ev.mrr_exact(run, qrels, 10), "judged@10": ev.judged_at(run, qrels, 10),
    }
    rows = joint.select(
        F.lit("joint").alias("method"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for m in single])),
    )
    for name, values in single.items():
        rows = rows.unionByName(
            values.agg(F.avg("value").alias("value")).select(F.lit("single").alias("method"), F.lit(name).alias("metric"), "value")
        )
    return ev.cross_check(rows)


@query(
    "e07_validate_run", "query_id:s fault:s",
    with_("runs", "SELECT query_id, unnest(['rank_gap']) AS fault FROM runs WHERE system = 'price' GROUP BY query_id HAVING count(*) FILTER (rank % 7 = 3) > 0 AND min(rank) FILTER (rank % 7 <> 3) = 1 "
          "UNION ALL SELECT query_id, 'duplicate_document' FROM runs WHERE system = 'price' AND rank = 1 AND length(query_id) = 1"),
)
def _(t):
    run = t.run("price")
    holes = run.where(F.col("rank") % 7 != 3)
    repeated = run.where((F.length("query_id") == 1) & (F.col("rank") == 1)).withColumn("rank", F.lit(3))
    return ev.run_faults(holes.unionByName(repeated))


@query(
    "e07_validate_qrels", "query_id:s document_id:s fault:s",
    with_("qrels", "SELECT query_id, document_id, 'duplicate_pair' AS fault FROM qrels WHERE relevance = 2 UNION ALL SELECT query_id, document_id, 'negative_gain' FROM qrels WHERE relevance = 0"),
)
def _(t):
    spoiled = t.qrels.withColumn("relevance", F.when(F.col("relevance") == 0, -1).otherwise(F.col("relevance")))
    return ev.qrel_faults(spoiled.unionByName(spoiled.where(F.col("relevance") == 2)))


@query(
    "e08_map_qrels", "mapping:s query_id:s document_id:s relevance:i",
    with_("qrels", "SELECT 'primary' AS mapping, * FROM qrels UNION ALL SELECT 'strict_binary', query_id, document_id, CASE WHEN relevance = 2 THEN 1 ELSE 0 END FROM qrels "
          "UNION ALL SELECT 'broad_binary', query_id, document_id, CASE WHEN relevance > 0 THEN 1 ELSE 0 END FROM qrels"),
)
def _(t):
    return ev.all_mappings(t.qrels, 2)


@query("e09_judged_only", "system:s query_id:s document_id:s rank:i", with_("runs qrels", _JUDGED_ONLY))
def _(t):
    return ev.judged_only(t.runs, t.qrels, ["system"])


# -- significance --------------------------------------------------------------------------------

_T = (
    "d AS (SELECT c.system, c.query_id, round(c.ndcg10, 12) - round(b.ndcg10, 12) AS delta, b.ndcg10 AS base FROM metrics c JOIN metrics b ON b.system = 'quantity' AND b.query_id = c.query_id WHERE c.system <> 'quantity'), "
    "s AS (SELECT system, count(*) AS queries, avg(base) AS baseline_score, avg(delta) AS mean_delta, stddev_samp(delta) AS sd, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta < 0) AS losses FROM d GROUP BY 1), "
    "tt AS (SELECT *, mean_delta / (sd / sqrt(queries)) AS t, queries - 1 AS nu FROM s), "
)
# Two-sided p: Simpson's rule over the angle whose tangent is t / sqrt(nu).
_P = (
    "pv AS (SELECT tt.*, 2 * exp(lgamma((nu + 1) / 2.0) - lgamma(nu / 2.0)) / sqrt(pi()) * ("
    "SELECT sum((CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(atan(abs(t) / sqrt(nu)) + i * (pi() / 2 - atan(abs(t) / sqrt(nu))) / 4000), nu - 1)) * (pi() / 2 - atan(abs(t) / sqrt(nu))) / 4000 / 3 "
    "FROM range(4001) r(i)) AS p_value FROM tt), "
    "hm AS (SELECT *, max(least(1.0, p_value * (m - place + 1))) OVER (ORDER BY place) AS adjusted_p_value FROM (SELECT *, row_number() OVER (ORDER BY p_value, system) AS place, count(*) OVER () AS m FROM pv)) "
)


def compared(body: str) -> str:
    return f"{with_('metrics', '').rstrip()}, {_T}{_P}{body}"


def ndcg_values(t):
    return ev.evaluate(t.runs, t.qrels, ["system"]).select("system", "query_id", F.col("`ndcg@10`").alias("value"))


@query("e11_paired_t", "system:s queries:i mean_delta:f6 t:f6 p_value:f6", compared("SELECT * FROM hm"))
def _(t):
    return sg.paired_t(sg.paired_deltas(ndcg_values(t), "quantity"))


@query("e12_holm", "system:s p_value:f6 adjusted_p_value:f6", compared("SELECT * FROM hm"))
def _(t):
    return sg.holm(sg.paired_t(sg.paired_deltas(ndcg_values(t), "quantity")))


@query("e13_win_tie_loss", "system:s wins:i ties:i losses:i", compared("SELECT * FROM s"))
def _(t):
    rounded = ndcg_values(t).withColumn("value", F.round("value", 12))
    return sg.paired_t(sg.paired_deltas(rounded, "quantity"))


_GATE = "CASE WHEN adjusted_p_value <= 0.05 AND mean_delta >= 0.02 THEN 'passes_quality_significance_gate' ELSE 'does_not_pass_quality_significance_gate' END AS interpretation"


@query("e14_significance_gate", "system:s significant:b meets_delta:b supports:b interpretation:s",
       compared(f"SELECT *, adjusted_p_value <= 0.05 AS significant, mean_delta >= 0.02 AS meets_delta, adjusted_p_value <= 0.05 AND mean_delta >= 0.02 AS supports, {_GATE} FROM hm"))
def _(t):
    return sg.gate(sg.holm(sg.paired_t(sg.paired_deltas(ndcg_values(t), "quantity"))))


@query("e15_compare_family", "system:s queries:i baseline_score:f6 mean_delta:f6 t:f6 p_value:f6 adjusted_p_value:f6 interpretation:s",
       compared(f"SELECT *, {_GATE} FROM hm"))
def _(t):
    return sg.compare_family(ndcg_values(t), "quantity")


_VIEWS = (
    "jo AS (SELECT system, query_id, document_id, row_number() OVER (PARTITION BY system, query_id ORDER BY rank) AS rank FROM runs SEMI JOIN qrels USING (query_id, document_id)), "
    "vr AS (SELECT 'full_corpus' AS view, system, query_id, document_id, rank FROM runs UNION ALL SELECT 'rerank_within_judged', * FROM jo), "
    "mq AS (SELECT 'primary' AS mapping, query_id, document_id, relevance FROM qrels UNION ALL SELECT 'strict_binary', query_id, document_id, CASE WHEN relevance = 2 THEN 1 ELSE 0 END FROM qrels "
    "UNION ALL SELECT 'broad_binary', query_id, document_id, CASE WHEN relevance > 0 THEN 1 ELSE 0 END FROM qrels), "
    "mi AS (SELECT mapping, query_id, sum(relevance / log2(place + 1)) AS i10 FROM (SELECT *, row_number() OVER (PARTITION BY mapping, query_id ORDER BY relevance DESC) AS place FROM mq QUALIFY place <= 10) GROUP BY 1, 2), "
    "md AS (SELECT mapping, view, system, r.query_id, sum(relevance / log2(rank + 1)) AS d10 FROM vr r JOIN mq USING (query_id, document_id) WHERE rank <= 10 GROUP BY ALL), "
    "mm AS (SELECT mi.mapping, k.view, k.system, mi.query_id, CASE WHEN i10 > 0 THEN coalesce(d10, 0) / i10 ELSE 0 END AS v FROM mi CROSS JOIN (SELECT DISTINCT view, system FROM vr) k LEFT JOIN md ON md.mapping = mi.mapping AND md.view = k.view AND md.system = k.system AND md.query_id = mi.query_id) "
)


@query("e10_robustness_grid", "mapping:s view:s system:s queries:i baseline_score:f6 mean_delta:f6 ndcg@10:f6 t:f5",
       f"{with_('runs qrels', '').rstrip()}, {_VIEWS} SELECT *, mean_delta / (sd / sqrt(queries)) AS t FROM (SELECT c.mapping, c.view, c.system, count(*) AS queries, avg(b.v) AS baseline_score, avg(c.v - b.v) AS mean_delta, avg(c.v) AS \"ndcg@10\", stddev_samp(c.v - b.v) AS sd "
       "FROM mm c JOIN mm b ON b.system = 'quantity' AND b.mapping = c.mapping AND b.view = c.view AND b.query_id = c.query_id WHERE c.system <> 'quantity' GROUP BY 1, 2, 3)")
def _(t):
    return sg.robustness_grid(t.runs, t.qrels, "quantity", 2)


_CELLS = (
    "cs AS (SELECT c.mapping, c.view, c.system, count(*) AS queries, avg(c.v - b.v) AS mean_delta, stddev_samp(c.v - b.v) AS sd FROM mm c JOIN mm b ON b.system = 'quantity' AND b.mapping = c.mapping AND b.view = c.view AND b.query_id = c.query_id WHERE c.system <> 'quantity' GROUP BY 1, 2, 3), "
    "tt AS (SELECT *, mean_delta / (sd / sqrt(queries)) AS t, queries - 1 AS nu FROM cs), "
)


@query(
    "e10_conclusion_holds", "system:s cells:i holds:b",
    f"{with_('runs qrels', '').rstrip()}, {_VIEWS.rstrip()}, {_CELLS}"
    + _P.replace("OVER (ORDER BY place)", "OVER (PARTITION BY mapping, view ORDER BY place)").replace("OVER (ORDER BY p_value, system)", "OVER (PARTITION BY mapping, view ORDER BY p_value, system)").replace("count(*) OVER ()", "count(*) OVER (PARTITION BY mapping, view)")
    + "SELECT system, count(*) AS cells, bool_and(adjusted_p_value <= 0.05 AND mean_delta >= 0.02) AS holds FROM hm GROUP BY 1",
)
def _(t):
    return sg.conclusion_holds(sg.robustness_grid(t.runs, t.qrels, "quantity", 2))


_PARTED = (
    _P.replace("OVER (ORDER BY place)", "OVER (PARTITION BY mapping, view ORDER BY place)").replace("OVER (ORDER BY p_value, system)", "OVER (PARTITION BY mapping, view ORDER BY p_value, system)")
    .replace("count(*) OVER ()", "count(*) OVER (PARTITION BY mapping, view)")
)


@query(
    "e15_compare_families", "mapping:s view:s system:s queries:i mean_delta:f6 p_value:f6 adjusted_p_value:f6 eligible_for_decision:b reasons:s interpretation:s",
    f"{with_('runs qrels', '').rstrip()}, {_VIEWS.rstrip()}, {_CELLS}" + _PARTED
    + "SELECT *, view = 'full_corpus' AS eligible_for_decision, CASE WHEN view = 'full_corpus' THEN '' ELSE 'judged_pool' END AS reasons, CASE WHEN adjusted_p_value <= 0.05 AND mean_delta >= 0.02 THEN "
    "CASE WHEN view = 'full_corpus' THEN 'passes_quality_significance_gate' ELSE 'provisional_only_ineligible_evidence' END ELSE 'does_not_pass_quality_significance_gate' END AS interpretation FROM hm",
)
def _(t):
    """All mappings and views as families of one job; what only re-ranks judged documents is no evidence."""
    metrics = sg.robustness_metrics(t.runs, t.qrels, 2).withColumn("value", F.col("`ndcg@10`"))
    listed = [(m, v, s, v == "full_corpus" or s == "runs") for m in ev.MAPPINGS for v in ("full_corpus", "rerank_within_judged") for s in ("runs", "judged_pool")]
    sources = t.spark.createDataFrame(listed, "mapping string, view string, source string, eligible boolean")  # registered names
    return sg.compare_families(metrics, "quantity", ["mapping", "view"], sources)


@query("e16_family_eligible", "family:s eligible_for_decision:b reasons:s",
       "SELECT r_name AS family, bool_and(coalesce(n_nationkey % 4 <> 1 AND n_nationkey % 7 <> 3, false)) AS eligible_for_decision, "
       "coalesce(string_agg(CASE WHEN n_nationkey % 4 = 1 OR n_nationkey % 7 = 3 THEN n_name END, ',' ORDER BY n_name), '') AS reasons FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(t):
    sources = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "r_name family", "n_name source", "if(n_nationkey % 7 = 3, null, n_nationkey % 4 <> 1) eligible"
    )
    return sg.family_eligible(sources)


@query(
    "e17_sign_test", "queries:i baseline_mrr:f6 candidate_mrr:f6 mean_delta:f6 wins:i ties:i losses:i p_value:f6 significant_regression:b within_margin:b passes:b",
    with_("metrics", "SELECT *, mean_delta < 0 AND p_value <= 0.05 AS significant_regression, mean_delta >= -0.01 AS within_margin, mean_delta >= -0.01 AND NOT (mean_delta < 0 AND p_value <= 0.05) AS passes FROM ("
          "SELECT *, CASE WHEN wins + losses = 0 OR losses = 0 THEN 1.0 ELSE (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))) FROM range(100000) r(i) WHERE i >= losses AND i <= wins + losses) END AS p_value FROM ("
          "SELECT count(*) AS queries, avg(a.mrr10) AS baseline_mrr, avg(b.mrr10) AS candidate_mrr, avg(b.mrr10 - a.mrr10) AS mean_delta, count(*) FILTER (b.mrr10 > a.mrr10) AS wins, count(*) FILTER (b.mrr10 = a.mrr10) AS ties, count(*) FILTER (b.mrr10 < a.mrr10) AS losses "
          "FROM metrics a JOIN metrics b USING (query_id) WHERE a.system = 'quantity' AND b.system = 'price'))"),
)
def _(t):
    scores = ev.mrr_exact(t.run("quantity"), t.qrels, 10).withColumnRenamed("value", "baseline").join(
        ev.mrr_exact(t.run("price"), t.qrels, 10).withColumnRenamed("value", "candidate"), "query_id"
    )
    return sg.sign_test(scores)


# -- selection -----------------------------------------------------------------------------------

_OVERLAP = "SELECT a.query_id, count(b.document_id) / 10.0 AS o, max(CASE WHEN a.rank = 1 AND b.rank = 1 THEN 1 ELSE 0 END) AS t1 FROM runs a LEFT JOIN (SELECT * FROM runs WHERE system = 'price' AND rank <= 10) b USING (query_id, document_id) WHERE a.system = 'quantity' AND a.rank <= 10 GROUP BY 1"
_STABILITY = f"(SELECT count(*) AS queries, avg(o) AS mean_overlap, quantile_cont(o, 0.05) AS p05_overlap, avg(t1) AS top1_agreement FROM ({_OVERLAP}))"


@query("e19_ranking_stability", "queries:i mean_overlap:f6 p05_overlap:f6 top1_agreement:f6", with_("runs", f"SELECT * FROM {_STABILITY}"))
def _(t):
    return sl.ranking_stability(t.run("quantity"), t.run("price"), 10)


@query(
    "e20_quality_guard", "ndcg_loss:f6 loss_ok:b mean_overlap_ok:b p05_overlap_ok:b top1_ok:b status:s",
    with_("runs metrics", f"SELECT *, CASE WHEN loss_ok AND mean_overlap_ok AND p05_overlap_ok AND top1_ok THEN 'passed' ELSE 'failed' END AS status FROM (SELECT l AS ndcg_loss, l <= 0.01 AS loss_ok, mean_overlap >= 0.8 AS mean_overlap_ok, p05_overlap >= 0.6 AS p05_overlap_ok, top1_agreement >= 0.75 AS top1_ok "
          f"FROM {_STABILITY}, (SELECT avg(ndcg10) FILTER (system = 'quantity') - avg(ndcg10) FILTER (system = 'price') AS l FROM metrics))"),
)
def _(t):
    means = ndcg_values(t).agg(
        F.avg(F.when(F.col("system") == "quantity", F.col("value"))).alias("a"),
        F.avg(F.when(F.col("system") == "price", F.col("value"))).alias("b"),
    )
    stability = sl.ranking_stability(t.run("quantity"), t.run("price"), 10).join(F.broadcast(means))
    return sl.quality_guard(stability, F.col("a"), F.col("b"))


@query("e21_ann_recall", "query_id:s recall:f6",
       with_("runs", "SELECT a.query_id, count(b.document_id) / 20.0 AS recall FROM runs a LEFT JOIN (SELECT * FROM runs WHERE system = 'discount' AND rank <= 20) b USING (query_id, document_id) WHERE a.system = 'price' AND a.rank <= 20 GROUP BY 1"))
def _(t):
    return sl.ann_recall(t.run("price"), t.run("discount"), 20)


@query("e22_pick_effort", "effort:i meets_floor:b",
       with_("metrics", "SELECT coalesce(min(effort) FILTER (recall >= 0.2), max(effort)) AS effort, count(*) FILTER (recall >= 0.2) > 0 AS meets_floor FROM (SELECT CASE system WHEN 'discount' THEN 100 WHEN 'price' THEN 200 ELSE 400 END AS effort, avg(recall100) AS recall FROM metrics GROUP BY system)"))
def _(t):
    grid = ev.macro(ev.evaluate(t.runs, t.qrels, ["system"]), ["system"]).select(
        F.when(F.col("system") == "discount", 100).when(F.col("system") == "price", 200).otherwise(400).alias("effort"),
        F.col("`recall@100`").alias("recall"),
    )
    return sl.pick_effort(grid, 0.2)


_POSITION = "CASE system WHEN 'quantity' THEN 0 WHEN 'price' THEN 1 ELSE 2 END"


@query("e23_pick_best", "metric:s setting:s value:f6",
       with_("metrics", "SELECT metric, setting, round(value, 6) AS value FROM (SELECT metric, system AS setting, avg(v) AS value FROM (SELECT system, unnest(['ndcg@10', 'mrr_exact@10']) AS metric, unnest([ndcg10, mrr10]) AS v FROM metrics) GROUP BY 1, 2) "
             "QUALIFY row_number() OVER (PARTITION BY metric ORDER BY round(value, 6) DESC, " + _POSITION.replace("system", "setting") + ") = 1"))
def _(t):
    means = ev.macro(ev.evaluate(t.runs, t.qrels, ["system"]), ["system"])
    position = F.when(F.col("system") == "quantity", 0).when(F.col("system") == "price", 1).otherwise(2)
    grid = means.select(
        F.col("system").alias("setting"), position.alias("position"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(f"`{m}`", 6).alias("value")) for m in ("ndcg@10", "mrr_exact@10")])),
    )
    return sl.pick_best(grid, ["metric"])


@query("e24_dev_test_protocol", "setting:s dev_value:f6 test_value:f6",
       with_("metrics", "SELECT d.setting, d.v AS dev_value, t.v AS test_value FROM (SELECT system AS setting, avg(ndcg10) AS v FROM metrics JOIN sp USING (query_id) WHERE split = 'dev' GROUP BY 1 ORDER BY v DESC LIMIT 1) d "
             "JOIN (SELECT system AS setting, avg(ndcg10) AS v FROM metrics JOIN sp USING (query_id) WHERE split = 'test' GROUP BY 1) t USING (setting)").replace(
           " SELECT d.setting", ", sp AS (SELECT query_id, CASE WHEN place <= n // 2 THEN 'dev' ELSE 'test' END AS split FROM (SELECT query_id, row_number() OVER (ORDER BY sha256('seed' || chr(0) || query_id)) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM qrels))) SELECT d.setting", 1))
def _(t):
    from rankmill.operators.preparation import hash_split

    splits = hash_split(t.qrels.select("query_id").distinct(), "seed").select("query_id", "split")
    position = F.when(F.col("system") == "quantity", 0).when(F.col("system") == "price", 1).otherwise(2)
    rows = ndcg_values(t).join(splits, "query_id").select(
        "split", F.col("system").alias("setting"), position.alias("position"), "query_id", "value"
    )
    return sl.dev_test(rows)


# -- latency -------------------------------------------------------------------------------------

_LATENCY = "count(*) AS samples, avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS maximum"


def samples(t):
    return t.events.selectExpr("event_type route", "user_id % 4 concurrency", "value duration_ms")


@query("e25_latency_summary", "route:s concurrency:i samples:i mean:f6 p50:f6 p95:f6 p99:f6 maximum:f6",
       f"SELECT event_type AS route, user_id % 4 AS concurrency, {_LATENCY} FROM events GROUP BY 1, 2")
def _(t):
    return sl.latency_summary(samples(t), ["route", "concurrency"])


@query("e25_latency_overall", "samples:i mean:f6 p50:f6 p95:f6 p99:f6 maximum:f6", f"SELECT {_LATENCY} FROM events")
def _(t):
    return sl.latency_summary(samples(t))


@query("e26_latency_gate", "p95:f6 distinct_queries:i within_budget:b enough_queries:b",
       f"SELECT p95, distinct_queries, p95 <= 200 AS within_budget, distinct_queries >= 500 AS enough_queries FROM (SELECT quantile_cont(value, 0.95) AS p95 FROM events WHERE user_id % 4 = 2), (SELECT count(DISTINCT {squeeze('text')}) AS distinct_queries FROM conversations)")
def _(t):
    summary = sl.latency_summary(samples(t), ["concurrency"])
    queries = t.raw("conversations").select(F.col("text").alias("query"))
    return sl.latency_gate(summary, queries, concurrency=2)


@query("e35_latency_drift", "route:s same_samples:b p50_drift:f6 p95_drift:f6 p99_drift:f6 within_limit:b",
       "SELECT *, same_samples AND greatest(p50_drift, p95_drift, p99_drift) <= 0.5 AS within_limit FROM (SELECT event_type AS route, true AS same_samples, "
       + ", ".join(f"abs(quantile_cont(value, {p}) - quantile_cont(value * 1.25 + 1, {p})) / greatest(quantile_cont(value, {p}), quantile_cont(value * 1.25 + 1, {p})) AS p{n}_drift" for p, n in ((0.5, 50), (0.95, 95), (0.99, 99)))
       + " FROM events GROUP BY 1)")
def _(t):
    live = samples(t).withColumn("duration_ms", F.col("duration_ms") * 1.25 + 1)
    return sl.latency_drift(sl.latency_summary(samples(t), ["route"]), sl.latency_summary(live, ["route"]), ["route"])


@query("m14_latency_histogram", "route:s bound:f6 cumulative:i count:i sum:f4",
       "SELECT event_type AS route, bound, count(*) FILTER (value <= bound) AS cumulative, count(*) AS count, sum(value) AS sum FROM events, (SELECT unnest([5, 10, 25, 50, 100, 250, 500]) AS bound) GROUP BY 1, 2")
def _(t):
    return sl.latency_histogram(samples(t), (5, 10, 25, 50, 100, 250, 500))


@query(
    "e33_paired_trials", "numeric_trials:i base64_trials:i numeric_bytes:f6 base64_bytes:f6 payload_reduction:f6 throughput_ratio:f6 p95_ratio:f6 complete:b payload_ok:b throughput_ok:b p95_ok:b",
    "SELECT *, 1 - base64_bytes / numeric_bytes AS payload_reduction, b_t / n_t AS throughput_ratio, b_p / n_p AS p95_ratio, numeric_trials = base64_trials AS complete, 1 - base64_bytes / numeric_bytes >= 0.6 AS payload_ok, b_t / n_t >= 0.95 AS throughput_ok, b_p / n_p <= 1.05 AS p95_ok FROM ("
    "SELECT 30 AS numeric_trials, 30 AS base64_trials, quantile_cont(bytes, 0.5) AS numeric_bytes, quantile_cont(bytes / 3, 0.5) AS base64_bytes, quantile_cont(rate, 0.5) AS n_t, quantile_cont(rate * 1.2, 0.5) AS b_t, quantile_cont(p95, 0.5) AS n_p, quantile_cont(p95 * 0.9, 0.5) AS b_p "
    "FROM (SELECT day(ts), sum(value) AS bytes, avg(value) AS rate, max(value) AS p95 FROM events GROUP BY 1))",
)
def _(t):
    day = F.dayofmonth("ts").alias("day")
    base = t.events.groupBy(day).agg(
        F.sum("value").alias("bytes"), F.avg("value").alias("rate"), F.max("value").alias("p95")
    )

    def arm(name, size, rate, p95):
        return F.struct(
            F.lit(name).alias("arm"), (F.col("bytes") * size).alias("serialized_bytes"), (F.col("rate") * rate).alias("documents_per_second"),
            (F.col("p95") * p95).alias("p95_ms"), F.lit(10).alias("document_count"), F.lit(0).alias("failed_items"), F.lit(10).alias("vector_count"),
        )

    trials = base.select(F.inline(F.array(arm("numeric", 1.0, 1.0, 1.0), arm("base64", 1 / 3, 1.2, 0.9))))
    return sl.paired_trials(trials)


