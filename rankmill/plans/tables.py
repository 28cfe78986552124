"""Engine tables derived from the given parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.functions.sparse import counts_in_row
from rankmill.functions.text import tokenize
from rankmill.functions.vectors import hash_embedding
from rankmill.operators.joins import product_stores
from rankmill.operators.lexical import containing, document_texts, query_terms
from rankmill.operators.ordering import top_k
from rankmill.operators.preparation import aggregate_labels, hash_part
from rankmill.functions.ids import natural_order
from rankmill.session import broadcast_if_small, cut_lineage, scratch_path, spread

RUN_VALUES = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}
#: Rows of the lines that a task aggregates and sorts.
TASK_ROWS = 1_000_000
PRODUCT_FIELDS = {
    c: c for c in ("title", "product_class", "category", "brand", "description", "features")
}


class Tables:
    """One scale folder; every attribute is a lazily planned DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)

    # -- text --

    @cached_property
    def docs(self) -> DataFrame:
        return spread(self.raw("documents")).select(
            F.col("doc_id").cast("string").alias("document_id"), "text",
            F.col("lang").alias("product_class"), F.col("source").alias("brand"),
        )

    @cached_property
    def queries(self) -> DataFrame:
        return self.raw("benchmark").select(
            F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query")
        )

    @cached_property
    def doc_texts(self) -> DataFrame:
        return document_texts(spread(self.raw("documents")), "doc_id", {"text": "text"})

    @cached_property
    def terms(self) -> DataFrame:
        return query_terms(self.queries)

    @cached_property
    def passage_qrels(self) -> DataFrame:
        """Documents that contain a whole query text, gain 2."""
        found = containing(self.docs.select("document_id", "text"), self.queries)
        return cut_lineage(found.select("query_id", "document_id", F.lit(2).alias("relevance")))

    # -- products --

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "cast(p_partkey as string) product_id", "cast(p_partkey as string) document_id",
            "p_partkey entity_id", "p_name title", "concat(p_name, ' by ', p_brand) description",
            "concat('size ', p_size div 10) category", "p_type product_class", "p_brand brand",
            "concat('size ', p_size) features", "concat('RW-', p_partkey) sku",
            "if(p_size % 10 = 0, 2, 1) status", "p_size % 4 + 1 visibility",
            "p_partkey % 3 <> 0 is_salable", "p_retailprice price", "p_size",
        )

    @cached_property
    def product_queries(self) -> DataFrame:
        """One query per distinct class and title."""
        return self.raw("part").selectExpr(
            "replace(lower(concat(p_type, ' ', p_name)), ' ', '-') query_id",
            "concat(p_type, ' ', p_name) query",
        ).distinct()

    @cached_property
    def product_texts(self) -> DataFrame:
        return document_texts(spread(self.products), "product_id", PRODUCT_FIELDS, keep=("brand", "category", "product_class"))

    # -- judgments and runs --

    @cached_property
    def judgments_raw(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "cast(l_suppkey as string) query_id", "cast(l_partkey as string) product_id",
            "case l_returnflag when 'A' then 'Exact' when 'N' then 'Partial' else 'Irrelevant' end label",
            "l_linestatus", "l_orderkey", "l_linenumber",
        )

    @cached_property
    def judgments(self) -> DataFrame:
        """Majority gains of all annotations."""
        return cut_lineage(aggregate_labels(self.judgments_raw))

    @cached_property
    def qrels(self) -> DataFrame:
        """The judgment set of the evaluations: one of two parts, so that runs hold unjudged pairs."""
        votes = hash_part(self.judgments_raw.withColumnRenamed("product_id", "document_id"), 2)
        return cut_lineage(aggregate_labels(votes.withColumnRenamed("document_id", "product_id")))

    @cached_property
    def pair_numbers(self) -> DataFrame:
        """The values of a pair by its numbers, in as many parts as keep the rows of a task bounded.

        The lines of a query meet in one part, where its pairs can be ranked without another exchange, unless one
        query has more than TASK_ROWS of them.
        """
        lines = self.raw("lineitem").select("l_suppkey", "l_partkey", *RUN_VALUES.values())
        default = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        sizes = lines.groupBy("l_suppkey").count().agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first()
        keys = ["l_suppkey"] if (sizes["most"] or 0) <= TASK_ROWS else ["l_suppkey", "l_partkey"]
        return lines.repartition(max(default, -(-(sizes["rows"] or 0) // TASK_ROWS)), *keys).groupBy("l_suppkey", "l_partkey").agg(*[F.max(c).alias(s) for s, c in RUN_VALUES.items()])

    @cached_property
    def pair_values(self) -> DataFrame:
        return self.pair_numbers.select(
            F.col("l_suppkey").cast("string").alias("query_id"), F.col("l_partkey").cast("string").alias("document_id"), *RUN_VALUES
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Three systems: the first 100 documents per query by each line value.

        Judgments and runs are materialised like the stored tables they stand for.
        """
        values = F.array(
            *[
                F.struct(F.lit(s).alias("system"), F.col(s).cast("double").alias("score"))
                for s in RUN_VALUES
            ]
        )
        # the natural order of ids that are numbers, without a decimal and a text for each row to sort
        number = F.col("l_partkey")
        order = [F.col("score").desc(), F.when(number >= 0, 0).otherwise(1), number]
        numbers = self.pair_numbers.select("l_suppkey", "l_partkey", F.inline(values))
        ranked = top_k(numbers, ["system", "l_suppkey"], order, 100)
        return cut_lineage(ranked.select(
            F.col("l_suppkey").cast("string").alias("query_id"), F.col("l_partkey").cast("string").alias("document_id"),
            "system", "score", "rank", F.col("system").alias("tag"),
        ))

    def run(self, system: str) -> DataFrame:
        order = [F.col("score").desc(), *natural_order("document_id")]
        scored = self.pair_values.select(
            "query_id", "document_id", F.col(system).cast("double").alias("score")
        )
        return top_k(scored, ["query_id"], order, 100).withColumn("tag", F.lit(system))

    @cached_property
    def pair_scores(self) -> DataFrame:
        """A stand-in pair scorer: the first seven hex digits of the pair's digest, in [0, 1)."""
        digest = F.sha2(F.concat_ws("|", "query_id", "document_id"), 256)
        return self.pair_values.select(
            "query_id", "document_id",
            (F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / float(16**7)).alias("score"),
        )

    # -- vectors --

    @cached_property
    def vectors(self) -> DataFrame:
        return spread(self.raw("embeddings")).select(
            F.col("vec_id").cast("string").alias("document_id"), "embedding", "label"
        )

    @cached_property
    def vector_queries(self) -> DataFrame:
        return self.vectors.select(F.col("document_id").alias("query_id"), "embedding")

    @cached_property
    def doc_vectors(self) -> DataFrame:
        """Hash embeddings of the documents."""
        return hash_embedding(self.docs, "document_id", "text")

    @cached_property
    def query_vectors(self) -> DataFrame:
        return hash_embedding(self.queries, "query_id", "query")

    @cached_property
    def sparse_vectors(self) -> DataFrame:
        """Word counts of the documents as token weights, counted in the row unless documents share an id."""
        words = self.docs.select("document_id", tokenize(F.col("text")).alias("words"))
        counted = words.where(F.size("words") > 0).select("document_id", counts_in_row(F.col("words")).alias("embedding"))
        ids = self.raw("documents").groupBy("doc_id").count()
        if ids.where("count > 1").isEmpty():
            return counted
        counts = counted.select("document_id", F.explode("embedding").alias("token", "n")).groupBy("document_id", "token").agg(F.sum("n").alias("w"))
        return counts.groupBy("document_id").agg(
            F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("embedding")
        )

    @cached_property
    def query_tokens(self) -> DataFrame:
        return self.queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("token"))

    # -- events --

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def journal(self) -> DataFrame:
        return self.events.selectExpr(
            "event_id + 1 change_id", "user_id % 3 + 1 store_id", "'PRODUCT' entity_type",
            "user_id product_id",
            "case when event_type in ('purchase', 'signup') then 'UPSERT' "
            "when event_type = 'error' then 'DELETE' else 'REFRESH' end operation",
            "event_id + 1 revision", "event_type reason",
            "if(value < 0.5, 'PENDING', 'COMPLETED') native_state",
            "if(value < 1, 'PENDING', 'COMPLETED') hybrid_state", "ts created_at", "value",
        )

    @cached_property
    def outbox_item(self) -> DataFrame:
        """Sixteen consecutive events form a job; every event is one item."""
        return self.events.selectExpr(
            "event_id div 16 + 1 job_id", "user_id % 3 + 1 store_id", "user_id % 2 + 1 generation_id",
            "if((event_id div 16) % 2 = 0, 'PRIORITY', 'EMBEDDING') lane", "user_id product_id",
            "event_id + 1 revision", "event_id + 1 earliest_change_id",
            "case (event_id div 16) % 5 when 0 then 'PENDING' when 1 then 'RETRY' "
            "when 4 then 'DEAD' else 'COMPLETED' end state",
        )

    @cached_property
    def outbox(self) -> DataFrame:
        return self.events.selectExpr(
            "event_id div 16 g", "event_id + 1 change_id", "user_id", "ts", "value"
        ).groupBy("g").agg(
            F.min("change_id").alias("earliest_change_id"),
            F.max("change_id").alias("latest_change_id"),
            F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
            F.floor(F.max("value")).cast("long").alias("v"),
        ).selectExpr(
            "g + 1 job_id", "g % 3 + 1 store_id", "g % 2 + 1 generation_id",
            "if(g % 2 = 0, 'PRIORITY', 'EMBEDDING') lane",
            "case g % 7 when 0 then 'PENDING' when 1 then 'RETRY' when 2 then 'COMPLETED' "
            "when 3 then 'COMPLETED' when 4 then 'DEAD' when 5 then 'CLAIMED' else 'PUBLISHED' end state",
            "earliest_change_id", "latest_change_id", "created_at", "updated_at",
            "v % 7 attempt_count", "v % 2 replay_count",
            "created_at + make_interval(0, 0, 0, 0, v % 48) claim_expires_at",
            "if(v % 3 = 0, null, updated_at + make_interval(0, 0, 0, v % 20)) next_eligible_at",
        )

    @cached_property
    def generations(self) -> DataFrame:
        """One generation per customer segment and nation."""
        return self.raw("customer").groupBy("c_nationkey", "c_mktsegment").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("c_acctbal") > 0).alias("positive"),
            F.count_if(F.col("c_acctbal") < -900).alias("failed"),
            F.floor(F.max("c_acctbal")).cast("long").alias("captured"),
            F.max("c_custkey").alias("top"),
        ).selectExpr(
            "cast(c_nationkey * 10 + instr('ABFHM', substr(c_mktsegment, 1, 1)) as bigint) generation_id",
            "cast(c_nationkey as bigint) store_id",
            "case c_mktsegment when 'BUILDING' then 'BUILDING' when 'AUTOMOBILE' then 'ACTIVE' "
            "when 'MACHINERY' then 'RETAINED' when 'HOUSEHOLD' then 'FAILED' else 'READY' end state",
            "n coverage_total", "positive coverage_complete", "failed coverage_failed",
            "captured captured_change_id", "c_nationkey % 5 = 0 is_fake",
            "if(c_nationkey % 4 = 0, null, sha2(c_mktsegment, 256)) encoder_identity_digest",
            "c_mktsegment contract_digest",
            "case c_nationkey % 3 when 0 then 'RESTORED' when 1 then 'RESTORE_FAILED' else null end refresh_state",
            "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(top % 30 as int)) updated_at",
        )

    @cached_property
    def store_state(self) -> DataFrame:
        """Watermarks per store from its order history."""
        return self.raw("customer").groupBy("c_nationkey").agg(
            F.max("c_custkey").alias("required"), F.min("c_custkey").alias("low"),
            F.floor(F.max("c_acctbal")).cast("long").alias("native"),
        ).selectExpr(
            "cast(c_nationkey as bigint) store_id",
            "if(c_nationkey % 4 = 3, 'NATIVE', 'HYBRID') activation_mode",
            "if(c_nationkey % 6 = 5, null, c_nationkey * 10L + 1) active_generation_id",
            "required required_watermark", "native native_watermark", "required - low % 2 hybrid_watermark",
            "c_nationkey % 2 = 0 readiness_latch",
        )

    @cached_property
    def telemetry(self) -> DataFrame:
        return self.events.selectExpr(
            "ts", "user_id % 3 + 1 store_id",
            "if(event_id % 2 = 0, 'quick_search_container', 'graphql_product_search') request_name",
            "case when event_type = 'error' then 'native_fallback' "
            "when event_type in ('click', 'view') then 'hybrid' else 'native' end route",
            "case when event_type = 'error' then 'hybrid_error' "
            "when event_type in ('click', 'view') then 'eligible' else 'known_item' end reason",
            "value duration_ms",
            "map('query_encoder', struct(if(event_type = 'error', 'failure', 'success') as outcome, "
            "value / 2 as duration_ms), 'native_candidates', "
            "struct('success' as outcome, value / 4 as duration_ms)) components",
        )

    # -- catalogue scope --

    @cached_property
    def stores(self) -> DataFrame:
        """Nations are stores, regions their websites."""
        return self.raw("nation").selectExpr(
            "cast(n_nationkey as bigint) store_id", "cast(n_regionkey as bigint) website_id", "n_name code"
        )

    @cached_property
    def product_websites(self) -> DataFrame:
        """A product is assigned to the regions of its suppliers."""
        return (
            self.raw("lineitem").select("l_partkey", "l_suppkey").distinct()
            .join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("l_partkey").alias("product_id"), F.col("n_regionkey").cast("long").alias("website_id"))
            .distinct()
        )

    @cached_property
    def categories(self) -> DataFrame:
        """Root 1, regions 10.., nations 100.. as a three-level tree."""
        regions = self.raw("region").selectExpr(
            "cast(r_regionkey + 10 as bigint) category_id",
            "concat('1/', r_regionkey + 10) path", "r_name name",
        )
        nations = self.raw("nation").selectExpr(
            "cast(n_nationkey + 100 as bigint) category_id",
            "concat('1/', n_regionkey + 10, '/', n_nationkey + 100) path", "n_name name",
        )
        return regions.unionByName(nations)

    @cached_property
    def category_products(self) -> DataFrame:
        """A product belongs to its suppliers' nation categories."""
        return (
            self.raw("lineitem").select("l_partkey", "l_suppkey").distinct()
            .join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.col("l_partkey").alias("product_id"),
                (F.col("s_nationkey") + 100).cast("long").alias("category_id"),
            ).distinct()
        )

    @cached_property
    def assignments(self) -> DataFrame:
        """(store_id, product_id): the stores of a product's websites."""
        return product_stores(self.product_websites, self.stores)
