"""Judgment and catalogue preparation: votes, audits, splits, samples and digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankmill.functions.ids import natural_order
from rankmill.functions.text import canonical_json, squeeze
from rankmill.operators.ordering import dense_index, spanning_sample
from rankmill.session import broadcast_if_small

# Judgment labels and their gains.
LABEL_GAINS = {"Exact": 2, "Partial": 1, "Irrelevant": 0}

PAIR = ("query_id", "product_id")


def label_gain(label: Column) -> Column:
    entries = [F.lit(x) for item in LABEL_GAINS.items() for x in item]
    return F.try_element_at(F.create_map(*entries), label)


def _votes(judgments: DataFrame) -> DataFrame:
    """Counts per (query, product, gain): at most one row per gain and pair."""
    return judgments.groupBy(*PAIR, label_gain(F.col("label")).alias("gain")).agg(
        F.count(F.lit(1)).alias("votes")
    )


def aggregate_labels(judgments: DataFrame) -> DataFrame:
    """(query_id, document_id, relevance): majority gain per pair, the lower gain on a tie."""
    return _votes(judgments).groupBy(*PAIR).agg(
        F.max_by("gain", F.struct(F.col("votes"), -F.col("gain"))).alias("relevance")
    ).select("query_id", F.col("product_id").alias("document_id"), "relevance")


def hash_part(judgments: DataFrame, parts: int, part: int = 0) -> DataFrame:
    """One of `parts` disjoint judgment sets, dealt by a hash of the (query_id, document_id) pair."""
    digest = F.substring(F.md5(F.concat_ws("|", "query_id", "document_id")), 1, 7)
    return judgments.where(F.conv(digest, 16, 10).cast("long") % parts == part)


def label_audit(judgments: DataFrame) -> DataFrame:
    """One row: raw and unique judgments, repeated pairs and rows, conflicts, label counts."""
    pairs = _votes(judgments).groupBy(*PAIR).agg(
        F.sum("votes").alias("rows"),
        F.count(F.lit(1)).alias("gains"),
        *[
            F.sum(F.when(F.col("gain") == gain, F.col("votes")).otherwise(0)).alias(label)
            for label, gain in LABEL_GAINS.items()
        ],
    )
    return pairs.agg(
        F.sum("rows").alias("raw_judgments"),
        F.count(F.lit(1)).alias("unique_pairs"),
        F.count_if(F.col("rows") > 1).alias("duplicate_pairs"),
        (F.sum("rows") - F.count(F.lit(1))).alias("duplicate_rows"),
        F.count_if(F.col("gains") > 1).alias("conflicting_pairs"),
        *[F.sum(label).alias(f"{label.lower()}_labels") for label in LABEL_GAINS],
    )


def label_conflicts(judgments: DataFrame) -> DataFrame:
    """Annotations of pairs with more than one gain, each with the pair's chosen gain.

    The rows keep their own columns (annotation order included); they are not gathered per pair,
    because one pair may have any number of annotations.
    """
    conflicted = _votes(judgments).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("__gains"),
        F.max_by("gain", F.struct(F.col("votes"), -F.col("gain"))).alias("chosen_gain"),
    ).where(F.col("__gains") > 1).drop("__gains")
    return judgments.join(broadcast_if_small(conflicted), list(PAIR))


def product_audit(products: DataFrame, optional: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """One row of counts: rows, repeated and blank ids, blank titles, gaps and bad numbers."""

    def blank(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""

    def bad(name: str) -> Column:
        number = F.col(name).cast("string").try_cast("double")
        usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
        return ~blank(name) & ~F.coalesce(usable, F.lit(False))

    per_id = products.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(blank("title")).alias("blank_title"),
        *[F.count_if(blank(c)).alias(f"missing_{c}") for c in optional],
        *[F.count_if(bad(c)).alias(f"bad_{c}") for c in numeric],
    )
    return per_id.agg(
        F.sum("rows").alias("products"),
        F.count_if(F.col("rows") > 1).alias("duplicate_ids"),
        F.sum(F.when(blank("product_id"), F.col("rows")).otherwise(0)).alias("blank_id"),
        F.sum("blank_title").alias("blank_title"),
        *[F.sum(f"missing_{c}").alias(f"missing_{c}") for c in optional],
        *[F.sum(f"bad_{c}").alias(f"bad_{c}") for c in numeric],
    )


def orphans(judgments: DataFrame, queries: DataFrame, products: DataFrame) -> DataFrame:
    """Judgments whose query or product is absent, with the side that is missing."""
    columns = judgments.columns
    no_query = judgments.join(queries.select("query_id").distinct(), "query_id", "left_anti")
    no_product = judgments.join(
        products.select("product_id").distinct(), "product_id", "left_anti"
    )
    return no_query.select(*columns, F.lit("query").alias("missing")).unionByName(
        no_product.select(*columns, F.lit("product").alias("missing"))
    )


def orphan_rate(judgments: DataFrame, products: DataFrame, limit: float = 0.01) -> DataFrame:
    """One row: judgments, those without a product, their share and whether it is tolerated."""
    known = products.select("product_id", F.lit(True).alias("__known")).distinct()
    sizes = judgments.groupBy("product_id").agg(F.count(F.lit(1)).alias("__rows"))
    missing = F.col("__known").isNull()
    return sizes.join(known, "product_id", "left").agg(
        F.sum("__rows").alias("judgments"),
        F.coalesce(F.sum(F.when(missing, F.col("__rows"))), F.lit(0)).alias("orphan_judgments"),
        F.count_if(missing).alias("orphan_products"),
    ).withColumn(
        "orphan_rate", F.col("orphan_judgments") / F.col("judgments")
    ).withColumn("within_limit", F.col("orphan_rate") <= limit)


def invalid_labels(judgments: DataFrame, queries: DataFrame) -> DataFrame:
    """Annotations with an unknown label or topic."""
    known = queries.select("query_id").distinct().withColumn("__known", F.lit(True))
    fault = F.when(label_gain(F.col("label")).isNull(), "unknown_label").when(
        F.col("__known").isNull(), "unknown_query"
    )
    return (
        judgments.join(known, "query_id", "left")
        .withColumn("fault", fault)
        .where(F.col("fault").isNotNull())
        .drop("__known")
    )


def hash_split(queries: DataFrame, seed: str) -> DataFrame:
    """Queries with a `split`: the lower half by seeded SHA-256 is dev, the rest test."""
    key = F.sha2(F.concat(F.lit(seed + "\0"), F.col("query_id")), 256)
    indexed = dense_index(
        queries.withColumn("__key", key), [F.col("__key"), *natural_order("query_id")], "__place"
    )
    total = indexed.agg(F.count(F.lit(1)).alias("__total"))
    return indexed.join(F.broadcast(total)).withColumn(
        "split", F.when(F.col("__place") < F.floor(F.col("__total") / 2), "dev").otherwise("test")
    ).drop("__key", "__place", "__total")


def _selection_key(seed: str, kind: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:{kind}:"), F.col("product_id")), 256)


def _numbered(rows: DataFrame, prefix: str) -> DataFrame:
    """`prefix-001` onwards in key order; the input is already limited to the sample size."""
    place = F.row_number().over(W.orderBy("__key"))
    return rows.withColumn("query_id", F.format_string(prefix + "-%03d", place))


def known_item_sample(
    products: DataFrame, seed: str, sku_queries: int, title_queries: int, sku_prefix: str
) -> DataFrame:
    """(query_id, query, kind, expected_document_id, relevance) of a hash-chosen sample.

    Title queries use the first product, by hash, of each distinct folded title.
    """
    skus = (
        products.select("product_id", _selection_key(seed, "sku").alias("__key"))
        .orderBy("__key", "product_id").limit(sku_queries)
    )
    by_title = (
        products.select(
            "product_id", F.trim("title").alias("title"),
            squeeze(F.col("title")).alias("__folded"), _selection_key(seed, "title").alias("__key"),
        )
        .where(F.col("__folded") != "")
        .groupBy("__folded")
        .agg(F.min(F.struct("__key", "product_id", "title")).alias("__first"))
        .select("__first.*")
        .orderBy("__key", "product_id").limit(title_queries)
    )
    columns = ["query_id", "query", "kind", "expected_document_id"]
    sku_rows = _numbered(skus, "sku").select(
        "query_id", F.concat(F.lit(sku_prefix + "-"), "product_id").alias("query"),
        F.lit("synthetic_sku").alias("kind"), F.col("product_id").alias("expected_document_id"),
    )
    title_rows = _numbered(by_title, "title").select(
        "query_id", F.col("title").alias("query"), F.lit("exact_title").alias("kind"),
        F.col("product_id").alias("expected_document_id"),
    )
    return sku_rows.select(*columns).unionByName(title_rows.select(*columns)).withColumn(
        "relevance", F.lit(2)
    )


def hash_sample(ids: DataFrame, key: str, salt: str, size: int) -> DataFrame:
    """The `size` ids with the lowest salted SHA-256."""
    return (
        ids.select(key)
        .withColumn("__hash", F.sha2(F.concat(F.lit(salt), F.col(key)), 256))
        .orderBy("__hash", *natural_order(key))
        .limit(size)
        .drop("__hash")
    )


def clip_gains(qrels: DataFrame) -> DataFrame:
    """Negative relevance becomes zero; `clipped` marks the rows."""
    return qrels.withColumn("clipped", F.col("relevance") < 0).withColumn(
        "relevance", F.greatest("relevance", F.lit(0))
    )


def alignment_counts(products: DataFrame, queries: DataFrame, judgments: DataFrame) -> DataFrame:
    """One row: products, queries, judgments, judged queries and judged products."""
    rows = (
        products.agg(F.count(F.lit(1)).alias("products")),
        queries.agg(F.count(F.lit(1)).alias("queries")),
        judgments.agg(
            F.count(F.lit(1)).alias("judgments"),
        ),
        judgments.select("query_id").distinct().agg(F.count(F.lit(1)).alias("judged_queries")),
        judgments.select("product_id").distinct().agg(F.count(F.lit(1)).alias("judged_products")),
    )
    out = rows[0]
    for row in rows[1:]:
        out = out.join(F.broadcast(row))  # every side is one aggregate row
    return out


# -- digests -------------------------------------------------------------------------------------

def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of the row's compact JSON with keys in order."""
    return F.sha2(canonical_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def content_digest(df: DataFrame, key: str) -> DataFrame:
    """(key, digest) per row."""
    return df.select(key, row_digest(df.columns).alias("digest"))


def _digest_number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(38,0)")


def table_digest(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys and an order-free digest of all rows."""
    rows = content_digest(df, key)
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("__rows"), F.sum(_digest_number(F.col("digest"))).alias("__sum")
    ).agg(
        F.sum("__rows").alias("documents"),
        F.count(F.lit(1)).alias("ids"),
        F.sum("__sum").cast("string").alias("digest"),
    )


def compare_content(expected: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """One row: counts of both sides, missing, unexpected and changed ids, and whether all agree."""
    columns = sorted(set(expected.columns) & set(live.columns))
    a = content_digest(expected.select(*columns), key).withColumnRenamed("digest", "__a")
    b = content_digest(live.select(*columns), key).withColumnRenamed("digest", "__b")
    total = a.join(b, key, "full_outer").agg(
        F.count("__a").alias("expected"),
        F.count("__b").alias("live"),
        F.count_if(F.col("__b").isNull()).alias("missing"),
        F.count_if(F.col("__a").isNull()).alias("unexpected"),
        F.count_if(F.col("__a") != F.col("__b")).alias("changed"),
    )
    return total.withColumn(
        "identical", (F.col("missing") + F.col("unexpected") + F.col("changed")) == 0
    )


def key_ranges(df: DataFrame, key: str, ranges: int = 256) -> list:
    """At most `ranges` - 1 keys that cut the table into ranges of about equal size, drawn from its sorted keys."""
    found = spanning_sample(df.select(key), [F.col(key)], ranges + 1).orderBy(key).select(key).distinct().collect()  # bounded by `ranges`
    return sorted(r[0] for r in found)[1:-1]


def range_digests(df: DataFrame, key: str, bounds: Sequence, columns: Sequence[str] | None = None) -> DataFrame:
    """(range, rows, digest) by the ranges of the key between `bounds`; a null key lies in range -1.

    Keys are part of the row digests, so equal sums mean equal sorted rows. Tasks add up their own rows first.
    """
    rows = df.select(_range_of(F.col(key), bounds).alias("range"), row_digest(columns or df.columns).alias("__d"))
    return rows.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.sum(_digest_number(F.col("__d"))).cast("string").alias("digest"))


def _range_of(key: Column, bounds: Sequence) -> Column:
    kept = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<string>")
    below = F.size(F.filter(kept, lambda b: b <= key)) if bounds else F.lit(0)
    return F.when(key.isNull(), -1).otherwise(below)


def differing_rows(expected: DataFrame, live: DataFrame, key: str, ranges: int = 256) -> DataFrame:
    """(key, fault): rows that are missing, unexpected or changed, found from the top down.

    Both tables are added up per range of the key first; only rows of ranges whose sums differ are brought together.
    Keys are unique on each side.
    """
    columns = sorted(set(expected.columns) & set(live.columns))
    bounds = key_ranges(expected, key, ranges)
    a, b = (range_digests(x.select(*columns), key, bounds) for x in (expected, live))
    unequal = a.join(b.withColumnsRenamed({"rows": "__r", "digest": "__d"}), "range", "full_outer").where(
        ~(F.col("rows").eqNullSafe(F.col("__r")) & F.col("digest").eqNullSafe(F.col("__d")))
    )
    wanted = [r[0] for r in unequal.select("range").collect()]  # at most `ranges` + 1
    some = [x.select(*columns).where(_range_of(F.col(key), bounds).isin(*wanted)) for x in (expected, live)] if wanted else [x.select(*columns).limit(0) for x in (expected, live)]
    left = content_digest(some[0], key).withColumnRenamed("digest", "__a")
    right = content_digest(some[1], key).withColumnRenamed("digest", "__b")
    fault = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "unexpected").when(F.col("__a") != F.col("__b"), "changed")
    return left.join(right, key, "full_outer").select(key, fault.alias("fault")).where(F.col("fault").isNotNull())


def order_faults(vectors: DataFrame, corpus: DataFrame) -> DataFrame:
    """(product_id, position, expected_position) of the vectors that do not stand where the corpus has their product.

    Both sides have (product_id, position), positions counted from 0.
    """
    a = corpus.select("product_id", F.col("position").alias("expected_position"))
    return vectors.select("product_id", "position").join(a, "product_id", "left").where(~F.col("position").eqNullSafe(F.col("expected_position")))


def sparse_entries(embedding: str = "embedding") -> Column:
    """A token map as JSON, tokens in order."""
    return F.to_json(F.array_sort(F.map_entries(embedding)))


def sparse_corpus_check(vectors: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: record counts, missing and extra ids, stored values and an order-free digest."""
    a = corpus.select("product_id", F.lit(True).alias("__c"))
    entry = sparse_entries()
    b = vectors.select(
        "product_id", F.size("embedding").alias("__n"),
        F.sha2(F.concat_ws("\t", "product_id", entry), 256).alias("__d"),
    )
    return a.join(b, "product_id", "full_outer").agg(
        F.count("__c").alias("corpus_records"),
        F.count("__d").alias("records"),
        F.count_if(F.col("__d").isNull()).alias("missing"),
        F.count_if(F.col("__c").isNull()).alias("extra"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("embedding_values"),
        F.sum(_digest_number(F.col("__d"))).cast("string").alias("digest"),
    )


