"""Interaction of text filters over every order in which they can run.

Each document gets the set of filters that it fails. What a set loses at which step of which order is not
replayed: for a prefix of filters outside the set followed by one inside, the orders with that prefix are one
interval of lexicographic (Lehmer) ranks. Counts are added where an interval starts and taken off where it
ends, and a running sum over the ranks gives the removals of all orders at once.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.session import cut_lineage

FILTERS = "ABCDE"
#: A: fewest words. B: least share of distinct words. C: largest share of capitals. D: marks that fail.
MIN_WORDS = 50
MIN_DISTINCT = 0.65
MAX_CAPITALS = 0.05
MARKS = r"[#$%&*|]"
_SPACE = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text only: letter and whether a (not null) text fails it."""
    words = F.filter(F.split(text, _SPACE, -1), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * round(100 * MIN_DISTINCT),
        "C": capitals * 100 > F.length(text) * round(100 * MAX_CAPITALS),
        "D": text.rlike(MARKS),
    }


def lehmer_rank(prefix: str, letters: str = FILTERS) -> int:
    """Rank of the first order that begins with ``prefix`` among all orders of ``letters``."""
    rank, left = 0, list(letters)
    for letter in prefix:
        place = left.index(letter)
        rank += place * factorial(len(left) - 1)
        left.remove(letter)
    return rank


def interval_edges(letters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """(set of failed filters as bits, step, rank, +1 or -1) of all intervals of ranks."""
    edges = []
    for bits in range(1, 1 << len(letters)):
        failed = [x for i, x in enumerate(letters) if bits >> i & 1]
        passed = [x for x in letters if x not in failed]
        for before in range(len(passed) + 1):
            for head in permutations(passed, before):
                for letter in failed:
                    start = lehmer_rank("".join(head) + letter, letters)
                    edges.append((bits, before + 1, start, 1))
                    edges.append((bits, before + 1, start + factorial(len(letters) - before - 1), -1))
    return edges


def failure_sets(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, bits, n, good, toxic): documents by part and set of failed filters; bit i stands for letter i.

    A null text is empty, a null part the empty string. E compares whole texts by their SHA-256: a row fails it if
    another row of a smaller id has its text; rows of a null id neither fail it nor make others fail. Rows with
    the same id count each. Several labels of one document count once, as 1 if any is.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    flags = failures(F.col("__body"))
    bits = sum((F.when(flags[x], 1 << i).otherwise(0) for i, x in enumerate(FILTERS) if x in flags), F.lit(0))
    rows = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), body.alias("__body"))
    rows = cut_lineage(rows.select("id", "part", F.unhex(F.sha2("__body", 256)).alias("digest"), bits.alias("bits")))
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    # the pair (id, digest) tells the first document of a text: no join has the text alone as its key
    marked = rows.join(first, ["id", "digest"], "left").join(known, "id", "left")
    again = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return marked.groupBy("part", (F.col("bits") + again).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )


def audit(sets: DataFrame) -> DataFrame:
    """One row per part, order and step from ``failure_sets``: (part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley). No rows for an empty table."""
    spark, steps = sets.sparkSession, len(FILTERS)
    # 840 intervals at five filters: a table of fixed size
    edges = spark.createDataFrame(interval_edges(), "bits int, step int, rank int, sign int")
    ends = sets.join(F.broadcast(edges), "bits").groupBy("part", "step", "rank").agg(
        *[F.sum(F.col(c) * F.col("sign")).alias(c) for c in ("n", "good", "toxic")]
    )
    fails = lambda i, only: F.sum(F.when(F.col("bits") == (1 << i) if only else F.col("bits").bitwiseAND(1 << i) > 0, F.col("n")).otherwise(0))
    totals = sets.groupBy("part").agg(
        F.sum("n").alias("total"), F.array(*[fails(i, False) for i in range(steps)]).alias("fails"), F.array(*[fails(i, True) for i in range(steps)]).alias("only")
    )
    grid = totals.select("part", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("rank"), "total", "fails", "only")
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).join(ends, ["part", "step", "rank"], "left")
    up_to = Window.partitionBy("part", "step").orderBy("rank")
    summed = grid.select(
        "part", "step", "rank", "total", "fails", "only",
        *[F.sum(F.coalesce(c, F.lit(0))).over(up_to).alias(name) for c, name in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))],
    )
    order = F.element_at(F.split(F.lit(" ".join(ORDERS)), " "), F.col("rank") + 1)
    named = summed.withColumn("filter_order", order).withColumn("place", F.instr(F.lit(FILTERS), F.substr("filter_order", F.col("step"), F.lit(1))))
    so_far = F.sum("removed").over(Window.partitionBy("part", "rank").orderBy("step"))
    long = lambda c, name: c.cast("long").alias(name)
    return named.select(
        "part", "filter_order", "step", long(F.col("total") - so_far, "kept"), long(F.col("removed"), "removed"),
        long(F.element_at("fails", F.col("place")) - F.col("removed"), "redundant"), long(F.element_at("only", F.col("place")), "unique_fails"),
        long(F.col("good_lost"), "good_lost"), long(F.col("toxic_lost"), "toxic_lost"),
        long(F.sum("removed").over(Window.partitionBy("part", "place")), "shapley"),
    )


#: The same counts without ranks: every order and step by what a set of failed filters holds.
SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM {documents}),
words AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM texts),
marked AS (
  SELECT part, doc_id, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * len(regexp_extract_all(body, '[A-Z]')) > 5 * length(body) AS c, regexp_matches(body, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS e FROM words),
known AS (SELECT doc_id, max(coalesce(quality = 1, false)::int) AS good, max(coalesce(toxic = 1, false)::int) AS toxic FROM {labels} GROUP BY 1),
sets AS (
  SELECT part, [a, b, c, d, e] AS f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM marked LEFT JOIN known USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM l p, l q, l r, l s, l t
  WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
steps AS (SELECT o, i AS step FROM orders, l),
counted AS (
  SELECT part, o, step,
    sum(n) FILTER (NOT list_contains(list_transform(o[1:step], lambda x: f[x]), true)) AS kept,
    sum(n) FILTER (f[o[step]] AND NOT list_contains(list_transform(o[1:step - 1], lambda x: f[x]), true)) AS removed,
    sum(n) FILTER (f[o[step]] AND list_contains(list_transform(o[1:step - 1], lambda x: f[x]), true)) AS redundant,
    sum(n) FILTER (f[o[step]] AND len(list_filter(f, lambda x: x)) = 1) AS unique_fails,
    sum(good) FILTER (f[o[step]] AND NOT list_contains(list_transform(o[1:step - 1], lambda x: f[x]), true)) AS good_lost,
    sum(toxic) FILTER (f[o[step]] AND NOT list_contains(list_transform(o[1:step - 1], lambda x: f[x]), true)) AS toxic_lost
  FROM sets, steps GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x::bigint, 1)), '') AS filter_order, step::int AS step,
  coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant,
  coalesce(unique_fails, 0)::bigint AS unique_fails, coalesce(good_lost, 0)::bigint AS good_lost,
  coalesce(toxic_lost, 0)::bigint AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, o[step]), 0)::bigint AS shapley
FROM counted
"""
