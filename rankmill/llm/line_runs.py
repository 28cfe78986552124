"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

Lines become ids (hashes) and texts sequences of ids. The name of a suffix by its first 2w lines comes from
the names of its first w lines here and w places on. Suffixes whose prefix is unique leave, so each round
holds only what still repeats, and the rounds end when no class splits any more: such classes agree up to the
ends of their texts. The classes at depth w are the intervals of the suffix array with a longest common
prefix of w lines or more, which is all that dedup needs, so suffixes are named by hash and not numbered by a
global sort. Two overlapping powers of two give the intervals of any depth. Later copies of runs that
repeat over at least ``min_lines`` lines are deleted, and so are later copies of single lines that are passages
by their own length (``LONG_WORDS``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.common import slices
from rankmill.session import cut_lineage

#: Most doublings; a run of over 2^MAX_ROUNDS lines is reported with that length.
MAX_ROUNDS = 40
#: Words from which a single line is a run.
LONG_WORDS = 50
_NAME = ["rank", "check"]


def _repeated(suffixes: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The suffixes whose name occurs twice or more, and the numbers of such names and suffixes."""
    several = suffixes.groupBy(*_NAME).agg(F.count("*").alias("n")).where("n > 1")
    kept = cut_lineage(suffixes.join(several, _NAME).select("seq", "at", *_NAME, "n"))
    return kept, tuple(kept.agg(F.round(F.coalesce(F.sum(1 / F.col("n")), F.lit(0.0))).cast("long"), F.count("*")).first())


def _extended(suffixes: DataFrame, step: int) -> DataFrame:
    """Names of the prefixes that are ``step`` longer, where the text goes on that far."""
    later = suffixes.select("seq", (F.col("at") - step).alias("at"), F.col("rank").alias("rank2"), F.col("check").alias("check2"))
    return suffixes.join(later, ["seq", "at"]).select(
        "seq", "at", F.xxhash64("rank", "rank2", "check").alias("rank"), F.xxhash64("check2", "check", "rank2").alias("check")
    )


def repeated_suffixes(sequence: DataFrame, min_length: int) -> DataFrame:
    """(seq, at, rank, check, depth) of the suffixes whose first ``min_length`` values occur elsewhere.

    ``sequence`` has (seq, at, value), places counted from 0 without gaps. Suffixes with equal (rank,
    check) share their first ``min_length`` values. ``depth`` is a length up to which the suffix repeats: the
    largest power of two, or ``min_length`` if that is more. Joins and counts are partitioned by hash;
    no class is gathered in a task.
    """
    live, size = _repeated(sequence.select("seq", "at", F.xxhash64("value").alias("rank"), F.xxhash64(F.lit(1), "value").alias("check")))
    width, base, depths = 1, live if min_length == 1 else None, []
    for _ in range(MAX_ROUNDS):
        if not size[1]:
            break
        depths.append(live.select("seq", "at", F.lit(width).cast("long").alias("depth")))
        if base is None and width < min_length < 2 * width:
            base, _ = _repeated(_extended(live, min_length - width))
        doubled, after = _repeated(_extended(live, width))
        width *= 2
        if base is None and width == min_length:
            base = doubled
        if after == size and base is not None:
            break
        live, size = doubled, after
    if base is None:
        return live.limit(0).select("seq", "at", *_NAME, F.lit(min_length).cast("long").alias("depth"))
    deepest = depths[0]
    for part in depths[1:]:
        deepest = deepest.union(part)
    deepest = deepest.groupBy("seq", "at").agg(F.max("depth").alias("depth"))
    return base.join(deepest, ["seq", "at"]).select("seq", "at", *_NAME, F.greatest("depth", F.lit(min_length)).alias("depth"))


def _cut():
    """Text without the lines that the runs cover; ``starts`` are places of solid lines, ``sizes`` lines of the runs."""

    @F.pandas_udf("struct<text:string,removed:long>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts, sizes in batches:
            out = []
            for part in slices(iter([pd.DataFrame({"text": texts, "starts": starts, "sizes": sizes})])):
                for text, places, lengths in zip(part["text"], part["starts"], part["sizes"]):
                    if text is None:
                        out.append((None, 0))
                        continue
                    gone = {int(p) + i for p, n in zip(places, lengths) for i in range(int(n))}
                    kept, at, removed = [], 0, 0
                    for line in text.split("\n"):
                        solid = bool(line.strip(" "))
                        if solid and at in gone:
                            removed += 1
                        else:
                            kept.append(line)
                        at += solid
                    out.append(("\n".join(kept), removed))
            yield pd.DataFrame(out, columns=["text", "removed"])

    return cut


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = 2, long_words: int = LONG_WORDS) -> DataFrame:
    """All columns of ``documents``, with the later copies of repeated line runs deleted from ``text``.

    A line goes if it lies in a run of ``min_lines`` consecutive lines that also starts earlier: in a smaller
    document id (nulls last), or earlier in the same document, or if it has ``long_words`` words or more and occurs
    earlier itself. Lines are compared as they are; lines
    of spaces only are no part of runs and stay. Added columns: ``n_lines`` (solid lines), ``n_removed`` and
    ``longest_run``, a length to which a run of the document repeats, 0 if none. Null texts stay null and
    have no lines. Rows equal in id and text are one document and get the same result. Documents with
    equal ids and different texts are ordered by a hash of the text. An empty table gives no rows.
    """
    if min_lines < 1:
        raise ValueError("runs have one line at least")
    keep = [c for c in documents.columns if c not in ("n_lines", "n_removed", "longest_run")]
    docs = documents.select(*keep, F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("__seq"))
    solid = F.filter(F.split(F.col(text), "\n", -1), lambda x: F.length(F.trim(x)) > 0)
    words = F.size(F.filter(F.split("x", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    # the outer form keeps Spark from cutting the text twice, once to test for lines
    lines = docs.where(F.length(text) > 0).select(F.col("__seq").alias("seq"), F.posexplode_outer(solid).alias("at", "x")).where(F.col("x").isNotNull())
    alone = F.when(F.length("x") >= 2 * long_words - 1, words >= long_words).otherwise(F.lit(False))
    placed = lines.select("seq", "at", F.md5("x").alias("value"), alone.alias("alone")).distinct()
    sequence = placed.select("seq", "at", "value")
    if documents.select(doc_id).isEmpty():
        runs = sequence.limit(0).select("seq", "at", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("check"), F.lit(0).cast("long").alias("depth"), F.lit(0).alias("lines"))
    else:
        runs = repeated_suffixes(sequence, min_lines).withColumn("lines", F.lit(min_lines))
        if min_lines > 1:
            single, _ = _repeated(placed.where("alone").select("seq", "at", F.xxhash64("value").alias("rank"), F.xxhash64(F.lit(1), "value").alias("check")))
            runs = runs.union(single.select("seq", "at", *_NAME, F.lit(1).cast("long"), F.lit(1)))
    owners = docs.select(F.col("__seq").alias("seq"), F.col(doc_id).alias("doc")).distinct()
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "seq", "at")
    runs = runs.join(owners, "seq")
    first = runs.groupBy(*_NAME).agg(F.min(place).alias("first"))
    found = runs.join(first, _NAME).groupBy("seq").agg(F.max("depth").alias("__longest"), F.collect_list(F.when(place != F.col("first"), F.struct("at", "lines"))).alias("__starts"))
    joined = docs.join(found.withColumnRenamed("seq", "__seq"), "__seq", "left")
    marked = F.coalesce(F.size("__starts") > 0, F.lit(False))
    joined = joined.withColumn("__cut", _cut()(F.when(marked, F.col(text)), F.col("__starts.at"), F.col("__starts.lines")))
    return joined.select(
        *[F.when(marked, F.col("__cut.text")).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in keep],
        F.coalesce(F.when(F.length(text) > 0, F.size(solid)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("__cut.removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("__longest", F.lit(0)).cast("long").alias("longest_run"),
    )


#: The rows of ``dedup_lines`` with min_lines = 2 without ``longest_run``, for a table with unique ids.
SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line
    FROM {documents} WHERE text <> ''
), solid AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS place, lead(x) OVER (PARTITION BY doc_id ORDER BY line) AS following
    FROM lines WHERE trim(x) <> ''
), runs AS (
    SELECT *, following IS NOT NULL AND row_number() OVER (PARTITION BY x, following ORDER BY doc_id, place) > 1 AS later,
        len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 50 AND row_number() OVER (PARTITION BY x ORDER BY doc_id, place) > 1 AS passage FROM solid
), gone AS (
    SELECT doc_id, line, passage OR later OR coalesce(lag(later) OVER (PARTITION BY doc_id ORDER BY place), false) AS gone FROM runs
), kept AS (
    SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (WHERE NOT coalesce(gone, false)), '') AS text,
        count(gone) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
    FROM lines LEFT JOIN gone USING (doc_id, line) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text <> '' THEN k.text ELSE d.text END AS text,
    CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM {documents} d LEFT JOIN kept k USING (doc_id)
"""
