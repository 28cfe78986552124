"""Exact, radial and approximate vector retrieval, and vector comparisons."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from rankmill.functions.pairs import best_pairs, counted_pairs, pairs_within, repeated_pairs, same_ids
from rankmill.functions.topk import SCHEMA, LocalTopK, natural_rows, round_half_up
from rankmill.functions.vectors import dot, norm
from rankmill.operators.ordering import score_order, top_k
from rankmill.session import broadcast_if_small, cut_lineage

#: Query values every task may hold (16 MiB of doubles); more queries take the grid plan.
QUERY_VALUES = 2_000_000
#: Values of a stripe of vectors; a stripe of queries has a sixth of its rows, and STRIPE_LEAST at least if it is to occupy a core.
STRIPE_VALUES = 10_000_000
STRIPE_LEAST = 2_000
#: Scores of one block of documents and queries (32 MiB of doubles), whatever the number of queries.
BLOCK_SCORES = 4_000_000
#: Most cells of a query set, and rows of the blocks of either side that meet in a grid.
QUERY_CELLS = 256
PART_QUERIES = 4_096
PART_VECTORS = 4_096
#: Vectors that a task of the approximate search takes its queries past.
STORED_ROWS = 262_144
#: Pairs of one Arrow batch that leaves a task.
OUT_ROWS = 250_000
#: Radians by which cells count as wider, far above what rounding can move an angle.
ANGLE_SLACK = 1e-6


def _matrix(vectors: Iterable) -> np.ndarray:
    """Unit rows in double precision."""
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    with np.errstate(invalid="ignore"):
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _scores(docs: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return (1.0 + docs @ queries.T) / 2.0


def _blocks(rows: pd.DataFrame, queries: int):
    """Slices whose score block with `queries` columns has at most BLOCK_SCORES cells."""
    size = max(1, min(2048, BLOCK_SCORES // max(1, queries)))
    for start in range(0, len(rows), size):
        yield rows.iloc[start : start + size]


def _hide(scores, ids, query_ids, min_score, exclude_self):
    """Scores with pairs below `min_score`, and optionally a query's own document, at -inf."""
    if min_score is not None:
        scores = np.where(scores >= min_score, scores, -np.inf)
    if exclude_self and query_ids.is_unique:
        column = query_ids.get_indexer(ids)
        row = np.flatnonzero(column >= 0)
        scores[row, column[row]] = -np.inf
    elif exclude_self:
        column, row = same_ids(query_ids.to_numpy(), ids)
        scores[row, column] = -np.inf
    return scores


def _widest(min_score: float, decimals: int) -> float:
    """Largest angle at which a rounded score can reach `min_score`."""
    cosine = 2.0 * (min_score - 0.5 * 10.0**-decimals - 1e-9) - 1.0
    return float(np.arccos(np.clip(cosine, -1.0, 1.0))) + ANGLE_SLACK


def sphere_centres(matrix: np.ndarray, cells: int, rounds: int = 4) -> np.ndarray:
    """Unit centres of at most `cells` cells of unit vectors, by a few rounds of spherical means."""
    matrix = matrix[np.isfinite(matrix).all(axis=1)]
    centres = matrix[:: max(1, len(matrix) // max(1, cells))][:cells]
    for _ in range(rounds):
        near = (matrix @ centres.T).argmax(axis=1) if len(centres) else np.zeros(0, int)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, matrix)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1.0), centres)
    return centres


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1.0, 1.0))


class QueryCells:
    """Queries by cell, with the angle to the farthest member.

    By the triangle inequality on the sphere a vector whose angle to a centre exceeds the radius of the cell by
    more than `widest` is within reach of none of its queries, and the whole cell is skipped.
    """

    def __init__(self, names: Sequence[str], matrix: np.ndarray, centres: np.ndarray | None = None) -> None:
        fine = np.isfinite(matrix).all(axis=1)  # zero vectors match nothing
        names, matrix = np.asarray(names, dtype=object)[fine], matrix[fine]
        self.centres = sphere_centres(matrix, max(1, min(QUERY_CELLS, int(len(matrix) ** 0.5)))) if centres is None else centres
        cell = _angles(matrix, self.centres).argmin(axis=1) if len(matrix) else np.zeros(0, int)
        order = np.argsort(cell, kind="stable")
        self.names, self.matrix = names[order], matrix[order]
        self.rows = np.flatnonzero(fine)[order]
        self.index = pd.Index(self.names)
        self.edges = np.searchsorted(cell[order], np.arange(len(self.centres) + 1))
        angle = _angles(self.matrix, self.centres)[np.arange(len(order)), cell[order]] if len(order) else np.zeros(0)
        self.radius = np.array([angle[a:b].max(initial=0.0) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)])

    def reached(self, unit: np.ndarray, widest: float) -> np.ndarray:
        """Which cells each vector must be compared with."""
        return (_angles(unit, self.centres) - self.radius <= widest) & (np.diff(self.edges) > 0)

    def scores(self, unit: np.ndarray, widest: float, decimals: int) -> np.ndarray:
        """Rounded scores, -inf where a cell is skipped."""
        out = np.full((len(unit), len(self.names)), -np.inf)
        reached = self.reached(unit, widest)
        for cell in np.flatnonzero(reached.any(axis=0)):
            low, high = self.edges[cell], self.edges[cell + 1]
            rows = np.flatnonzero(reached[:, cell])
            out[rows, low:high] = round_half_up(_scores(unit[rows], self.matrix[low:high]), decimals)
        return out


def exact_knn(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    decimals: int = 6,
    min_score: float | None = None,
    exclude_self: bool = False,
) -> DataFrame:
    """(query_id, document_id, rank, score): the k nearest by (1 + cosine) / 2, exactly.

    `queries` is (query_id, embedding) and `vectors` (document_id, embedding). Each task multiplies
    blocks of its vectors with the query matrix and keeps its k best per query; only those
    are shuffled. Products are in single precision, what can be among the best is scored again in double (`functions/pairs.py`).
    The query matrix is broadcast while it is within QUERY_VALUES; otherwise
    `_grid_knn` pairs bounded stripes of both sides, with the same result.
    """
    queries = queries.select(F.col("query_id").cast("string"), "embedding")
    vectors = vectors.select(F.col("document_id").cast("string"), "embedding")
    first = queries.select(F.size("embedding").alias("dims")).head()
    dims = max(1, first["dims"]) if first else 1
    limit = max(1, QUERY_VALUES // dims)
    rows = queries.limit(limit + 1).collect()  # bounded by QUERY_VALUES
    spark = vectors.sparkSession
    if not rows:
        return top_k(spark.createDataFrame([], SCHEMA), ["query_id"], score_order(), k)
    if len(rows) > limit:
        found = _grid_knn(queries, vectors, k, dims, decimals, min_score, exclude_self)
        return top_k(found, ["query_id"], score_order(), k)
    if min_score is not None:
        held = spark.sparkContext.broadcast(QueryCells([r["query_id"] for r in rows], _matrix(r["embedding"] for r in rows)))
        widest = _widest(min_score, decimals)

        def within(batches):
            cells = held.value
            best = LocalTopK(list(cells.names), k, decimals)
            for batch in batches:
                for part in _blocks(batch, len(cells.names)):
                    ids = part["document_id"].to_numpy()
                    scores = cells.scores(_matrix(part["embedding"]), widest, decimals)
                    best.add(ids, _hide(scores, ids, cells.index, min_score, exclude_self))
            yield best.frame()

        return top_k(vectors.mapInPandas(within, SCHEMA), ["query_id"], score_order(), k)
    shared = spark.sparkContext.broadcast(
        (np.asarray([r["query_id"] for r in rows], dtype=object), _matrix(r["embedding"] for r in rows))
    )

    def nearest(batches):
        query_ids, matrix = shared.value
        best = LocalTopK(query_ids, k, decimals)
        for batch in batches:
            if len(batch):
                ids, unit = _in_order(batch["document_id"], batch["embedding"])
                own = same_ids(query_ids, ids) if exclude_self else None
                best.add_pairs(ids, *best_pairs(matrix, unit, k, decimals, best.floor, own))
        yield best.frame()

    return top_k(vectors.mapInPandas(nearest, SCHEMA), ["query_id"], score_order(), k)


def _in_order(ids: pd.Series, embedding: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Ids in natural order and their unit vectors."""
    ids = ids.to_numpy()
    order = natural_rows(ids).index.to_numpy()
    return ids[order], _matrix(embedding)[order]


def _stripes(queries: DataFrame, vectors: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt out to the cells (r, c) of a grid in which every query meets every vector once.

    Stripe numbers follow from the row counts, so a cell holds a bounded number of values
    whatever the sizes; ids are hashed, so no stripe can be hot. There are cells for every core while stripes of queries
    are not too small for that.
    """
    asked, stored = queries.count(), vectors.count()
    per_stripe = max(1, STRIPE_VALUES // dims)
    cols = -(-stored // per_stripe) or 1
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    rows = max(-(-asked // max(1, per_stripe // 6)), min(-(-cores // cols), -(-asked // STRIPE_LEAST))) or 1
    # Fresh names keep the two sides apart when both come from one table.
    left = queries.select(
        F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"),
        *[F.col(c).alias({"query_id": "qid", "embedding": "qv", "kind": "qk"}[c]) for c in queries.columns],
    )
    right = vectors.select(
        F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"), F.pmod(F.xxhash64("document_id"), F.lit(cols)).cast("int").alias("c"),
        *[F.col(c).alias({"document_id": "did", "embedding": "dv", "kind": "dk"}[c]) for c in vectors.columns],
    )
    return left, right


def _grid_knn(queries, vectors, k, dims, decimals, min_score, exclude_self) -> DataFrame:
    """The k best of each query per stripe of vectors."""
    left, right = _stripes(queries, vectors, dims)

    def cell(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        query_ids, found = q["qid"].to_numpy(), (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        ids = np.zeros(0, dtype=object)
        if len(q) and len(v):
            ids, unit = _in_order(v["did"], v["dv"])
            floor = np.full(len(q), -np.inf if min_score is None else min_score)
            found = best_pairs(_matrix(q["qv"]), unit, k, decimals, floor, same_ids(query_ids, ids) if exclude_self else None)
        return pd.DataFrame({
            "query_id": pd.Series(query_ids[found[0]], dtype=object), "document_id": pd.Series(ids[found[1]], dtype=object), "score": found[2].astype(float),
        })

    return (
        left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(cell, SCHEMA)
    )


def pair_counts(
    queries: DataFrame, vectors: DataFrame, thresholds: Sequence[float], marks: Mapping[str, np.ndarray],
    decimals: int = 6, exclude_self: bool = True, repeated: Mapping[str, np.ndarray] | None = None,
) -> DataFrame:
    """(query_id, min_score, one count per mark) of the pairs at or above each threshold; no pair leaves its task.

    `queries` is (query_id, embedding, kind) and `vectors` (document_id, embedding, kind). `marks` are tables of truth
    values by kind of query and kind of vector: the pairs that a column counts. Queries without a pair have zeros.
    `repeated` are more such tables: their columns count the vector ids that a query id meets more than once. All rows
    of two ids meet in one cell of the grid, so no pair is exchanged for that either.
    """
    queries = queries.select(F.col("query_id").cast("string"), "embedding", F.col("kind").cast("int"))
    vectors = vectors.select(F.col("document_id").cast("string"), "embedding", F.col("kind").cast("int"))
    first = queries.select(F.size("embedding").alias("dims")).head()
    left, right = _stripes(queries, vectors, max(1, first["dims"]) if first else 1)
    repeated = repeated or {}
    names, tables = [*marks, *repeated], [np.asarray(m, dtype=bool) for m in marks.values()]
    again = [np.asarray(m, dtype=bool) for m in repeated.values()]
    schema = ", ".join(["query_id string", "min_score double", *[f"`{n}` bigint" for n in names]])

    def count(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros((len(q), len(thresholds), len(names)), dtype=np.int64)
        if len(q) and len(v):
            own = same_ids(q["qid"].to_numpy(), v["did"].to_numpy()) if exclude_self else None
            sides = _matrix(q["qv"]), q["qk"].to_numpy(), _matrix(v["dv"]), v["dk"].to_numpy()
            found[:, :, : len(tables)] = counted_pairs(*sides, list(thresholds), tables, decimals, own)
            if again:
                found[:, :, len(tables) :] = repeated_pairs(*sides, q["qid"].to_numpy(), v["did"].to_numpy(), list(thresholds), again, decimals, exclude_self)
        ids = pd.Series(np.repeat(q["qid"].to_numpy(), len(thresholds)), dtype=object)
        levels = np.tile(np.asarray(thresholds, dtype=float), len(q))
        return pd.DataFrame({"query_id": ids, "min_score": levels} | {n: found[:, :, i].ravel() for i, n in enumerate(names)})

    counted = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(count, schema)
    return counted.groupBy("query_id", "min_score").agg(*[F.sum(n).alias(n) for n in names])


def threshold_pairs(
    queries: DataFrame, vectors: DataFrame, min_score: float, decimals: int = 6, exclude_self: bool = True, carry: Sequence[str] = (),
    columns: Sequence[str] | None = None, kinds: np.ndarray | None = None,
) -> DataFrame:
    """(query_id, document_id, score) of every pair at or above `min_score`, however many there are.

    Columns named by `carry`, each of one side, come along with the pairs, so that no pair must be joined to get them. `columns`
    are those wanted; the score is only made if it is among them. With `kinds`, a table of truth values, both sides have a
    column `kind`, and the pairs of those kinds are wanted for which the table is true.

    Queries are grouped into cells around centres; a vector is compared with the cells that its angle to their
    centres does not rule out (`QueryCells`). While the queries are within QUERY_VALUES every task holds them and
    matches leave it block by block, without an exchange. A larger set meets the vectors block by block (`_threshold_grid`):
    both sides are stored once, whatever their size, and a task holds one block of each.
    """
    own = ["kind"] if kinds is not None else []
    queries = queries.select(F.col("query_id").cast("string"), "embedding", *own, *[c for c in carry if c in queries.columns])
    vectors = vectors.select(F.col("document_id").cast("string"), "embedding", *own, *[c for c in carry if c in vectors.columns and c not in queries.columns])
    first = queries.select(F.size("embedding").alias("dims")).head()
    limit = max(1, QUERY_VALUES // max(1, first["dims"] if first else 1))
    spark = vectors.sparkSession
    asked, stored = ([c for c in x.columns if c not in ("embedding", *own)] for x in (queries, vectors))
    fields = [*queries.select(*asked).schema, *vectors.select(*stored).schema, StructField("score", DoubleType())]
    columns = [f.name for f in fields] if columns is None else list(columns)
    if not first:
        return spark.createDataFrame([], StructType(fields)).select(*columns)
    held = queries.limit(limit + 1).toArrow() if kinds is None else None  # bounded by QUERY_VALUES
    if held is None or held.num_rows > limit:
        fields = [f for f in fields if f.name in columns]
        match = _Matcher(queries, vectors, [f.name for f in fields], min_score, decimals, exclude_self)
        return _threshold_grid(queries, vectors, kinds).mapInArrow(match.blocks, StructType(fields)).select(*columns)
    match = _Matcher(queries, vectors, [f.name for f in fields], min_score, decimals, exclude_self)
    shared = spark.sparkContext.broadcast(match.cells(held.to_batches()))

    def run(batches):
        for batch in batches:
            yield from match.pairs(*shared.value, batch)

    return vectors.mapInArrow(run, StructType(fields)).select(*columns)


def _value_type(rows: DataFrame) -> str:
    """How the values of a block are stored: in single precision if the vectors are."""
    return "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


class _Matcher:
    """Pairs of Arrow batches or of blocks of queries and of vectors, with the `columns` of either side and the score."""

    def __init__(self, queries: DataFrame, vectors: DataFrame, columns: Sequence[str], min_score: float, decimals: int, exclude_self: bool) -> None:
        self.asked, self.stored = ([c for c in columns if c in x.columns] for x in (queries, vectors))
        self.types, self.scored = (_value_type(queries), _value_type(vectors)), "score" in columns
        self.min_score, self.decimals, self.exclude_self = min_score, decimals, exclude_self
        self.widest = _widest(min_score, decimals)

    def cells(self, batches: Sequence[pa.RecordBatch]) -> tuple[QueryCells, list[pa.Array]]:
        """The queries by cell, and their columns in that order."""
        table = pa.Table.from_batches(batches)
        held = QueryCells(table["query_id"].to_pandas(), _matrix(table["embedding"].to_pandas()))
        return held, [table[c].combine_chunks().take(pa.array(held.rows)) for c in self.asked]

    def pairs(self, held: QueryCells, columns: list[pa.Array], batch: pa.RecordBatch):
        size = max(1, min(2048, BLOCK_SCORES // max(1, len(held.names))))
        for start in range(0, batch.num_rows if len(held.names) else 0, size):
            part = batch.slice(start, size)
            ids = part["document_id"].to_pandas().to_numpy()
            scores = held.scores(_matrix(part["embedding"].to_pandas()), self.widest, self.decimals)
            scores = _hide(scores, ids, held.index, self.min_score, self.exclude_self)
            row, column = np.nonzero(scores >= self.min_score)
            yield from self._rows(columns, [part[c] for c in self.stored], column, row, scores[row, column])

    def _rows(self, asked: list[pa.Array], stored: list[pa.Array], query: np.ndarray, row: np.ndarray, score: np.ndarray | None):
        for low in range(0, len(query), OUT_ROWS):
            q, r = pa.array(query[low : low + OUT_ROWS]), pa.array(row[low : low + OUT_ROWS])
            found = [x.take(q) for x in asked] + [x.take(r) for x in stored]
            scores = [pa.array(score[low : low + OUT_ROWS])] if self.scored else []
            yield pa.RecordBatch.from_arrays([*found, *scores], [*self.asked, *self.stored, *(["score"] if self.scored else [])])

    def blocks(self, batches):
        """Pairs of rows that hold a block of queries and one of vectors."""
        last = None
        for batch in batches:
            for at in range(batch.num_rows):
                if batch["q_block"][at].as_py() != last:
                    last, names = batch["q_block"][at].as_py(), batch["query_id"][at].values
                    queries, asked = _unit(batch["q_vectors"][at], len(names), self.types[0]), [batch[c][at].values for c in self.asked]
                    query_ids = names.to_pandas().to_numpy()
                ids = batch["document_id"][at].values
                docs, stored = _unit(batch["d_vectors"][at], len(ids), self.types[1]), [batch[c][at].values for c in self.stored]
                own = same_ids(query_ids, ids.to_pandas().to_numpy()) if self.exclude_self else None
                for query, row, score in pairs_within(queries, docs, self.min_score, self.decimals, own, self.scored):
                    yield from self._rows(asked, stored, query, row, score)


def _unit(values: pa.Scalar, rows: int, kept: str) -> np.ndarray:
    """Unit vectors of a block."""
    return _matrix(np.frombuffer(values.as_buffer(), kept).reshape(rows, -1))


def _packed(rows: DataFrame, side: str, most: int, ordered: str | None = None) -> DataFrame:
    """Blocks of at most `most` rows of one kind: number, kind, vectors, and an array of each other column.

    Rows of a block are in the natural order of the ids in the column `ordered`, if one is named.
    """
    columns, kinds, values = [c for c in rows.columns if c not in ("embedding", "kind")], "kind" in rows.columns, _value_type(rows)
    out = StructType([
        StructField(f"{side}_block", LongType()), StructField(f"{side}_kind", IntegerType()), StructField(f"{side}_vectors", BinaryType()),
        *[StructField(c, ArrayType(rows.schema[c].dataType)) for c in columns],
    ])

    def block(number: int, kind: int, part: pa.Table) -> pa.RecordBatch:
        if ordered:
            part = part.take(pa.array(natural_rows(part[ordered].to_pandas().to_numpy()).index.to_numpy()))
        vectors = np.stack(part["embedding"].to_pandas()).astype(values).tobytes()
        lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part[c].combine_chunks()) for c in columns]
        one = [pa.array([number], pa.int64()), pa.array([kind], pa.int32()), pa.array([vectors], pa.binary())]
        return pa.RecordBatch.from_arrays([*one, *lists], out.names)

    def pack(batches):
        pending, number = {}, TaskContext.get().partitionId() << 32
        for batch in batches:
            kind = np.asarray(batch["kind"]).astype(np.int64) if kinds else np.zeros(batch.num_rows, np.int64)
            for k in np.unique(kind):
                part = pa.Table.from_batches([batch]).filter(pa.array(kind == k))
                part = pa.concat_tables([pending[k], part]) if k in pending else part
                while part.num_rows >= most:
                    yield block(number, int(k), part.slice(0, most))
                    part, number = part.slice(most), number + 1
                pending[k] = part
        for k, part in pending.items():
            if part.num_rows:
                yield block(number, int(k), part)
                number += 1

    return cut_lineage(rows.mapInArrow(pack, out))


def _threshold_grid(queries: DataFrame, vectors: DataFrame, kinds: np.ndarray | None = None) -> DataFrame:
    """Every block of queries with every block of vectors, or those whose kinds are wanted.

    Rows are packed in as many tasks as the grid has rows or columns, a few for each core in all, and stored once a side;
    a square of the grid reads the blocks of its row and its column. Nothing is sorted or exchanged.
    """
    side = int(np.ceil((8 * vectors.sparkSession.sparkContext.defaultParallelism) ** 0.5))
    left, right = (_packed(x.coalesce(side), s, most) for x, s, most in ((queries, "q", PART_QUERIES), (vectors, "d", PART_VECTORS)))
    left, right = (x.repartition(side) if x.rdd.getNumPartitions() < side else x for x in (left, right))
    right = right.hint("shuffle_replicate_nl")
    if kinds is None:
        return left.crossJoin(right)
    wanted = np.asarray(kinds, dtype=bool)
    return left.join(right, F.element_at(F.lit(wanted.ravel().tolist()), F.col("q_kind") * wanted.shape[1] + F.col("d_kind") + 1))


def skipped_cells(queries: DataFrame, vectors: DataFrame, min_score: float, decimals: int = 6) -> DataFrame:
    """One row (compared, skipped): pairs of a vector and a cell of queries, for query sets within QUERY_VALUES."""
    rows = queries.select(F.col("query_id").cast("string"), "embedding").collect()
    held = vectors.sparkSession.sparkContext.broadcast(QueryCells([r["query_id"] for r in rows], _matrix(r["embedding"] for r in rows)))
    widest = _widest(min_score, decimals)

    def run(batches):
        for batch in batches:
            if len(batch):
                reached = held.value.reached(_matrix(batch["embedding"]), widest)
                yield pd.DataFrame({"compared": [int(reached.sum())], "skipped": [int(reached.size - reached.sum())]})

    counted = vectors.select("embedding").mapInPandas(run, "compared bigint, skipped bigint")
    return counted.agg(F.sum("compared").alias("compared"), F.sum("skipped").alias("skipped"))


def knn_run(
    queries: DataFrame, vectors: DataFrame, k: int, candidate_depth: int, tie_decimals: int,
    decimals: int = 6,
) -> DataFrame:
    """Over-fetch, order by the rounded score and natural id, keep k."""
    found = exact_knn(queries, vectors, candidate_depth, decimals)
    rounded = found.withColumn("score", F.round("score", tie_decimals)).drop("rank")
    return top_k(rounded, ["query_id"], score_order(), k)


def radial_search(
    seeds: DataFrame, vectors: DataFrame, min_score: float, limit: int, decimals: int = 6
) -> DataFrame:
    """All documents within the threshold of each seed, the seed left out, best `limit` kept.

    Filter `vectors` before the call: predicates then reach the scan instead of the Python stage.
    """
    return exact_knn(seeds, vectors, limit, decimals, min_score=min_score, exclude_self=True)


def self_retrieval(sample: DataFrame, vectors: DataFrame) -> DataFrame:
    """(expected, actual, hit): the nearest document of each sampled document's own vector."""
    nearest = exact_knn(sample, vectors, 1)
    return nearest.select(
        F.col("query_id").alias("expected"),
        F.col("document_id").alias("actual"),
        (F.col("query_id") == F.col("document_id")).alias("hit"),
    )


# -- approximate search --------------------------------------------------------------------------

def build_cells(vectors: DataFrame, cells: int, seed: int = 17, max_iter: int = 10):
    """Train the coarse cells and assign every vector to one."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = vectors.withColumn("__features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(
        k=cells, seed=seed, maxIter=max_iter, featuresCol="__features", predictionCol="cell",
        distanceMeasure="cosine",
    ).fit(features)
    assigned = model.transform(features).drop("__features")
    return [np.asarray(c, dtype=np.float64) for c in model.clusterCenters()], assigned


def encode_cells(assigned: DataFrame, centers: Sequence[np.ndarray], keep: Sequence[str] = ()) -> DataFrame:
    """(document_id, cell, code, scale): unit vectors as one byte per value of their distance to the cell's centre.

    A value differs from its code by half of `scale` at most, which bounds the error of every score. Zero vectors
    have no row. Columns named by `keep` stay.
    """
    shared = assigned.sparkSession.sparkContext.broadcast(np.stack(centers))

    @F.pandas_udf("code binary, scale double")
    def encode(embedding: pd.Series, cell: pd.Series) -> pd.DataFrame:
        if not len(embedding):
            return pd.DataFrame({"code": pd.Series(dtype=object), "scale": pd.Series(dtype=float)})
        rest = _matrix(embedding) - shared.value[cell.to_numpy()]
        scale = np.abs(rest).max(axis=1) / 127.0
        with np.errstate(invalid="ignore", divide="ignore"):
            code = np.rint(np.where(scale[:, None] > 0, rest / scale[:, None], 0.0))
        fine = np.isfinite(code).all(axis=1)
        return pd.DataFrame({"code": [c.astype(np.int8).tobytes() if ok else None for c, ok in zip(code, fine, strict=True)], "scale": scale})

    coded = assigned.select(F.col("document_id").cast("string"), "cell", *keep, encode(F.col("embedding").cast("array<double>"), "cell").alias("at"))
    return coded.select("document_id", "cell", *keep, "at.code", "at.scale").where(F.col("code").isNotNull())


def ann_knn(
    queries: DataFrame, assigned: DataFrame, centers: Sequence[np.ndarray], k: int, effort: int,
    decimals: int = 6, group_rows: int = 4_096, group_queries: int = 4_096,
) -> DataFrame:
    """The k nearest among the vectors of the `effort` nearest cells per query, exactly."""
    return ann_runs(queries, assigned, centers, k, [effort], decimals, group_rows, group_queries).drop("effort")


def ann_runs(
    queries: DataFrame, assigned: DataFrame, centers: Sequence[np.ndarray], k: int, efforts: Sequence[int],
    decimals: int = 6, group_rows: int = 4_096, group_queries: int = 4_096,
) -> DataFrame:
    """`ann_knn` of several efforts, named by a column `effort`: the cells that one of them probes hold those of a lower one.

    Vectors are packed in blocks of one cell, at most `group_rows` each, with their byte codes (`encode_cells`), and queries in
    blocks of at most `group_queries`; both are stored once. A task takes its blocks of queries past blocks of vectors, those of
    a cell being compared with the queries that probe it. A first scan sees the codes only, which bound each score from
    below and above; what can be among the k best so far of an effort is scored again from the full vectors. Only the k best of
    a query, effort and task leave it.
    """
    unit = np.stack(centers)
    directions = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    shared = queries.sparkSession.sparkContext.broadcast((unit, directions))  # one row per cell
    efforts = sorted(set(efforts))
    reach = np.minimum(efforts, len(centers))
    asked = queries.select(F.col("query_id").cast("string"), "embedding")
    coded = encode_cells(assigned, centers, ["embedding"]).withColumnRenamed("cell", "kind")
    types, many = (_value_type(asked), _value_type(coded)), len(efforts)
    out = StructType([StructField("effort", IntegerType()), StructField("query_id", StringType()), StructField("document_id", StringType()), StructField("score", DoubleType())])

    def result(names: np.ndarray, best: LocalTopK) -> pa.RecordBatch:
        found = best.frame()
        place = found["query_id"].to_numpy().astype(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(np.asarray(efforts)[place % many], pa.int32()), pa.array(names[place // many], pa.string()),
            pa.array(found["document_id"], pa.string()), pa.array(found["score"].to_numpy(), pa.float64()),
        ], out.names)

    def search(batches):
        last, names, best = None, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                if batch["q_block"][at].as_py() != last:
                    if best is not None:
                        yield result(names, best)
                    last, names = batch["q_block"][at].as_py(), batch["query_id"][at].values.to_pandas().to_numpy()
                    matrix = _unit(batch["q_vectors"][at], len(names), types[0])
                    order = np.argsort(-(matrix @ shared.value[1].T), axis=1)
                    band = np.empty_like(order)  # the least effort that probes a cell
                    np.put_along_axis(band, order, np.searchsorted(reach, np.arange(order.shape[1]), side="right")[None, :], axis=1)
                    sums, best = np.abs(matrix).sum(axis=1), LocalTopK(list(range(len(names) * many)), k, decimals)
                cell = batch["d_kind"][at].as_py()
                rows = np.flatnonzero(band[:, cell] < many)
                if not len(rows):
                    continue
                ids, level = batch["document_id"][at].values.to_pandas().to_numpy(), band[rows, cell]
                scale = np.asarray(batch["scale"][at].values)
                code = np.frombuffer(b"".join(batch["code"][at].values.to_pylist()), np.int8).reshape(len(ids), -1)
                rough = (shared.value[0][cell] + code * scale[:, None]).astype(np.float32)
                found = best_pairs(
                    matrix[rows], _unit(batch["d_vectors"][at], len(ids), types[1]), k, decimals, best.floor[rows * many + level], None,
                    rough, sums[rows] * scale.max() * 0.5,
                )
                for e in range(many):
                    mine = level[found[0]] <= e
                    best.add_pairs(ids, rows[found[0][mine]] * many + e, found[1][mine], found[2][mine])
        if best is not None:
            yield result(names, best)

    cores = queries.sparkSession.sparkContext.defaultParallelism
    packers = max(4, -(-assigned.count() // (group_rows * len(centers))))  # so few that blocks of a cell are full
    right = _packed(coded.coalesce(min(8 * cores, packers)), "d", group_rows, ordered="document_id")
    parts = max(1, -(-right.count() * group_rows // STORED_ROWS))
    right = right.coalesce(parts)
    stripes = -(-4 * cores // parts)
    left = _packed(asked.repartition(stripes), "q", group_queries)
    met = left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(search, out)
    found = top_k(met, ["effort", "query_id"], score_order(), k)
    return found.select("effort", "query_id", "document_id", "rank", "score")


# -- comparisons ---------------------------------------------------------------------------------

def embedding_parity(
    reference: DataFrame, candidate: DataFrame, key: str,
    minimum_cosine: float = 0.99, minimum_mean_cosine: float = 0.999, maximum_delta: float = 0.05,
) -> DataFrame:
    """One row: worst component difference, lowest and mean cosine, and whether each is in bounds."""
    pairs = reference.select(key, F.col("embedding").alias("a")).join(
        candidate.select(key, F.col("embedding").alias("b")), key
    )
    delta = F.array_max(
        F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    )
    cosine = dot(F.col("a"), F.col("b")) / (norm(F.col("a")) * norm(F.col("b")))
    summary = pairs.select(delta.alias("d"), cosine.alias("c")).agg(
        F.count(F.lit(1)).alias("vectors"),
        F.max("d").alias("maximum_absolute_delta"),
        F.min("c").alias("minimum_cosine"),
        F.avg("c").alias("mean_cosine"),
    )
    return summary.withColumn(
        "passes",
        (F.col("minimum_cosine") >= minimum_cosine)
        & (F.col("mean_cosine") >= minimum_mean_cosine)
        & (F.col("maximum_absolute_delta") <= maximum_delta),
    )


def candidate_scores(candidates: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vector score of given (query_id, document_id) pairs only; one join per side, no all-pairs.

    Embed with `wanted_documents` first, so that only candidates get a vector.
    """
    from rankmill.functions.vectors import cosine_score

    return (
        candidates.select("query_id", "document_id")
        .join(vectors.select("document_id", F.col("embedding").alias("__d")), "document_id")
        .join(queries.select("query_id", F.col("embedding").alias("__q")), "query_id")
        .select("query_id", "document_id", cosine_score(F.col("__q"), F.col("__d")).alias("score"))
    )


def wanted_documents(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """The documents that are a candidate of some query. Their ids reach the scan by broadcast while few."""
    return documents.join(broadcast_if_small(candidates.select("document_id").distinct()), "document_id", "left_semi")


# -- user-supplied models ------------------------------------------------------------------------

def encode(
    texts: DataFrame, model, key: str = "cache_key", text: str = "text", batch_size: int = 64
) -> DataFrame:
    """(key, embedding) for distinct inputs; `model` maps a list of texts to a list of vectors."""
    distinct = texts.select(key, text).dropDuplicates([key])

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                yield pd.DataFrame(
                    {key: part[key], "embedding": list(model(list(part[text])))}
                )

    return distinct.mapInPandas(run, f"{key} string, embedding array<float>")


def missing_vectors(products: DataFrame, vectors: DataFrame, key: str = "document_id") -> DataFrame:
    """Ids present on one side only."""
    both = products.select(key, F.lit(True).alias("__p")).join(
        vectors.select(key, F.lit(True).alias("__v")), key, "full_outer"
    )
    side: Column = F.when(F.col("__p").isNull(), "no_product").when(F.col("__v").isNull(), "no_vector")
    return both.select(key, side.alias("fault")).where(F.col("fault").isNotNull())


def join_vectors(products: DataFrame, models: dict[str, DataFrame], key: str = "document_id") -> DataFrame:
    """Attach one vector column per model; an id mismatch with any model is an error."""
    joined = products
    for name, vectors in models.items():
        fault = missing_vectors(products, vectors, key).head(1)
        if fault:
            raise ValueError(f"{name}: {fault[0]['fault']} for {fault[0][key]}")
        joined = joined.join(
            vectors.select(key, F.col("embedding").alias(f"embedding_{name}")), key
        )
    return joined
