"""Exact k-means over integer vectors, with centroids filtered by N-simplex projection.

Distances from each vector to a few pivots are computed once and kept as apex coordinates: the pivots span a
simplex, and a point's distances to them fix where it stands above that base, up to the side. For two apexes
the straight distance is a lower bound of the true distance and the distance to the mirrored apex an upper
one. A centroid whose lower bound is above the least upper bound of a vector cannot be its nearest; only the
others are compared, in exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.session import cut_lineage, scratch_path

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
#: Largest size of an integer component; up to it the squared distance of 64 components fits a long.
LARGEST = 1 << 27
#: Vectors from which pivots are chosen (those of the smallest hashes), and most pivots. They decide how much
#: is filtered, never the result.
PIVOT_SAMPLE = 64
PIVOTS = 6
#: Least height of a pivot above the simplex of the others, as a share of the first edge; flatter ones are left out.
LEAST_HEIGHT = 0.2
#: Share of the squared distances by which bounds are widened, far above what rounding can move them.
SLACK = 1e-6


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v) of the rows with exactly ``dimensions`` finite components, v = floor(1024 x) as integers.

    Rows of a null vector, a null, NaN or infinite component or another length are left out, and so are those with a
    component of over 131,072 (``LARGEST`` / 1024) in size, whose squared distances do not fit a long.
    """
    x = F.transform(F.col(embedding), lambda v: F.floor(v.cast("double") * SCALE))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) <= LARGEST / SCALE)
    rows = vectors.where((F.size(embedding) == dimensions) & F.forall(embedding, fine))
    return rows.select(F.col(vec_id).alias("vec_id"), x.cast("array<int>").alias("v"))


def smallest_hashes(rows: DataFrame, n: int, seed: int = SEED) -> list[list[int]]:
    """The ``n`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; repeated ids by their components.

    Null ids have no hash and are not taken. ``n`` bounds what each task and the driver hold.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    top = rows.where("vec_id is not null").select(key.alias("key"), "v").orderBy("key", "v").limit(n)
    return [list(r.v) for r in top.collect()]


class Simplex:
    """Pivots and the lower triangular coordinates of their simplex."""

    def __init__(self, sample: list[list[int]], most: int = PIVOTS):
        points = np.array(sample, np.int64).reshape(len(sample), -1)
        self.pivots = points[:1]
        self.base = np.zeros((0, 0))
        if len(points) < 2:
            return
        # farthest vector first, then always the one that stands highest above the simplex so far
        edge = 0.0
        while len(self.pivots) < most:
            apexes = self.apexes(points)
            best = int(np.argmax(apexes[:, -1]))
            height = apexes[best, -1]
            edge = edge or height
            if height <= 0 or height < LEAST_HEIGHT * edge:
                return
            self.pivots = np.vstack([self.pivots, points[best]])
            k = len(self.base)
            grown = np.zeros((k + 1, k + 1))
            grown[:k, :k] = self.base
            grown[k] = apexes[best]
            self.base = grown

    def apexes(self, points: np.ndarray) -> np.ndarray:
        """Coordinates over the base and height of each point, from its distances to the pivots alone."""
        squared = np.stack([squared_distances(points, p) for p in self.pivots], 1).astype(np.float64)
        out = np.zeros((len(points), len(self.base) + 1))
        for i, corner in enumerate(self.base):
            known = out[:, :i] @ corner[:i]
            out[:, i] = ((squared[:, 0] - squared[:, i + 1] + corner @ corner) / 2 - known) / corner[i]
        out[:, -1] = np.sqrt(np.maximum(squared[:, 0] - (out[:, :-1] ** 2).sum(1), 0))
        return out


def squared_distances(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    gap = points.astype(np.int64) - other
    return (gap * gap).sum(-1)


def nearest(points: np.ndarray, apexes: np.ndarray, centres: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centre (ties: smaller number) and its squared distance, and how many distances that took."""
    flat = np.zeros((len(points), len(centres)))
    for i in range(apexes.shape[1] - 1):
        flat += (apexes[:, i, None] - tops[None, :, i]) ** 2
    high, low = apexes[:, -1, None] + tops[None, :, -1], apexes[:, -1, None] - tops[None, :, -1]
    slack = SLACK * ((apexes**2).sum(1)[:, None] + (tops**2).sum(1)[None, :]) + 1.0
    upper, lower = flat + high**2 + slack, flat + low**2 - slack
    left = lower <= upper.min(1)[:, None]
    distance = np.full(left.shape, np.iinfo(np.int64).max)
    for j in range(len(centres)):
        rows = np.flatnonzero(left[:, j])
        distance[rows, j] = squared_distances(points[rows], centres[j])
    best = distance.argmin(1)
    return best, distance[np.arange(len(points)), best], int(left.sum())


def _matrix(column: pd.Series, kind) -> np.ndarray:
    return np.array(column.to_list(), kind).reshape(len(column), -1)


def project(rows: DataFrame, simplex: Simplex) -> DataFrame:
    """The rows with their apex coordinates."""

    @F.pandas_udf("array<double>")
    def apex(v: pd.Series) -> pd.Series:
        return pd.Series(list(simplex.apexes(_matrix(v, np.int64))) if len(v) else [], dtype=object)

    return rows.withColumn("apex", apex("v"))


def _sums(projected: DataFrame, centres: np.ndarray, tops: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per centre that has vectors: their number and exact component sums. Each task adds up its own first."""
    width = centres.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, number = np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64)
        for batch in batches:
            if len(batch):
                points = _matrix(batch.v, np.int64)
                best, _, _ = nearest(points, _matrix(batch.apex, np.float64), centres, tops)
                np.add.at(total, best, points)
                number += np.bincount(best, minlength=len(centres))
        some = np.flatnonzero(number)
        yield pd.DataFrame({"cluster": some, "n": number[some], "total": pd.Series(list(total[some]), dtype=object)})

    parts = projected.select("v", "apex").mapInPandas(run, "cluster int, n long, total array<long>")
    exact = [F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()  # one row per centre
    return {r.cluster: (r.n, [int(r[f"s{j}"]) for j in range(width)]) for r in found}


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) per kept vector.

    What is kept: see ``integer_vectors``. The centres start as the vectors of the smallest hashes, fewer if fewer
    are kept; each round moves every centre that has vectors to floor(sum / count) per component and leaves the
    others. Repeated rows count each, null ids are assigned but never start a centre. Without any start (an
    empty table, null ids only) there are no rows. Inertias beyond a long are null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    path = scratch_path(spark, "simplex")
    rows = integer_vectors(vectors, vec_id, embedding, dimensions)
    sample = smallest_hashes(rows, max(PIVOT_SAMPLE, clusters), seed)
    if not sample:
        return _described(spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dimensions), np.int64))
    centres = np.array(sample[:clusters], np.int64)
    simplex = Simplex(sample)
    project(rows, simplex).write.parquet(path)  # read again in every round, with the cached distances
    projected = spark.read.parquet(path)
    for _ in range(rounds):
        sums = _sums(projected, centres, simplex.apexes(centres))
        moved = np.array([[s // sums[c][0] for s in sums[c][1]] if c in sums else old for c, old in enumerate(centres.tolist())], np.int64)
        if (moved == centres).all():
            break  # the remaining rounds would assign and move nothing else
        centres = moved
    tops = simplex.apexes(centres)

    @F.pandas_udf("cluster int, distance long")
    def assign(v: pd.Series, apex: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"cluster": [], "distance": []}, dtype="int64")
        best, distance, _ = nearest(_matrix(v, np.int64), _matrix(apex, np.float64), centres, tops)
        return pd.DataFrame({"cluster": best, "distance": distance})

    assigned = projected.select("vec_id", assign("v", "apex").alias("near")).select("vec_id", "near.cluster", "near.distance")
    return _described(cut_lineage(assigned), centres)


def _described(assigned: DataFrame, centres: np.ndarray) -> DataFrame:
    """Inertias and centroids next to the assigned rows; the broadcast side has one row per centre."""
    spark: SparkSession = assigned.sparkSession
    inertia = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    inertia = {r.cluster: int(r["sum"]) for r in inertia.collect()}
    fits = lambda x: x if x < 1 << 63 else None
    lines = [
        (c, fits(inertia.get(c, 0)), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest(), v)
        for c, v in enumerate(centres.tolist())
    ]
    known = spark.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def _round_sql(r: int) -> str:
    """Assignment by the centres of round ``r`` and the centres of the next round."""
    return f"""
a{r} AS MATERIALIZED (
  SELECT rid, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT rid, kept.v, k, list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c.v[i]) * (kept.v[i] - c.v[i])))::BIGINT AS d
    FROM kept, c{r} c) GROUP BY rid, v),
c{r + 1} AS MATERIALIZED (
  SELECT c{r}.k, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM (
      SELECT k, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY k, i)
    GROUP BY k) m ON m.k = c{r}.k)"""


#: Plain rounds over all centres, without bounds.
SQL = (
    """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM {embeddings}
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) <= 131072)) = 64),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), v))::INT - 1 AS k, v FROM kept WHERE vec_id IS NOT NULL QUALIFY k < 8),"""
    + ",".join(_round_sql(r) for r in range(ROUNDS + 1))
    + f"""
SELECT kept.vec_id, a.k AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (rid) JOIN c{ROUNDS} c ON c.k = a.k"""
)
