"""Embedding near-duplicates on a robust-pruned flat graph.

Distinct vectors are dealt to overlapping cluster shards (every vector joins the shards of the few centres
nearly as close as its nearest). Groups too tight to be dealt apart are compared exactly, in pairs of
blocks. Each shard builds a graph: candidate neighbours are pruned so that a
neighbour covers others that lie closer to it than to the node. The adjacency lists of all shards are
united. Every vector then searches its shards on the united graph: a greedy search from the medoid (and
the vector's own node) with a beam, whose result widens for as long as it meets vectors in range. Verified
links give components; links are counted exactly within a component, in blocks. An audit of a bounded
query sample against all rows measures recall, and a run below the target is repeated with wider beams and
shards around other centres, whose links are added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.common import connected_components
from rankmill.llm.simhash_similar import _spanning
from rankmill.session import cut_lineage

#: Vectors a shard should have and may have; larger shards are dealt again around centres of their own.
SHARD, SHARD_LIMIT = 800, 3000
#: Centres of one dealing round, and sampled vectors per centre: fixed bounds of what the driver holds.
CENTRES, SAMPLE = 2048, 12
#: A vector also joins the shards of centres whose cosine is at most this much below its best.
MARGIN = 0.06
#: Most centres that a vector joins in a round, most rounds that divide a shard, and the share of a shard from
#: which a part counts as undivided.
NEAREST, DEPTH, TIGHT = 3, 3, 0.6
DEGREE, CANDIDATES, RANDOM, ALPHA = 24, 48, 16, 1.2
BLOCK = 1500
#: Vectors of the recall audit, and the recall below which the search is widened.
AUDIT, TARGET = 100, 0.95


def robust_prune(near: np.ndarray, distance: np.ndarray, node: int, degree: int, alpha: float) -> list[int]:
    """Neighbours of ``node`` out of the candidates ``near`` (ascending distance)."""
    chosen: list[int] = []
    while len(near) and len(chosen) < degree:
        best = int(near[0])
        chosen.append(best)
        near = near[1:]
        near = near[alpha * distance[best, near] > distance[node, near]]
    return chosen


def build_graph(vectors: np.ndarray, seed: int = 1) -> list[np.ndarray]:
    """Adjacency lists of one shard: pruned nearest and random candidates, with reverse edges."""
    n = len(vectors)
    distance = np.sqrt(np.maximum(0, 2 - 2 * (vectors @ vectors.T))).astype(np.float32)
    np.fill_diagonal(distance, np.inf)
    near = np.argpartition(distance, min(CANDIDATES, n - 1), axis=1)[:, :CANDIDATES] if n > 1 else np.zeros((n, 0), dtype=int)
    rng = np.random.default_rng(seed)
    near = np.concatenate([near, rng.integers(0, n, (n, RANDOM))], axis=1)
    order = np.argsort(np.take_along_axis(distance, near, axis=1), axis=1)
    near = np.take_along_axis(near, order, axis=1)
    out: list[set[int]] = [set() for _ in range(n)]
    for i in range(n):
        mine = near[i]
        mine = mine[mine != i]
        first = np.r_[True, mine[1:] != mine[:-1]] if len(mine) else np.zeros(0, dtype=bool)
        out[i].update(robust_prune(mine[first], distance, i, DEGREE, ALPHA))
    for i in range(n):
        for j in list(out[i]):
            if len(out[j]) < 2 * DEGREE:
                out[j].add(i)
    return [np.fromiter(x, dtype=np.int64, count=len(x)) for x in out]


def range_search(vectors: np.ndarray, graph: list[np.ndarray], cosine: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, found) index pairs at ``cosine`` or more, every vector being a query.

    A beam search from the medoid and the query's own node, in step for a block of queries; then every
    found vector in range is expanded until no new one is met.
    """
    n, width = len(vectors), max((len(g) for g in graph), default=0)
    if n < 2 or not width:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    lists = np.full((n, width), -1)
    for i, g in enumerate(graph):
        lists[i, : len(g)] = g
    medoid = int((vectors @ vectors.mean(axis=0)).argmax())
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, n, 512):
        queries = np.arange(start, min(n, start + 512))
        row = np.arange(len(queries))
        seen = np.zeros((len(queries), n), dtype=bool)
        ids = np.full((len(queries), beam), -1)
        cos = np.full((len(queries), beam), -2.0)
        done = np.ones((len(queries), beam), dtype=bool)
        ids[:, 0], ids[:, 1] = medoid, queries
        cos[:, 0], cos[:, 1] = vectors[queries] @ vectors[medoid], 1.0
        done[:, :2] = False
        same = queries == medoid
        ids[same, 1], cos[same, 1], done[same, 1] = -1, -2.0, True
        seen[row, medoid] = seen[row, queries] = True
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def visit(q: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Neighbours of (query, node) pairs that the query meets for the first time, and cosines."""
            nxt = lists[nodes]
            who = np.repeat(q, width)
            nxt = nxt.ravel()
            ok = nxt >= 0
            who, nxt = who[ok], nxt[ok]
            ok = ~seen[who, nxt]
            code = np.unique(who[ok] * n + nxt[ok])
            who, nxt = code // n, code % n
            seen[who, nxt] = True
            value = np.einsum("ij,ij->i", vectors[queries[who]], vectors[nxt])
            hit = value >= cosine
            found.append((who[hit], nxt[hit]))
            return who, nxt, value

        hit = (cos[:, 0] >= cosine) & ~same
        found.append((row[hit], np.full(hit.sum(), medoid)))
        while not done.all():
            open_cos = np.where(done, -3.0, cos)
            pick = open_cos.argmax(axis=1)
            active = ~done[row, pick]
            q, at = row[active], pick[active]
            done[q, at] = True
            who, nxt, value = visit(q, ids[q, at])
            if not len(who):
                continue
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            extra = int(rank.max()) + 1
            more_ids, more_cos = np.full((len(row), extra), -1), np.full((len(row), extra), -2.0)
            more_ids[who, rank], more_cos[who, rank] = nxt, value
            all_ids, all_cos = np.concatenate([ids, more_ids], axis=1), np.concatenate([cos, more_cos], axis=1)
            all_done = np.concatenate([done, more_ids < 0], axis=1)
            top = np.argpartition(-all_cos, beam - 1, axis=1)[:, :beam]
            ids, cos, done = (np.take_along_axis(x, top, axis=1) for x in (all_ids, all_cos, all_done))
        q, nodes = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        while len(q):
            held = len(found)
            visit(q, nodes)
            q, nodes = (np.concatenate([f[k] for f in found[held:]]) for k in (0, 1))
        pairs.append((queries[np.concatenate([f[0] for f in found])], np.concatenate([f[1] for f in found])))
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means of a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(4):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def deal(vectors: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two tables (shard, cid, unit): shards of bounded size, and those that dealing does not divide.

    ``vectors`` has (label, cid, unit). In each round the oversized shards get centres from a sample; the
    driver holds at most CENTRES centres and SAMPLE vectors for each. Shards that the bound leaves large
    are split in the next round. A shard is undivided if one of its parts holds nearly all of it, or if it
    is oversized after DEPTH divisions; a vector has at most NEAREST ** DEPTH rows.
    """
    spark = vectors.sparkSession
    ready, tight, open_ = [], [], vectors.select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("shard"), "cid", "unit").withColumn("depth", F.lit(0))
    columns = ["shard", "cid", "unit"]
    for level in range(12):
        sizes = cut_lineage(open_.groupBy("shard", "depth").agg(F.count("*").alias("n")))
        small = sizes.where(F.col("n") <= SHARD_LIMIT).select("shard")
        stuck = sizes.where((F.col("n") > SHARD_LIMIT) & (F.col("depth") >= DEPTH)).select("shard")
        large = sizes.where((F.col("n") > SHARD_LIMIT) & (F.col("depth") < DEPTH))
        ready.append(open_.join(small, "shard", "left_semi").select(*columns))
        tight.append(open_.join(stuck, "shard", "left_semi").select(*columns))
        top = large.orderBy(F.desc("n"), "shard").limit(CENTRES // 2).collect()
        if not top:
            break
        total = sum(r["n"] for r in top)
        share = min(1.0, CENTRES / max(1, math.ceil(total / SHARD)))
        wanted = {r["shard"]: max(2, int(share * r["n"] / SHARD)) for r in top}
        keep = spark.createDataFrame([(s, SAMPLE * k / r["n"]) for (s, k), r in zip(wanted.items(), top)], "shard string, share double")
        odds = (F.xxhash64("cid", F.lit(level + 100 * seed)).cast("double") / F.lit(2.0**64)) + 0.5
        sample = open_.join(F.broadcast(keep), "shard").where(odds < F.col("share")).select("shard", "unit").toPandas()
        centres = {s: _centres(_matrix(part["unit"]), wanted[s], level + 100 * seed) for s, part in sample.groupby("shard")}
        held = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for shard, part in batch.groupby("shard"):
                    table = held.value.get(shard)
                    if table is None:
                        yield part.assign(parent=shard)[["parent", *part.columns]]
                        continue
                    cos = _matrix(part["unit"]) @ table.T
                    best = np.argsort(-cos, axis=1, kind="stable")[:, :NEAREST]
                    value = np.take_along_axis(cos, best, axis=1)
                    row, place = np.nonzero(value >= value[:, :1] - MARGIN)
                    out = part.iloc[row].reset_index(drop=True)
                    out["parent"], out["shard"], out["depth"] = shard, [f"{shard}.{c}" for c in best[row, place]], out["depth"] + 1
                    yield out

        # a vector reaches a shard of the next level once, whichever way it came
        before = open_.join(large.select("shard"), "shard", "left_semi")
        dealt = cut_lineage(before.select(*columns, "depth").mapInPandas(assign, "parent string, shard string, cid long, unit array<double>, depth int"))
        parts = dealt.where("parent <> shard").groupBy("parent", "shard").agg(F.count("*").alias("part")).groupBy("parent").agg(F.max("part").alias("part"))
        whole = large.join(parts, large["shard"] == parts["parent"]).where(F.col("part") > F.greatest(TIGHT * F.col("n"), F.lit(SHARD_LIMIT))).select("parent")
        whole = cut_lineage(whole)
        tight.append(before.join(whole.withColumnRenamed("parent", "shard"), "shard", "left_semi").select(*columns))
        open_ = dealt.join(whole, "parent", "left_anti").select(*columns, "depth")
    else:
        tight.append(open_.select(*columns))
    out = []
    for tables in (ready, tight):
        union = tables[0]
        for part in tables[1:]:
            union = union.union(part)
        out.append(union)
    return tuple(out)


def _block_rows(cosine: float):
    def rows(part: pd.DataFrame) -> pd.DataFrame:
        units, ids = _matrix(part["unit"]), part["cid"].to_numpy()
        near = units @ units.T >= cosine
        np.fill_diagonal(near, True)
        label = _spanning(near)
        moved = label != np.arange(len(ids))
        return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})

    return rows


def block_edges(shards: DataFrame, cosine: float) -> DataFrame:
    """Edges (a, b) that connect all linked vectors of a shard, compared exactly in pairs of hash blocks."""
    sizes = shards.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = shards.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("cid", F.lit(7)), "blocks").cast("int"))
    pairs = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid", "unit"
    )
    return pairs.groupBy("shard", "i", "j").applyInPandas(_block_rows(cosine), "a long, b long")


def _graph_rows(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("cid")
    ids = part["cid"].to_numpy()
    graph = build_graph(_matrix(part["unit"]))
    return pd.DataFrame({"cid": ids, "near": [ids[g] for g in graph]})


def _search_rows(cosine: float, beam: int):
    def rows(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cid")
        ids = part["cid"].to_numpy()
        graph = []
        for near in part["near"]:
            at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            graph.append(at[ids[at] == near])
        a, b = range_search(_matrix(part["unit"]), graph, cosine, beam)
        root = np.arange(len(ids))
        while len(a):
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        moved = root != np.arange(len(ids))
        return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})

    return rows


def _count_rows(cosine: float):
    def rows(part: pd.DataFrame) -> pd.DataFrame:
        first = part[part["side"] == 0]
        second = part[part["side"] == 1] if part["i"].iloc[0] != part["j"].iloc[0] else first
        near = _matrix(first["unit"]) @ _matrix(second["unit"]).T >= cosine
        if first is second:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"cid": first["cid"], "links": near @ first["copies"].to_numpy()})
        return pd.concat([
            pd.DataFrame({"cid": first["cid"], "links": near @ second["copies"].to_numpy()}),
            pd.DataFrame({"cid": second["cid"], "links": near.T @ first["copies"].to_numpy()}),
        ])

    return rows


def _links(classes: DataFrame, roots: DataFrame, cosine: float) -> DataFrame:
    """(cid, links): exact number of linked vectors of other classes, within the component, in blocks."""
    members = cut_lineage(roots.join(classes.select("cid", "unit", "copies"), roots["node"] == classes["cid"]).select("root", "cid", "unit", "copies"))
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("cid", F.lit(5)), "blocks").cast("int"))
    pairs = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"),
        "cid", "unit", "copies",
    )
    counted = pairs.groupBy("root", "i", "j").applyInPandas(_count_rows(cosine), "cid long, links long")
    return counted.groupBy("cid").agg(F.sum("links").alias("links"))


def _audit(classes: DataFrame, counted: DataFrame, cosine: float, queries: int) -> tuple[float, int]:
    """Recall of the links of a bounded query sample, against all rows; and the links that exist.

    Half of the sample are linked vectors, where there are any, as most vectors link with nothing.
    """
    by_hash = [F.xxhash64("cid", F.lit(3)), F.col("cid")]
    linked = counted.where("links > 0").orderBy(*by_hash).limit(queries // 2).select("cid")
    some = classes.orderBy(*by_hash).limit(queries // 2).select("cid").union(linked).distinct()
    sample = classes.join(F.broadcast(some), "cid").join(counted, "cid", "left").select("cid", "label", "unit", F.coalesce("links", F.lit(0)).alias("links")).toPandas()
    if sample.empty:
        return 1.0, 0
    held = classes.sparkSession.sparkContext.broadcast({k: (part["cid"].to_numpy(), _matrix(part["unit"])) for k, part in sample.groupby("label")})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, part in batch[batch["label"].isin(list(held.value))].groupby("label"):
                ids, units = held.value[label]
                near = (units @ _matrix(part["unit"]).T >= cosine) & (ids[:, None] != part["cid"].to_numpy()[None, :])
                yield pd.DataFrame({"cid": ids, "links": near @ part["copies"].to_numpy()})

    true = classes.select("cid", "label", "unit", "copies").mapInPandas(count, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("true")).toPandas()
    both = sample.merge(true, on="cid")
    total = int(both["true"].sum())
    return (float(both[["links", "true"]].min(axis=1).sum() / total) if total else 1.0), total


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93, beam: int = 32, audit: int = AUDIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) for every row.

    Rows link when their labels are equal and not null and their cosine, in double precision, is at
    least ``cosine``. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without a label, link with nothing and form components of their own. Equal vectors are one class
    whose copies link with each other; repeated rows count as copies. Vectors of different lengths never
    meet. ``component_id`` is the smallest id reachable; null ids are members but never name a component
    that has another id. An empty table gives no rows; other columns are ignored.
    """
    ids = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ids = ids.withColumn("scale", F.when(finite, F.array_max(F.transform("v", F.abs))))
    ids = ids.withColumn("good", F.coalesce(F.col("label").isNotNull() & (F.col("scale") > 0), F.lit(False)))
    scaled = ids.where("good").withColumn("v", F.transform("v", lambda x: x / F.col("scale"))).withColumn(
        "norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    )
    good = scaled.select(
        "vec_id", F.concat_ws("/", F.size("v").cast("string"), F.col("label").cast("string")).alias("label"), F.transform("v", lambda x: x / F.col("norm")).alias("unit")
    ).withColumn("cid", F.xxhash64("label", "unit"))
    classes = cut_lineage(good.groupBy("cid").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id")))
    links, seed = None, 0
    while True:
        shards, tight = deal(classes.select("label", "cid", "unit"), seed)
        shards = cut_lineage(shards)
        lists = shards.groupBy("shard").applyInPandas(_graph_rows, "cid long, near array<long>")
        united = cut_lineage(lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
        edges = shards.join(united, "cid").groupBy("shard").applyInPandas(_search_rows(cosine, beam), "a long, b long").union(block_edges(tight, cosine))
        roots = connected_components(edges if links is None else edges.union(links), "a", "b")
        counted = cut_lineage(_links(classes, roots, cosine))
        recall, _ = _audit(classes, counted, cosine, audit)
        if recall >= TARGET or beam >= 256:
            break
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        beam, seed = 2 * beam, seed + 1
    whole = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(counted, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    whole = cut_lineage(whole.select("cid", "root", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    names = whole.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = whole.join(names, "root").select("cid", "n_links", "component_id")
    linked = good.select("vec_id", "cid").join(found, "cid").select("vec_id", "n_links", "component_id")
    alone = ids.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(recall).alias("audit_recall"),
    )
