"""Near-duplicates by shingle similarity: one document of each group stays.

SimHashes of the five-word shingles go first: texts that agree in the bits of one of ``TABLES`` tables and differ in at most
``RADIUS`` bits are candidates, which are verified exactly and make classes. At a similarity of 0.8 the SimHashes of two
texts differ in about 10 bits, and in more where blocks were appended, cut or replaced, so no radius that tables can hold
meets all such pairs. The rest is found by a prefix filter, which is exact: in any fixed order of all shingles, two sets
at the similarity share one among the first of each (``marks``). Pairs of different classes that meet there are thinned out by
bounds that no such pair breaks: sizes, places, and the parities of the shingles, first in few bits and then in as many as the
size needs (``sketch``). What is left is verified pair by pair. Only verified links join classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.common import connected_components, hash_share
from rankmill.llm.decontaminate import shingle_hashes, word_codes, words_of
from rankmill.llm.simhash import BITS, majority
from rankmill.session import broadcast_if_small, cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
#: SimHash tables, the fewest bits that each compares, and the distance up to which texts that meet are verified.
TABLES, TABLE_BITS, RADIUS = 24, 16, 12
#: Members of a bucket that one task compares at once; larger buckets are split into block pairs.
BLOCK = 2048
#: Texts that one task verifies against another one.
VERIFIED = 400
#: Texts sampled for common shingles, and the share of them from which a shingle is common.
SAMPLE, COMMON = 4000, 0.005
#: Words of the bit map of shingle parities that goes into the buckets.
PARITY = 8


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles, A-Z in lower case; shorter texts are one shingle."""
    words = words_of(text)
    return shingle_hashes(word_codes(words), max(1, min(width, len(words))))


def marks(found: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of the prefix filter.

    Shingles that are ``common`` come last and the others by hash, so passages that many texts share make
    few meetings. Sets at the similarity share at least that part of each of them, so the rest and one more
    of each hold a shared one. A set without shingles has the mark 0.
    """
    if not len(found):
        return np.zeros(1, dtype=np.uint64)
    late = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found if len(common) else np.zeros(len(found), dtype=bool)
    needed = max(1, math.ceil(similarity * len(found) - 1e-6))
    return np.r_[found[~late], found[late]][: len(found) - needed + 1]


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the shingles by their last bits, in a power of two of at least two bits a shingle."""
    bits = max(64 * PARITY, 1 << max(0, 2 * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(parities: np.ndarray, words: int) -> np.ndarray:
    """A sketch in fewer words."""
    return np.bitwise_xor.reduce(parities.reshape(-1, words), axis=0)


def _spanning(near: np.ndarray) -> np.ndarray:
    """The smallest index that each member reaches in a symmetric link matrix with a true diagonal."""
    label, last = np.arange(len(near)), None
    while last is None or (label != last).any():
        last = label
        label = np.where(near, label[None, :], len(near)).min(axis=1)
        label = label[label]
    return label


def _may_reach(similarity: float):
    """Whether sets of different classes that share a shingle as their first one can reach the similarity.

    By (class, size, shingles from the shared one on, parities); shingles in one set only change one parity each.
    """

    def close(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        n, m = (x[..., 1].astype(np.float64) for x in (first, second))
        shared = similarity / (1 + similarity) * (n + m) - 1e-6
        ok = (first[..., 0] != second[..., 0]) & (np.minimum(first[..., 2], second[..., 2]) >= shared)
        apart = sum(np.bitwise_count(first[..., k] ^ second[..., k]).astype(np.int16) for k in range(3, 3 + PARITY))
        return ok & (apart <= n + m - 2 * shared)

    return close


def _near_prints(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.bitwise_count(first[..., 0] ^ second[..., 0]) <= RADIUS


def _matrix(part: pd.DataFrame) -> np.ndarray:
    return part.drop(columns=[c for c in ("bucket", "node", "i", "j", "mine") if c in part]).to_numpy(dtype=np.int64).view(np.uint64)


def _bucket_rows(close, spanning: bool = False):
    """Close pairs, or links that connect them, of the buckets in batches sorted by bucket; a bucket's rows are held until it ends."""

    def compare(held: pd.DataFrame) -> pd.DataFrame:
        bucket, node, prints = held["bucket"].to_numpy(), held["node"].to_numpy(), _matrix(held)
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        size = np.diff(np.r_[start, len(bucket)])
        left, right = [], []
        small = size <= 16
        last = np.repeat(start + size, size)
        index = np.arange(len(bucket))
        in_small = np.repeat(small, size)
        for step in range(1, int(size[small].max(initial=1))):
            a = index[in_small & (index + step < last)]
            b = a + step
            ok = close(prints[a], prints[b])
            left.append(a[ok])
            right.append(b[ok])
        for s, n in zip(start[~small], size[~small]):
            near = close(prints[s : s + n, None], prints[None, s : s + n])
            if spanning:
                np.fill_diagonal(near, True)
                label = _spanning(near)
                first = np.flatnonzero(label != np.arange(n))
                second = label[first]
            else:
                first, second = np.nonzero(np.triu(near, 1))
            left.append(s + first)
            right.append(s + second)
        a, b = (np.concatenate(x) if x else np.zeros(0, dtype=int) for x in (left, right))
        return pd.DataFrame({"a": node[a], "b": node[b]}).drop_duplicates()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            ends = np.flatnonzero(held["bucket"].to_numpy()[1:] != held["bucket"].to_numpy()[:-1])
            if len(ends) and len(held) >= 20_000:
                yield compare(held.iloc[: ends[-1] + 1])
                held = held.iloc[ends[-1] + 1 :].reset_index(drop=True)
        if held is not None and len(held):
            yield compare(held)

    return rows


def _block_rows(close):
    def rows(part: pd.DataFrame) -> pd.DataFrame:
        prints = _matrix(part)
        near = np.triu(close(prints[:, None], prints[None, :]), 1)
        if part["i"].iloc[0] != part["j"].iloc[0]:  # a block meets itself elsewhere
            mine = part["mine"].to_numpy()
            near &= mine[:, None] != mine[None, :]
        a, b = np.nonzero(near)
        node = part["node"].to_numpy()
        return pd.DataFrame({"a": node[a], "b": node[b]})

    return rows


def _pairs(links: DataFrame) -> DataFrame:
    return cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())


def simhash_links(nodes: DataFrame, crowd: int | None = None) -> DataFrame:
    """Candidate pairs (a, b) of ``nodes`` (node, fp) by SimHash tables.

    A table compares as many sampled bits as the number of texts asks for. In a bucket, members that are within ``RADIUS`` are
    linked by a spanning set. Crowded buckets are dealt into parts: no pair is lost by that, as the prefix filter finds the rest.
    """
    crowd = crowd or BLOCK
    width = min(32, max(TABLE_BITS, math.ceil(math.log2(max(2, nodes.count())))))
    rng = np.random.default_rng(11)
    masks = [sum(1 << int(i) for i in rng.choice(BITS, width, replace=False)) for _ in range(TABLES)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)])
    keyed = nodes.select("node", "fp", F.explode(keys).alias("bucket"))
    sizes = cut_lineage(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / crowd)
    dealt = keyed.join(sizes, "bucket").select(
        F.when(parts > 1, F.xxhash64("bucket", F.pmod(F.xxhash64("node"), parts))).otherwise(F.col("bucket")).alias("bucket"), "node", "fp"
    )
    met = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_bucket_rows(_near_prints, spanning=True), "a long, b long")
    return _pairs(met)


def prefix_links(nodes: DataFrame, similarity: float = SIMILARITY, crowd: int | None = None, block: int | None = None) -> DataFrame:
    """All pairs (a, b) of ``nodes`` (node, class, size, marks, parity) of different classes that may be at the similarity or above.

    Only shingles that two texts or more have at their beginning go on; sizes and parities are joined to those. Buckets of over
    ``crowd`` members are compared in pairs of blocks.
    """
    crowd, block = crowd or BLOCK, block or BLOCK
    keyed = nodes.select("node", "size", F.posexplode("marks").alias("at", "bucket")).select("bucket", "node", (F.col("size") - F.col("at")).alias("rest"))
    sizes = cut_lineage(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    values = ["class", "size", "rest", *[f"p{k}" for k in range(PARITY)]]
    facts = nodes.select("node", "class", "size", *[F.col("parity")[k].alias(f"p{k}") for k in range(PARITY)])
    rows = cut_lineage(keyed.join(sizes, "bucket")).join(facts, "node").select("bucket", "node", "n", *values)
    close = _may_reach(similarity)
    plain = rows.where(F.col("n") <= crowd).drop("n").repartition("bucket").sortWithinPartitions("bucket")
    links = plain.mapInPandas(_bucket_rows(close), "a long, b long")
    blocks = F.ceil(F.col("n") / block).cast("int")
    crowded = rows.where(F.col("n") > crowd).withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = crowded.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", *values
    )
    return _pairs(links.union(paired.groupBy("bucket", "i", "j").applyInPandas(_block_rows(close), "a long, b long")))


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of the shingles that many of a bounded sample of ``texts`` (node, body) have."""
    share = SAMPLE / max(1, texts.count())
    sample = texts.where(hash_share(F.col("node")) < share) if share < 1 else texts

    @F.pandas_udf("array<long>")
    def sets(bodies: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingles(x, width)).view(np.int64) for x in bodies], dtype=object)

    counts = sample.select(F.explode(sets("body")).alias("shingle")).groupBy("shingle").count().where(F.col("count") > max(10, COMMON * SAMPLE))
    return np.sort(counts.toPandas()["shingle"].to_numpy(dtype=np.int64).view(np.uint64))


def similar_documents(documents: DataFrame, text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """(node, root): the class of every text that may be similar to another one.

    ``node`` is xxhash64 of the text (null texts as empty ones). Texts are linked when the Jaccard
    similarity of their sets of ``width``-word shingles is at least ``similarity``, every such pair
    being found; ``root`` is the same for all that links connect. Texts without words are similar to each
    other only. Equal texts are one node. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    texts = documents.select(F.xxhash64(body).alias("node"), body.alias("body"))

    common = documents.sparkSession.sparkContext.broadcast(common_shingles(texts, width))

    @F.pandas_udf("struct<size:int,fp:long,marks:array<long>,parity:array<long>,sketch:binary>")
    def first_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(shingles(x, width)) for x in batch]
            bits = [sketch(x) for x in sets]
            yield pd.DataFrame({
                "size": np.array([len(x) for x in sets], dtype=np.int32),
                "fp": np.array([majority(x) if len(x) else 0 for x in sets], dtype=np.uint64).view(np.int64),
                "marks": pd.Series([marks(x, similarity, common.value).view(np.int64) for x in sets], dtype=object),
                "parity": pd.Series([folded(x, PARITY).view(np.int64) for x in bits], dtype=object),
                "sketch": [x.tobytes() for x in bits],
            })

    columns = ["size", "fp", "marks", "parity", "sketch"]
    found = texts.select("node", first_of("body").alias("p")).select("node", "p.*")
    found = cut_lineage(found.groupBy("node").agg(*[F.first(c).alias(c) for c in columns]))

    def checked(pairs: DataFrame) -> DataFrame:
        return cut_lineage(_verified(_sketched(pairs, found, similarity), texts, similarity, width))

    near = connected_components(checked(simhash_links(found.select("node", "fp"))), "a", "b")
    classed = found.join(near, "node", "left").withColumn("class", F.coalesce("root", "node"))
    rest = checked(prefix_links(classed, similarity))
    if rest.isEmpty():
        return near
    of = lambda side: near.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    between = rest.join(of("a"), "a", "left").join(of("b"), "b", "left")
    upper = connected_components(between.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")), "a", "b")
    upper = upper.select(F.col("node").alias("root"), F.col("root").alias("upper"))
    joined = near.join(upper, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
    alone = upper.join(near.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("upper").alias("root"))
    return cut_lineage(joined.union(alone))


def _sketched(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` whose sketches do not rule the similarity out."""

    @F.pandas_udf("boolean")
    def may_reach(n: pd.Series, m: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
        out = np.zeros(len(n), dtype=bool)
        for at, (x, y) in enumerate(zip(first, second, strict=True)):
            x, y = (np.frombuffer(v, dtype="<u8") for v in (x, y))
            words = min(len(x), len(y))
            out[at] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum() <= (n[at] + m[at]) * (1 - similarity) / (1 + similarity) + 1e-5
        return pd.Series(out)

    of = lambda side: found.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size"), F.col("sketch").alias(f"{side}_sketch"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return cut_lineage(both.where(may_reach("a_size", "b_size", "a_sketch", "b_sketch")).select("a", "b"))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """The ``pairs`` (a, b) at the similarity. A text meets its partners in parts of at most ``VERIFIED``."""
    sizes = pairs.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count("*") / VERIFIED).cast("int").alias("parts"))
    placed = pairs.select(F.col("a").alias("node"), F.col("b").alias("hub")).join(sizes, "hub")
    placed = placed.select("node", "hub", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_hub"))
    hubs = sizes.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_hub"))
    wanted = broadcast_if_small(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())  # else all texts are exchanged
    members = texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("body").alias("body"))

    def check(part: pd.DataFrame) -> pd.DataFrame:
        top, rest = part[part["is_hub"]], part[~part["is_hub"]]
        first = np.unique(shingles(top["body"].iloc[0], width))
        fine = np.zeros(len(rest), dtype=bool)
        for at, body in enumerate(rest["body"]):
            other = np.unique(shingles(body, width))
            both = len(np.intersect1d(first, other, assume_unique=True))
            fine[at] = both >= similarity * (len(first) + len(other) - both) - 1e-9
        return pd.DataFrame({"a": rest["node"][fine].to_numpy(), "b": top["node"].iloc[0]})

    return placed.union(hubs).join(members, "node").groupBy("hub", "part").applyInPandas(check, "a long, b long")


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """The rows of ``documents``, all columns, with one row of each class of similar texts.

    The row with the smallest id stays (nulls last), then the one of the smallest text hash; of rows equal
    in id and text one stays. Null texts count as empty, and texts without words are similar to each other only, so
    one of them stays. An empty table gives no rows. Columns may have any names but ``__node``, ``__best``,
    ``__root`` and ``__copies``.
    """
    roots = similar_documents(documents, text, similarity, width).withColumnsRenamed({"node": "__node", "root": "__root"})
    rows = documents.withColumn("__node", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    place = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("__node").alias("node"))
    per_text = rows.groupBy("__node").agg(F.min(place).alias("__best"), F.count("*").alias("__copies"))
    per_text = per_text.join(roots, "__node", "left").withColumn("__root", F.coalesce("__root", "__node"))
    chosen = cut_lineage(per_text.groupBy("__root").agg(F.min("__best").alias("__best")).join(per_text.select("__best", "__copies"), "__best").select(
        F.col("__best.node").alias("__node"), F.col("__best.id").alias("__best"), "__copies"
    ))
    joined = rows.join(chosen, (rows["__node"] == chosen["__node"]) & rows[doc_id].eqNullSafe(chosen["__best"])).drop(chosen["__node"]).drop("__best")
    single = joined.where("__copies = 1").select(*documents.columns)
    return single.union(joined.where("__copies > 1").dropDuplicates(["__node"]).select(*documents.columns))
