"""SimHash near-duplicates by covering locality-sensitive hashing.

``mask_table`` builds the structured masks: every bit position is given a vector of F_2^(r+1), and
table v keeps the bits whose vector has an odd product with v. Up to r differing positions span at most
r dimensions, so some non-zero v is orthogonal to all of them, that table masks all of them away, and
the pair meets there. Every pair within the radius therefore collides in at least one of 2^(r+1) - 1
tables, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.common import connected_components
from rankmill.session import cut_lineage

BITS = 64
#: Buckets up to this size are compared in place; fingerprints of larger ones take the midpoint path.
BUCKET = 1024
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned SimHash of the word shingles of ``text`` (A-Z lower-cased, repeats counted).

    Fewer words than ``width`` make one shingle; no word, or null, gives zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    raw = b" ".join(words)
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(raw, seed)]
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(raw[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _BYTE_PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = (counts.ravel() * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def mask_table(radius: int, bits: int = BITS, seed: int = 7) -> list[int]:
    """The 2^(radius+1) - 1 covering masks over ``bits`` positions (unsigned)."""
    size = 1 << (radius + 1)
    vectors = np.array([1 + i % (size - 1) for i in range(bits)])
    np.random.default_rng(seed).shuffle(vectors)
    return [sum(1 << i for i in range(bits) if bin(int(vectors[i]) & v).count("1") % 2) for v in range(1, size)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(documents: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """``documents`` without ``text``, plus the signed 64-bit ``__fp``; null and empty texts get zero."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(x, width) for x in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return documents.withColumn("__fp", simhash(F.col(text))).drop(text)


def _bucket_edges(radius: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends: list[tuple[np.ndarray, np.ndarray]] = []
            for members in batch["members"]:
                fps = np.asarray(members, dtype=np.int64).view(np.uint64)
                near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
                label, last = np.arange(len(fps)), None
                while last is None or (label != last).any():
                    last = label
                    label = np.where(near, label[None, :], len(fps)).min(axis=1)
                    label = label[label]
                moved = label != np.arange(len(fps))
                ends.append((fps[moved].view(np.int64), fps[label[moved]].view(np.int64)))
            if ends:
                yield pd.DataFrame({"a": np.concatenate([x for x, _ in ends]), "b": np.concatenate([y for _, y in ends])})

    return compare


def links(fps: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within ``radius`` of each other.

    ``fps`` has one row per distinct ``__fp``. The edges join exactly the components of the link graph,
    but only a spanning set of it: at most one edge per member and bucket, never all pairs. Buckets of
    two are compared in the JVM, those up to ``bucket`` in one numpy block. Larger ones are not gathered:
    two fingerprints within an even radius share a midpoint at half of it, so each member is linked to
    the smallest member at each point of its half-radius ball, a number of rows that is linear in the
    members.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    tables = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("__fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(mask_table(radius))])
    keyed = fps.select("__fp", F.explode(tables).alias("k")).select("k.t", "k.key", "__fp")
    buckets = cut_lineage(keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("__fp").alias("a"), F.max("__fp").alias("b")).where("n > 1"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = buckets.where("n = 2").where(close).select("a", "b")
    several = keyed.join(buckets.where(f"n > 2 and n <= {bucket}").select("t", "key"), ["t", "key"], "left_semi")
    blocks = several.groupBy("t", "key").agg(F.collect_list("__fp").alias("members")).select("members")
    near = blocks.mapInPandas(_bucket_edges(radius), "a long, b long")
    crowd = buckets.where(f"n > {bucket}").select("t", "key")
    ball = [0] + [sum(1 << i for i in c) for k in range(1, radius // 2 + 1) for c in combinations(range(BITS), k)]
    points = keyed.join(crowd, ["t", "key"], "left_semi").select("__fp").distinct().select(
        "__fp", F.explode(F.transform(F.lit([_signed(x) for x in ball]), lambda m: F.col("__fp").bitwiseXOR(m))).alias("point")
    )
    lowest = points.groupBy("point").agg(F.min("__fp").alias("b"), F.max("__fp").alias("top")).where("b <> top")
    midpoints = points.join(lowest.select("point", "b"), "point").where("__fp <> b").select(F.col("__fp").alias("a"), "b").distinct()
    return pairs.union(near).union(midpoints)


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4, bucket: int = BUCKET) -> DataFrame:
    """All columns of ``documents`` but ``text``, plus ``fingerprint`` and ``component_id``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the
    smallest id reachable, the document's own included. Every input row comes back once, repeated rows
    too. Null ids belong to the component of their fingerprint but never name it (a component of null ids
    only has a null id); null and empty texts have the fingerprint zero and link like any other. Columns
    of the input named like an output are replaced.
    """
    keep = [c for c in documents.columns if c not in (text, "fingerprint", "component_id")]
    marked = cut_lineage(fingerprints(documents.select(*keep, text), text, width))
    fps = cut_lineage(marked.groupBy("__fp").agg(F.min(doc_id).alias("__first")))
    roots = connected_components(links(fps, radius, bucket), "a", "b").withColumnsRenamed({"node": "__fp", "root": "__root"})
    rooted = cut_lineage(fps.join(roots, "__fp", "left").select("__fp", "__first", F.coalesce("__root", "__fp").alias("__root")))
    named = rooted.groupBy("__root").agg(F.min("__first").alias("component_id"))
    classes = rooted.join(named, "__root").select("__fp", "component_id")
    return marked.join(classes, "__fp").select(*keep, F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")
