"""Repeated word windows by prefix-partitioned suffix trees.

Only starts of windows that can repeat become suffixes. Every window of ``window`` words holds an anchor:
the leftmost k-gram with the smallest hash inside it. The anchor is a function of the window's own words,
so equal windows have equal anchors, and a window whose anchor k-gram occurs once in the corpus is unique.
The suffixes of the remaining windows are grouped by that k-gram. A group within the memory bound becomes
one subtree: prefixes grow 1, 2, 4, ... words up to the window length, a suffix leaves as soon as its prefix
is unique (so prefixes have variable length), and the nodes left at full depth are the maximal repeats cut at
the window length. A larger group is not gathered; its suffixes are split by their whole-window prefix, an
aggregate with map-side combining.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.common import slices
from rankmill.session import cut_lineage, scratch_path

#: Words of an anchor k-gram; shorter ones sample fewer positions but meet by chance more often.
GRAM = 10
#: Occurrences of one anchor that may be gathered in a task (about 60 words each).
GROUP = 2000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def text_key(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def anchors(words: list[bytes], window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window start, number of starts) of every anchor, in order of position."""
    windows = len(words) - window + 1
    if windows < 1:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    digest = xxhash.xxh64_intdigest
    single = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    size = len(words) - gram + 1
    grams = np.zeros(size, dtype=np.uint64)
    for j in range(gram):
        grams = grams * _BASE + single[j : j + size]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(29)
    span = window - gram + 1
    place = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(windows)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return grams[place[first]].view(np.int64), first, np.diff(np.r_[first, windows])


def repeated_starts(segments: list[list[bytes]], window: int) -> list[np.ndarray]:
    """For each segment the window starts whose words start a second suffix in any segment of the group.

    The subtree over all suffixes, refined from prefix length m to 2m; suffixes with a unique prefix are
    dropped before the next level.
    """
    codes: dict[bytes, int] = {}
    flat = np.array([codes.setdefault(w, len(codes)) for w in chain.from_iterable(segments)], dtype=np.int64)
    lengths = np.array([len(s) for s in segments])
    begins = np.cumsum(lengths) - lengths
    node, depth = flat, 1
    alive = np.concatenate([np.arange(b, b + n - window + 1) for b, n in zip(begins, lengths)])
    while len(alive):
        _, inverse, count = np.unique(node[alive], return_inverse=True, return_counts=True)
        alive = alive[count[inverse] > 1]
        if depth == window:
            break
        step = min(depth, window - depth)
        pair = np.full(len(node), -1, dtype=np.int64)
        head = node[: len(node) - step]
        pair[: len(head)] = head * (len(node) + 1) + node[step:]
        node = np.unique(pair, return_inverse=True)[1]
        depth += step
    owner = np.searchsorted(begins, alive, side="right") - 1
    cuts = np.searchsorted(owner, np.arange(1, len(segments)))
    return [part - b for part, b in zip(np.split(alive, cuts), begins)]


def _anchor_rows(window: int, gram: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            out = []
            for text in batch["text"]:
                grams, first, count = anchors(words_of(text), window, gram)
                if len(grams):
                    out.append((text_key(text), grams, first, count))
            yield pd.DataFrame(out, columns=["key", "grams", "firsts", "counts"])

    return rows


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in slices(batches):
        pack = zstandard.ZstdCompressor(level=3)
        yield pd.DataFrame({
            "key": [text_key(x) for x in batch["text"]],
            "packed": [pack.compress(x.encode("utf-8", "surrogatepass")) for x in batch["text"]],
        })


def _unpack(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split()


def _segment_rows(window: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, 64):
            out = []
            for row in batch.itertuples(index=False):
                words = _unpack(row.packed)
                for at in row.places:
                    first, count = at["first"], at["count"]
                    content = b" ".join(words[first : first + count + window - 1])
                    out.append((at["gram"], at["crowded"], row.key, first, count, content))
            yield pd.DataFrame(out, columns=["gram", "crowded", "key", "first", "count", "content"])

    return rows


def _subtrees(window: int, group: int):
    """Groups arrive sorted by gram; several are put into one tree, as equal windows have equal anchors."""

    def flush(held: list) -> pd.DataFrame:
        found = repeated_starts([x.content.split(b" ") for x in held], window)
        hits = [(x.key, x.first, sum(1 << int(i) for i in s)) for x, s in zip(held, found) if len(s)]
        return pd.DataFrame(hits, columns=["key", "first", "mask"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if len(held) >= group and held[-1].gram != row.gram:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return rows


def _window_rows(window: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                words = row.content.split(b" ")
                out += [(row.digest, 1 << i, hashlib.md5(b" ".join(words[i : i + window])).digest()) for i in range(row.count_)]
            yield pd.DataFrame(out, columns=["digest", "bit", "prefix"])

    return rows


def _split_prefixes(crowd: DataFrame, window: int) -> DataFrame:
    """(key, first, mask) of crowded anchors, without gathering a group.

    Equal segments are counted first: all starts of a segment that occurs twice repeat. One copy of each
    distinct segment then gives its suffixes, split by their whole-window prefix; a prefix found in two
    distinct segments repeats in both.
    """
    crowd = crowd.withColumn("digest", F.md5("content"))
    place = F.struct("key", "first")
    segments = crowd.groupBy("digest").agg(F.first("content").alias("content"), F.first("count").alias("count_"), (F.min(place) != F.max(place)).alias("twice"))
    suffixes = segments.select("digest", "content", "count_").mapInPandas(_window_rows(window), "digest string, bit long, prefix binary")
    shared = suffixes.groupBy("prefix").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("prefix")
    part = suffixes.join(shared, "prefix").groupBy("digest").agg(F.sum("bit").alias("part"))
    masks = segments.select("digest", "count_", "twice").join(part, "digest", "left").select(
        "digest", F.when(F.col("twice"), F.expr("shiftleft(1L, count_) - 1")).otherwise(F.col("part")).alias("mask")
    ).where("mask is not null")
    return crowd.select("digest", "key", "first").join(masks, "digest").select("key", "first", "mask")


def _result_rows(window: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, 64):
            out = []
            for row in batch.itertuples(index=False):
                words = _unpack(row.packed)
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                if row.copies > 1 and len(words) >= window:
                    cover[0] = 1
                elif row.hits is not None:
                    for hit in row.hits:
                        for i in range(hit["mask"].bit_length()):
                            if hit["mask"] >> i & 1:
                                cover[hit["first"] + i] += 1
                                cover[hit["first"] + i + window] -= 1
                covered = np.cumsum(cover[:-1]) > 0
                kept = b" ".join(w for w, c in zip(words, covered.tolist()) if not c)
                edges = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
                spans = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
                out.append((row.key, len(words), int(covered.sum()), hashlib.sha256(kept).hexdigest(), spans))
            yield pd.DataFrame(out, columns=["key", "n_words", "n_removed", "kept_sha256", "removed_spans"])

    return rows


def repeated_windows(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed_spans) for every row of ``documents``.

    A word is removed when a window of ``window`` consecutive words that covers it also starts anywhere
    else in the table, in the same document included; windows are judged on the input. ``removed_spans``
    holds the removed word ranges [start, end). Rows with equal texts are one occurrence each, so their
    windows all repeat. Null and empty texts have no words; texts shorter than the window lose nothing;
    an empty table gives no rows. Columns other than the id and the text are ignored, whatever their names.
    """
    if not 0 < gram <= window or window - gram >= 62:
        raise ValueError("the anchor must fit in the window, with fewer than 62 places")
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    place = scratch_path(spark, "anchors")
    docs.select("text").mapInPandas(_anchor_rows(window, gram), "key binary, grams array<long>, firsts array<int>, counts array<int>").write.option("compression", "zstd").parquet(place)
    found = spark.read.parquet(place).select("key", F.explode(F.arrays_zip("grams", "firsts", "counts")).alias("a")).select(
        "key", F.col("a.grams").alias("gram"), F.col("a.firsts").alias("first"), F.col("a.counts").alias("count")
    )
    frequent = cut_lineage(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > group).alias("crowded")))
    places = found.join(frequent, "gram").groupBy("key").agg(F.collect_set(F.struct("gram", "first", "count", "crowded")).alias("places"))
    packed = docs.select("text").mapInPandas(_packed, "key binary, packed binary")
    texts = packed.groupBy("key").agg(F.first("packed").alias("packed"), F.count("*").alias("copies"))
    place = scratch_path(spark, "suffixes")
    texts.join(places, "key").select("key", "packed", "places").mapInPandas(
        _segment_rows(window), "gram long, crowded boolean, key binary, first int, count int, content binary"
    ).write.option("compression", "zstd").parquet(place)
    suffixes = spark.read.parquet(place)
    trees = suffixes.where("not crowded").select("gram", "key", "first", "content").repartition("gram").sortWithinPartitions("gram").mapInPandas(
        _subtrees(window, group), "key binary, first int, mask long"
    )
    crowded = _split_prefixes(suffixes.where("crowded"), window)
    hits = trees.union(crowded).groupBy("key").agg(F.collect_list(F.struct("first", "mask")).alias("hits"))
    results = texts.join(hits, "key", "left").mapInPandas(
        _result_rows(window),
        "key binary, n_words long, n_removed long, kept_sha256 string, removed_spans array<struct<start:int,end:int>>",
    )
    keyed = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    return keyed.join(results, "key").select("doc_id", "n_words", "n_removed", "kept_sha256", "removed_spans")
