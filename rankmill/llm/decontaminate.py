"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document with as many words as a benchmark item is compared with the items of that size:
their 64-bit SimHashes are cut into blocks, and two fingerprints within ``RADIUS`` bits must have a block
within ``RADIUS // BLOCKS`` bits of each other, so a table per block value finds every item within the
radius. Those candidates are verified by the exact weighted Jaccard similarity of their word shingles.
Windows that hold no shingle of any item have similarity zero with all of them, so only windows around
shared shingles are fingerprinted. A document shorter than an item is one whole window for it, compared
exactly with the items whose length lets them reach the similarity.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.llm.common import slices

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at similarity 0.8 differs in about 10 of 64 bits, with a deviation of 3.
RADIUS, BLOCKS = 23, 8
#: Items of one index; a larger benchmark is searched in several passes.
ITEMS = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER = 1 << 20
MATCHES = "array<struct<item_id:long,start:int,end:int,similarity:double>>"


def words_of(text: str | None) -> list[bytes]:
    """Words between white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word codes."""
    size = len(codes) - width + 1
    out = np.zeros(max(0, size), dtype=np.uint64)
    for j in range(width if size > 0 else 0):
        out = out * _BASE + codes[j : j + size]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def window_fingerprints(hashes: np.ndarray, count: int) -> np.ndarray:
    """SimHash of every run of ``count`` shingle hashes; a bit is set if more than half have it."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    major = 2 * (sums[count:] - sums[:-count]) > count
    return np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()


def weighted_similarity(a: list[bytes], b: list[bytes], width: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of the shingles, repeats counted; shorter texts are one shingle."""

    def shingles(words: list[bytes]) -> Counter:
        return Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))

    x, y = shingles(a), shingles(b)
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


@dataclass
class SizeIndex:
    """The items of one word count: fingerprints and, per block, the items near every block value."""

    items: list[int] = field(default_factory=list)
    fingerprints: np.ndarray | None = None
    near: np.ndarray | None = None

    def build(self, values: list[int], radius: int) -> None:
        self.fingerprints = np.array(values, dtype=np.uint64)
        octets = self.fingerprints.view(np.uint8).reshape(-1, BLOCKS)
        distance = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
        self.near = np.stack([distance[:, octets[:, k]] <= radius // BLOCKS for k in range(BLOCKS)])

    def candidates(self, windows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, found through the block tables."""
        octets = np.ascontiguousarray(windows).view(np.uint8).reshape(-1, BLOCKS)
        met = np.zeros((len(windows), len(self.items)), dtype=bool)
        for k in range(BLOCKS):
            met |= self.near[k][octets[:, k]]
        w, i = np.nonzero(met)
        close = np.bitwise_count(windows[w] ^ self.fingerprints[i]) <= radius
        return w[close], i[close]


@dataclass
class ItemIndex:
    ids: list[int]
    words: list[list[bytes]]
    radius: int = RADIUS
    similarity: float = SIMILARITY
    sizes: dict[int, SizeIndex] = field(default_factory=dict)
    #: Per shingle width: the sorted hashes of the item shingles and a bit table that most others miss.
    shingles: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: Item sizes that own a shingle hash.
    owners: dict[int, set[int]] = field(default_factory=dict)
    #: Items that hold a shingle hash.
    holders: dict[int, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        prints: dict[int, list[int]] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        for k, words in enumerate(self.words):
            if not words:
                continue
            n, width = len(words), min(SHINGLE, len(words))
            own = shingle_hashes(word_codes(words), width)
            self.sizes.setdefault(n, SizeIndex()).items.append(k)
            prints.setdefault(n, []).append(int(window_fingerprints(own, len(own))[0]))
            hashes.setdefault(width, []).append(own)
            for h in set(own.tolist()):
                self.owners.setdefault(h, set()).add(n)
                self.holders.setdefault(h, []).append(k)
        for n, values in prints.items():
            self.sizes[n].build(values, self.radius)
        for width, parts in hashes.items():
            known = np.unique(np.concatenate(parts))
            table = np.zeros(_FILTER, dtype=bool)
            table[(known & np.uint64(_FILTER - 1)).astype(np.int64)] = True
            self.shingles[width] = known, table

    def matches(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item id, first word, end word, similarity) of the best window for every matching item."""
        words = words_of(text)
        codes = word_codes(words)
        best: dict[int, tuple[float, int]] = {}
        for width, (known, table) in self.shingles.items():
            hashes = shingle_hashes(codes, width)
            maybe = np.flatnonzero(table[(hashes & np.uint64(_FILTER - 1)).astype(np.int64)])
            if not len(maybe):
                continue
            at = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
            hits = maybe[known[at] == hashes[maybe]]
            spots: dict[int, list[int]] = {}
            for q in hits.tolist():
                for n in self.owners[int(hashes[q])]:
                    spots.setdefault(n, []).append(q)
            for n, places in spots.items():
                if n <= len(words):
                    self._search(n, n - width + 1, np.array(places), hashes, words, best)
            if len(words) < max(spots, default=0):
                self._whole(hashes[hits], words, best)
        return sorted((self.ids[k], s, min(s + len(self.words[k]), len(words)), round(v, 6)) for k, (v, s) in best.items())

    def _whole(self, hits: np.ndarray, words: list[bytes], best: dict) -> None:
        """All ``words``, whose shingles ``hits`` are known, as one window for the longer items they can reach."""
        shared = Counter(k for h in hits.tolist() for k in self.holders[h] if len(self.words[k]) > len(words))
        for k, count in shared.items():
            if count >= self.similarity * (len(self.words[k]) - SHINGLE + 1) - 1e-9:
                value = weighted_similarity(words, self.words[k])
                if value >= self.similarity:
                    best[k] = value, 0

    def _search(self, n: int, count: int, places: np.ndarray, hashes: np.ndarray, words: list[bytes], best: dict) -> None:
        """Windows of ``count`` shingles that hold a shingle at one of ``places``."""
        lows, highs = np.maximum(0, places - count + 1), np.minimum(len(hashes) - count, places)
        ok = lows <= highs
        lows, highs = lows[ok], highs[ok]
        if not len(lows):
            return
        cut = np.flatnonzero(lows[1:] > np.maximum.accumulate(highs)[:-1] + 1) + 1
        index = self.sizes[n]
        for low, high in zip(lows[np.r_[0, cut]], np.maximum.accumulate(highs)[np.r_[cut - 1, len(highs) - 1]]):
            w, items = index.candidates(window_fingerprints(hashes[low : high + count], count), self.radius)
            for start, i in zip((w + low).tolist(), items.tolist()):
                k = index.items[i]
                value = weighted_similarity(words[start : start + n], self.words[k])
                if value >= self.similarity and value > best.get(k, (0.0, 0))[0]:
                    best[k] = value, start


def _finder(held: Broadcast):
    @F.pandas_udf(MATCHES)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list = []
            for piece in slices(iter([batch.to_frame("text")])):
                out += [[dict(zip(("item_id", "start", "end", "similarity"), m)) for m in held.value.matches(x)] for x in piece["text"]]
            yield pd.Series(out, dtype=object)

    return found


def matches(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> Column:
    """A column of ``documents``: array of (item_id, start, end, similarity) of the items found in ``text``.

    An item is found where some window of as many words has a weighted similarity of at least 0.8, or all of
    a text of fewer words has; of several windows the best, then the first, is given. Null and empty texts find nothing, null and empty
    items are never found, and a repeated item is found once per row. The benchmark is a stated query set:
    it is held in memory in indexes of at most ``ITEMS`` items each.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    parts = max(1, -(-items.count() // ITEMS))
    columns = []
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect() if parts > 1 else items.collect()
        rows = sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        held = documents.sparkSession.sparkContext.broadcast(ItemIndex([r["item_id"] for r in rows], [words_of(r["text"]) for r in rows]))

        columns.append(_finder(held)(F.col(text)))
    return F.concat(*columns) if len(columns) > 1 else columns[0]


def contaminated(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, similarity): one row per document row and item found in it."""
    found = documents.select(F.col(doc_id).alias("doc_id"), matches(documents, benchmark, text).alias("m"))
    return found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.item_id", "m.start", "m.end", "m.similarity")


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns, in which no benchmark item is found."""
    return documents.where(F.size(matches(documents, benchmark, text)) == 0)
