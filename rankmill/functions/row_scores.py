"""Counting and scoring of query words inside the rows of a scan.

A task holds the query words of a search as flat sorted arrays. For each Arrow batch of analysed texts it finds
the known words, counts them per row and follows the arrays from words to queries, so no text, word or pair
has to move to another task before it is counted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

K1 = 1.2
B = 0.75
#: Pairs of a text and a query word that are expanded at a time.
PAIRS = 2_000_000


def saturation(frequency: np.ndarray, length: np.ndarray, average: np.ndarray) -> np.ndarray:
    return frequency * (K1 + 1) / (frequency + K1 * (1 - B + B * length / average))


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges first, first + 1, ... of each length, one after the other."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(int(count.sum()))


def lookup(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``known``, and which are there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def _numbers(values: pa.Array, fill: int = 0) -> np.ndarray:
    return pc.fill_null(values, fill).to_numpy(zero_copy_only=False)


def _ranges(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of sorted ``keys`` with their first place and count."""
    return np.unique(keys, return_index=True, return_counts=True)


class QueryWords:
    """Query words by (field, word), from rows of ``query_id, field, term`` and the columns a search needs.

    ``source`` groups words of which only the best counts; ``anchor`` marks the words by which candidates are found.
    """

    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.reset_index(drop=True)
        self.fields, field = np.unique(rows["field"].to_numpy(dtype=str), return_inverse=True)
        self.words, word = np.unique(rows["term"].to_numpy(dtype=str), return_inverse=True)
        self.query_ids, query = np.unique(rows["query_id"].to_numpy(dtype=str), return_inverse=True)
        self.span = max(1, len(self.fields) * len(self.words))
        cell = field * max(1, len(self.words)) + word
        order = np.argsort(cell, kind="stable")
        self.cell, self.query, self.field = cell[order], query[order], field[order]
        self.cells, self.first, self.count = _ranges(self.cell)
        self.rows = rows.iloc[order].reset_index(drop=True)
        source = self.rows["source"] if "source" in self.rows else self.rows["term"]
        self.source = source.groupby(self.query).transform(lambda s: pd.factorize(s)[0]).to_numpy(dtype=np.int64) if len(rows) else np.zeros(0, np.int64)
        self.sources = int(self.source.max(initial=0)) + 1

    def column(self, name: str) -> np.ndarray:
        return self.rows[name].to_numpy()

    def places(self, field: pa.Array, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, place in the row) of every known word."""
        tokens = words.flatten()
        sizes = _numbers(pc.list_value_length(words))
        fields = _numbers(pc.index_in(field, value_set=pa.array(self.fields.tolist(), field.type)), -1)
        known = _numbers(pc.index_in(tokens, value_set=pa.array(self.words.tolist(), tokens.type)), -1)
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero((known >= 0) & (fields[row] >= 0))
        return row[at], fields[row[at]].astype(np.int64) * len(self.words) + known[at], at - (np.cumsum(sizes) - sizes)[row[at]]

    def counts(self, field: pa.Array, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, frequency) of the (field, word) pairs that queries ask for, by row and cell."""
        row, cell, _ = self.places(field, words)
        keys, frequency = np.unique(row * self.span + cell, return_counts=True)
        row, cell = keys // self.span, keys % self.span
        _, fine = lookup(self.cells, cell)
        return row[fine], cell[fine], frequency[fine]

    def pairs(self, field: pa.Array, words: pa.ListArray, lengths: np.ndarray, score: bool = True):
        """Blocks of (row, query, score, matched words, occurrences) of all rows and queries that share a word."""
        row, cell, frequency = self.counts(field, words)
        at, _ = lookup(self.cells, cell)
        number = self.count[at]
        idf, average = (self.column("idf"), self.column("average_length")) if score else (None, None)
        for low, high in _blocks(row, number):
            n = number[low:high]
            entry, r, tf = expand(self.first[at[low:high]], n), np.repeat(row[low:high], n), np.repeat(frequency[low:high], n)
            value = idf[entry] * saturation(tf, lengths[r], average[entry]) if score else np.zeros(len(entry))
            key = (r * len(self.query_ids) + self.query[entry]) * self.sources + self.source[entry]
            order = np.argsort(key, kind="stable")
            keys, first, _ = _ranges(key[order])
            if len(keys):
                value = np.maximum.reduceat(value[order], first)  # the best spelling of each query word
                tf = np.add.reduceat(tf[order], first)
                pair, first, matched = _ranges(keys // self.sources)
                yield pair // len(self.query_ids), pair % len(self.query_ids), np.add.reduceat(value, first), matched, np.add.reduceat(tf, first)


def _blocks(row: np.ndarray, number: np.ndarray, most: int = PAIRS):
    """Slices of whole rows with about ``most`` pairs each."""
    if not len(row):
        return
    starts = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
    before = (np.cumsum(number) - number)[starts]
    cuts = starts[np.unique(before // most, return_index=True)[1]].tolist() + [len(row)]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


class WordGroups(QueryWords):
    """Query words by (query, field), for searches that need all words of a group.

    A group's anchor words give the candidate rows; ``slot`` is a word's place in a phrase.
    """

    def __init__(self, rows: pd.DataFrame) -> None:
        super().__init__(rows)
        group = self.query * max(1, len(self.fields)) + self.field
        order = np.argsort(group, kind="stable")
        self.groups, self.group_first, self.group_count = _ranges(group[order])
        self.member = order
        anchors = np.flatnonzero(self.column("anchor").astype(bool)) if len(self.rows) else np.zeros(0, np.int64)
        self.anchor_group = group[anchors]
        self.anchor_cells, self.anchor_first, self.anchor_count = _ranges(self.cell[anchors])

    def candidates(self, row: np.ndarray, cell: np.ndarray):
        """Blocks of (row, place of the group) of rows that hold an anchor word of the group."""
        at, fine = lookup(self.anchor_cells, cell)
        row, at = row[fine], at[fine]
        for low, high in _blocks(row, self.anchor_count[at], PAIRS // 8):
            n = self.anchor_count[at[low:high]]
            group = self.anchor_group[expand(self.anchor_first[at[low:high]], n)]
            keys = np.unique(np.repeat(row[low:high], n) * len(self.groups) + lookup(self.groups, group)[0])
            if len(keys):
                yield keys // len(self.groups), keys % len(self.groups)

    def all_words(self, field: pa.Array, words: pa.ListArray, lengths: np.ndarray):
        """Blocks of (row, query, score, words) of the rows that hold every word of a group."""
        row, cell, frequency = self.counts(field, words)
        keys = row * self.span + cell
        idf, average = self.column("idf"), self.column("average_length")
        for r, group in self.candidates(row, cell):
            n = self.group_count[group]
            entry = self.member[expand(self.group_first[group], n)]
            of = np.repeat(np.arange(len(r)), n)
            at, there = lookup(keys, r[of] * self.span + self.cell[entry])
            value = np.where(there, idf[entry] * saturation(frequency[at], lengths[r[of]], average[entry]), 0.0)
            full = np.bincount(of, there, len(r)) == self.column("terms")[self.member[self.group_first[group]]]
            yield r[full], self.groups[group[full]] // len(self.fields), np.bincount(of, value, len(r))[full], n[full]

    def phrases(self, field: pa.Array, words: pa.ListArray, positions: np.ndarray | None, slop: int):
        """Blocks of (row, query, frequency) of the rows in which a group's slots follow each other.

        ``positions`` are those of all tokens of the batch, or None where words follow each other. A word at position p for slot s votes for start p - s; a
        phrase occurs where every slot has a vote in a window of ``slop`` after an occupied start.
        """
        row, cell, place = self.places(field, words)
        sizes = _numbers(pc.list_value_length(words))
        where = place if positions is None else positions[(np.cumsum(sizes) - sizes)[row] + place]
        order = np.lexsort((where, row * self.span + cell))
        keys, first, count = _ranges((row * self.span + cell)[order])
        where = where[order]
        slot, slots = self.column("slot").astype(np.int64), self.column("slots").astype(np.int64)
        for r, group in self.candidates(keys // self.span, keys % self.span):
            n = self.group_count[group]
            entry = self.member[expand(self.group_first[group], n)]
            of = np.repeat(np.arange(len(r)), n)
            at, there = lookup(keys, r[of] * self.span + self.cell[entry])
            of, entry, at = of[there], entry[there], at[there]
            n = count[at]
            start = where[expand(first[at], n)] - np.repeat(slot[entry], n)
            vote = np.stack([np.repeat(of, n), start, np.repeat(slot[entry], n)])
            windows = np.repeat(vote, slop + 1, axis=1)
            window = windows[1] - np.tile(np.arange(slop + 1), vote.shape[1])
            order = np.lexsort((windows[2], window, windows[0]))
            of, window, start, part = windows[0][order], window[order], windows[1][order], windows[2][order]
            if not len(of):
                continue
            new = np.r_[True, (of[1:] != of[:-1]) | (window[1:] != window[:-1])]
            heads = np.flatnonzero(new)
            filled = np.add.reduceat(np.r_[True, new[1:] | (part[1:] != part[:-1])].astype(int), heads)
            lowest = np.minimum.reduceat(start, heads)
            needed = slots[self.member[self.group_first[group[of[heads]]]]]
            found = np.bincount(of[heads][(filled == needed) & (lowest == window[heads])], minlength=len(r))
            some = found > 0
            yield r[some], self.groups[group[some]] // len(self.fields), found[some]
