"""Best k per query inside one task, merged over its batches."""

from __future__ import annotations

import numpy as np
import pandas as pd

SCHEMA = "query_id string, document_id string, score double"


def round_half_up(scores: np.ndarray, decimals: int) -> np.ndarray:
    """Rounds like SQL does; infinities stay."""
    unit = 10.0**decimals
    return np.floor(scores * unit + 0.5) / unit  # -inf marks a pair that does not match


def natural_rows(ids: np.ndarray) -> pd.DataFrame:
    """The ids in natural order; the frame's index holds their former positions."""
    text = pd.Series(ids).astype(str)
    digits = text.str.fullmatch("[0-9]+")
    plain = text.str.lstrip("0").where(digits, "")
    return pd.DataFrame(
        {"kind": (~digits).astype(int), "size": plain.str.len(), "plain": plain, "text": text}
    ).sort_values(["kind", "size", "plain", "text"])


class LocalTopK:
    """Keeps the k best documents per query, ties by natural id order.

    Only rows that can still enter some query's k best are kept, as 16 bytes of numbers each; an id is held once
    however many queries keep it. Memory stays near `3 * queries * k` rows however many batches a task reads.
    """

    def __init__(self, query_ids: list[str], k: int, decimals: int) -> None:
        self.query_ids = np.asarray(query_ids, dtype=object)
        self.k = k
        self.decimals = decimals
        self.floor = np.full(len(query_ids), -np.inf)
        self.names = np.zeros(0, dtype=object)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """`scores` is documents x queries; -inf marks pairs that do not match.

        Rows are put in natural id order first, so among equal scores the first ones win.
        """
        if scores.size == 0:
            return
        order = natural_rows(ids).index.to_numpy()
        ids, scores = ids[order], round_half_up(scores[order], self.decimals)
        scores = np.where(np.isnan(scores), -np.inf, scores)  # zero vectors match nothing
        keep = (scores >= self.floor) & (scores > -np.inf)
        if len(ids) > self.k:
            kth = np.partition(scores, len(ids) - self.k, axis=0)[-self.k]
            above, level = scores > kth, scores == kth
            room = self.k - above.sum(axis=0)
            keep &= above | (level & (np.cumsum(level, axis=0) <= room))
        query, row = np.nonzero(keep.T)
        self.add_pairs(ids, query, row, scores[row, query])

    def add_pairs(self, ids: np.ndarray, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        """Rounded scores of single pairs, by places of query and id."""
        if not len(query):
            return
        used, code = np.unique(row, return_inverse=True)
        self.parts.append((query.astype(np.int32), (code + len(self.names)).astype(np.int32), score))
        self.names = np.concatenate([self.names, ids[used]])
        self.rows += len(query)
        if self.rows > 3 * self.k * len(self.query_ids) + 100_000:
            self._compact()

    def _compact(self) -> None:
        if not self.parts:
            return
        query, code, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        place = np.empty(len(self.names), dtype=np.int64)
        place[natural_rows(self.names).index.to_numpy()] = np.arange(len(self.names))
        order = np.lexsort((place[code], -score, query))
        query, code, score = query[order], code[order], score[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        last = rank == self.k - 1
        self.floor[query[last]] = score[last]
        keep = rank < self.k
        used, code = np.unique(code[keep], return_inverse=True)
        self.names = self.names[used]
        self.parts, self.rows = [(query[keep], code.astype(np.int32), score[keep])], int(keep.sum())

    def frame(self) -> pd.DataFrame:
        """The kept rows. Ids stay plain objects, which convert to Arrow also when there are none."""
        self._compact()
        query, code, score = self.parts[0] if self.parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pd.DataFrame(
            {
                "query_id": pd.Series(self.query_ids[query], dtype=object),
                "document_id": pd.Series([str(x) for x in self.names[code]], dtype=object),
                "score": pd.Series(score, dtype=float),
            }
        )
