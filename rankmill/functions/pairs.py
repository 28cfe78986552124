"""Best and counted pairs of two blocks of unit vectors.

Products are made in single precision; only pairs whose single score is within its error of what decides are scored
again in double precision, so results are those of double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from rankmill.functions.topk import round_half_up

#: Queries and vectors of one product (16 MiB of single scores), and pairs scored again at once.
SIDE = 2048
AGAIN = 200_000


def _slack(dims: int) -> np.float64:
    """Twice what a cosine in single precision can be off."""
    return (dims + 8) * 2.0**-23


def _exact(queries: np.ndarray, docs: np.ndarray, query: np.ndarray, doc: np.ndarray, decimals: int) -> np.ndarray:
    parts = [
        np.einsum("ij,ij->i", queries[query[s : s + AGAIN]], docs[doc[s : s + AGAIN]]) for s in range(0, len(query), AGAIN)
    ]
    return round_half_up((1.0 + np.concatenate(parts)) / 2.0 if parts else np.zeros(0), decimals)


def same_ids(query_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the queries and rows that have the same id."""
    asked = pd.DataFrame({"id": query_ids, "q": np.arange(len(query_ids))})
    both = asked.merge(pd.DataFrame({"id": ids, "d": np.arange(len(ids))}), on="id")
    return both["q"].to_numpy(), both["d"].to_numpy()


def _products(queries: np.ndarray, docs: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None):
    """(first query, first row, single products) of every pair of parts; `own` pairs get a product below all others."""
    queries, docs = queries.astype(np.float32), docs.astype(np.float32)
    for low in range(0, len(queries), SIDE):
        asked = queries[low : low + SIDE]
        mine = None if own is None else (own[0] >= low) & (own[0] < low + len(asked))
        q, d = (None, None) if own is None else (own[0][mine] - low, own[1][mine])
        for start in range(0, len(docs), SIDE):
            single = asked @ docs[start : start + SIDE].T
            if own is not None:
                here = (d >= start) & (d < start + single.shape[1])
                single[q[here], d[here] - start] = -4.0
            yield low, start, single


def _first(query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int):
    """The k best of each query, equal scores by row, and which of them are a k-th."""
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    begin = np.flatnonzero(np.diff(query, prepend=-1))
    rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
    keep = rank < k
    return query[keep], doc[keep], score[keep], rank[keep] == k - 1


def best_pairs(
    queries: np.ndarray, docs: np.ndarray, k: int, decimals: int, floor: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None = None,
    rough: np.ndarray | None = None, error: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows of each query with a rounded score of at least `floor` of the query.

    Among equal scores earlier rows win. Of equal rows only the first k (one more, as a query may leave out its own)
    are compared. With `rough` rows, whose product with a query is off by at most the query's `error`, the first products are
    made from those.
    """
    fine, asked = np.flatnonzero(np.isfinite(docs).all(axis=1)), np.flatnonzero(np.isfinite(queries).all(axis=1))
    if len(fine):
        plain = np.ascontiguousarray(docs[fine] + 0.0)
        _, same = np.unique(plain.view(np.dtype((np.void, plain.itemsize * plain.shape[1]))).ravel(), return_inverse=True)
        fine = fine[pd.Series(same).groupby(same).cumcount().to_numpy() <= k]
    if own is not None:
        to_query, to_doc = np.full(len(queries), -1), np.full(len(docs), -1)
        to_query[asked], to_doc[fine] = np.arange(len(asked)), np.arange(len(fine))
        q, d = to_query[own[0]], to_doc[own[1]]
        own = (q[(q >= 0) & (d >= 0)], d[(q >= 0) & (d >= 0)])
    queries, docs, least = queries[asked], docs[fine], floor[asked].astype(np.float64)
    seen = docs if rough is None else rough[fine]
    slack, half = np.full(len(queries), _slack(docs.shape[1])) + (0.0 if error is None else error[asked]), 10.0**-decimals
    done, held, rows = [], [], 0

    def settle(low: int):
        query, doc, score, last = _first(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
        least[query[last]] = score[last]
        return [(query, doc, score)]

    before = 0
    for low, start, single in _products(queries, seen, own):
        if low != before:
            done += settle(before) if held else []
            held, rows, before = [], 0, low
        count = len(single)
        off = slack[low : low + count]
        bar = (2.0 * (least[low : low + count] - half) - 1.0 - off)[:, None].astype(np.float32)
        near = single >= np.maximum(bar, np.float32(-3.0))
        if single.shape[1] > k and np.count_nonzero(near) > 2 * k * count:
            kth = np.partition(single, single.shape[1] - k, axis=1)[:, single.shape[1] - k]
            near &= single >= (kth - (2 * (off + half)).astype(np.float32))[:, None]
        query, doc = np.nonzero(near)
        if not len(query):
            continue
        query, doc = query + low, doc + start
        score = _exact(queries, docs, query, doc, decimals)
        keep = score >= least[query]
        held.append((query[keep], doc[keep], score[keep]))
        rows += int(keep.sum())
        if start == 0 or rows > 3 * k * count:
            held = settle(low)
            rows = len(held[0][0])
    done += settle(before) if held else []
    if not done:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    query, doc, score = (np.concatenate(x) for x in zip(*done, strict=True))
    return asked[query], fine[doc], score


def pairs_within(
    queries: np.ndarray, docs: np.ndarray, threshold: float, decimals: int, own: tuple[np.ndarray, np.ndarray] | None = None, scored: bool = True
):
    """(query, row, score or None) arrays of the pairs with a rounded score of at least `threshold`, in parts."""
    if scored:
        for low in range(0, len(queries), SIDE):
            for start in range(0, len(docs), SIDE):
                score = round_half_up((1.0 + queries[low : low + SIDE] @ docs[start : start + SIDE].T) / 2.0, decimals)
                if own is not None:
                    q, d = own[0] - low, own[1] - start
                    here = (q >= 0) & (q < score.shape[0]) & (d >= 0) & (d < score.shape[1])
                    score[q[here], d[here]] = -np.inf
                query, doc = np.nonzero(score >= threshold)
                yield query + low, doc + start, score[query, doc]
        return
    slack = _slack(docs.shape[1]) if len(docs) else 0.0
    bar = 2.0 * (threshold - 0.5 * 10.0**-decimals) - 1.0
    for low, start, single in _products(queries, docs, own):
        query, doc = np.nonzero(single >= np.float32(bar - slack))
        near = np.flatnonzero(single[query, doc] < np.float32(bar + slack))
        query, doc = query + low, doc + start
        off = near[_exact(queries, docs, query[near], doc[near], decimals) < threshold]
        yield (np.delete(query, off), np.delete(doc, off), None) if len(off) else (query, doc, None)


def counted_pairs(
    queries: np.ndarray, query_kinds: np.ndarray, docs: np.ndarray, kinds: np.ndarray, thresholds: list[float],
    marks: list[np.ndarray], decimals: int, own: tuple[np.ndarray, np.ndarray] | None = None,
) -> np.ndarray:
    """Queries x thresholds x marks: the rows at or above each threshold whose kind a mark counts for the query's kind.

    A mark is a table of truth values by kind of query and kind of row.
    """
    order = np.argsort(kinds, kind="stable")
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    docs, kinds = docs[order], kinds[order]
    own = None if own is None else (own[0], place[own[1]])
    weights = np.stack(marks, axis=2).astype(np.float32)  # query kind, kind, mark
    slack = _slack(docs.shape[1]) if len(docs) else 0.0
    out = np.zeros((len(queries), len(thresholds), len(marks)), dtype=np.int64)
    for low, start, single in _products(queries, docs, own):
        here = kinds[start : start + single.shape[1]]
        shown, code = np.unique(here, return_inverse=True)
        member = np.zeros((len(here), len(shown)), np.float32)
        member[np.arange(len(here)), code] = 1.0
        asked = weights[query_kinds[low : low + len(single)]][:, shown]  # query, shown kind, mark
        for i, threshold in enumerate(thresholds):
            bar = 2.0 * (threshold - 0.5 * 10.0**-decimals) - 1.0
            sure = single >= np.float32(bar + slack)
            query, doc = np.nonzero(sure ^ (single >= np.float32(bar - slack)))
            if len(query):
                sure[query, doc] = _exact(queries, docs, query + low, doc + start, decimals) >= threshold
            found = sure.astype(np.float32) @ member
            out[low : low + len(single), i] += np.rint(np.einsum("qs,qsm->qm", found, asked)).astype(np.int64)
    return out


def repeated_pairs(
    queries: np.ndarray, query_kinds: np.ndarray, docs: np.ndarray, kinds: np.ndarray, query_ids: np.ndarray, ids: np.ndarray,
    thresholds: list[float], marks: list[np.ndarray], decimals: int, exclude_self: bool,
) -> np.ndarray:
    """Queries x thresholds x marks: the ids among `ids` that a query id meets in more than one pair that the mark counts.

    The count stands in the first row of a query id. Only ids that are there more than once, on either side, are compared.
    """
    out = np.zeros((len(queries), len(thresholds), len(marks)), dtype=np.int64)
    asked, stored = pd.factorize(query_ids, use_na_sentinel=False)[0], pd.factorize(ids, use_na_sentinel=False)[0]
    many, several = np.bincount(asked)[asked] > 1, np.bincount(stored)[stored] > 1
    every = np.arange(len(docs))[np.argsort(stored, kind="stable")]
    rows = np.arange(len(queries))[np.argsort(asked, kind="stable")]
    for chosen, against in ((rows[many[rows]], every), (rows[~many[rows]], every[several[every]])):
        if not len(chosen) or not len(against):
            continue
        groups = np.flatnonzero(np.diff(stored[against], prepend=-1))
        starts = np.flatnonzero(np.diff(asked[chosen], prepend=-1))
        size = max(1, SIDE * SIDE // len(against))
        low = 0
        while low < len(starts):  # all rows of a query id are in one block
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + size, side="right")) - 1)
            block = chosen[starts[low] : starts[high] if high < len(starts) else len(chosen)]
            score = round_half_up((1.0 + queries[block] @ docs[against].T) / 2.0, decimals)
            if exclude_self:
                q, d = same_ids(query_ids[block], ids[against])
                score[q, d] = -np.inf
            first = starts[low:high] - starts[low]
            for m, mark in enumerate(marks):
                counted = mark[query_kinds[block][:, None], kinds[against][None, :]]
                for i, threshold in enumerate(thresholds):
                    met = np.add.reduceat(np.add.reduceat(((score >= threshold) & counted).astype(np.int32), groups, axis=1), first, axis=0)
                    out[block[first], i, m] = (met > 1).sum(axis=1)
            low = high
    return out
