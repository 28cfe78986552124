"""Expressions over token-weight maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankmill.functions.binding import let


def prune_sparse(weights: Column, ratio: float) -> Column:
    """Keep finite positive weights of at least `ratio` times the largest of them."""
    positive = F.map_filter(
        weights, lambda _, w: ~F.isnan(w) & (w > 0) & (w < F.lit(float("inf")))
    )
    return let(
        positive,
        lambda kept: let(
            F.array_max(F.map_values(kept)) * F.lit(ratio),
            lambda least: F.map_filter(kept, lambda _, w: w >= least),
        ),
    )


def counts_in_row(words: Column) -> Column:
    """Map of each word to how often it is in the array: the words are sorted, and each run of equal ones is measured."""
    def runs(sorted_words: Column) -> Column:
        last = F.size(sorted_words) - 1
        begins = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(sorted_words, i) != F.get(sorted_words, i - 1)))
        return let(begins, lambda b: F.map_from_arrays(
            F.transform(b, lambda i: F.get(sorted_words, i)),
            F.transform(b, lambda i, n: (F.coalesce(F.get(b, n + 1), last + 1) - i).cast("double")),
        ))

    return F.when(F.size(words) > 0, let(F.sort_array(words), runs))
