import hashlib
import random
from collections import Counter

import pytest

from rankmill.llm.repeats import repeated_starts, repeated_windows

DDL = "doc_id long, text string, key string"


def slow(rows, window):
    docs = [(d, [w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in docs for i in range(len(w) - window + 1))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)] + ["é", "A", "a"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passages = [text(n) for n in (34, 35, 36, 50, 120)]
    rows = []
    for i in range(90):
        parts = [text(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages), text(rng.randint(0, 40))]
        rows.append("\n".join(parts))
    rows += rows[:6] + [passages[4] + " " + passages[4], "x " * 90, "y", "", None, text(20000)]
    rows += [text(3) + " " + passages[3] + " " + text(2) for _ in range(40)]
    return list(enumerate(rows))


@pytest.mark.parametrize("group", [2000, 4])
def test_matches_brute_force(spark, group):
    """With a tiny group bound the crowded anchors take the split path."""
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], DDL).repartition(4)
    got = repeated_windows(docs, group=group).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows, 35)


def test_small_windows_and_repeated_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "b c x"), (None, "q b c"), (4, None)]
    docs = spark.createDataFrame([(d, t, None) for d, t in rows], DDL)
    got = repeated_windows(docs, window=2, gram=1)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == slow(rows, 2)
    spans = {r.doc_id: [tuple(s) for s in r.removed_spans] for r in got.collect()}
    assert spans[2] == [(0, 2)] and spans[None] == [(1, 3)] and spans[4] == []
    assert repeated_windows(docs.limit(0)).count() == 0


def test_subtree_flags_every_repeated_start():
    a, b = "p q r s t".split(), "z q r s y".split()
    to = lambda xs: [x.encode() for x in xs]
    assert [list(x) for x in repeated_starts([to(a), to(b), to("x x x x x".split())], 3)] == [[1], [1], [0, 1, 2]]
