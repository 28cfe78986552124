import random

import numpy as np
import pytest

from rankmill.llm.decontaminate import RADIUS, ItemIndex, SizeIndex, clean, contaminated, weighted_similarity, window_fingerprints, words_of


def slow(text, items):
    """Best similarity over all item-sized windows."""
    words, out = words_of(text), {}
    for key, item in items:
        goal = words_of(item)
        if goal:
            values = [weighted_similarity(words[s : s + len(goal)], goal) for s in range(len(words) - len(goal) + 1)]
            if values and max(values) >= 0.8:
                out[key] = round(max(values), 6)
    return out


def corpus(seed=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "the", "of"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([3, 5, 9, 20, 40, 60]))) for i in range(40)] + [(90, ""), (91, None), (92, "rare Word"), (93, "a a a a a a a a")]
    docs = []
    for i in range(200):
        parts = [text(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            words = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3 and len(words) > 3:
                words = words[: rng.randint(3, len(words))]
            parts += [" ".join(words).upper() if rng.random() < 0.3 else "\n".join(words), text(rng.randint(0, 50))]
        docs.append((i, " ".join(parts)))
    docs += [(500, None), (501, ""), (502, "x RARE word"), (503, "a " * 3000), (503, "a " * 3000), (None, items[3][1])]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, similarity double").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.similarity) for r in contaminated(frame, bench).collect()), key=str)
    want = sorted(((d, k, v) for d, t in docs for k, v in slow(t, items).items()), key=str)
    assert got == want and len(want) > 60
    kept = sorted((r.doc_id for r in clean(frame, bench).collect()), key=str)
    assert kept == sorted((d for d, t in docs if not slow(t, items)), key=str)
    assert clean(frame, bench).columns == frame.columns


@pytest.mark.parametrize("empty", ["documents", "benchmark"])
def test_empty_tables(spark, empty):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").limit(0 if empty == "documents" else 1)
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string").limit(0 if empty == "benchmark" else 1)
    assert contaminated(docs, bench).count() == 0 and clean(docs, bench).count() == docs.count()


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 2**63, 50, dtype=np.uint64)
    index = SizeIndex(list(range(50)))
    index.build(items.tolist(), RADIUS)
    windows = []
    for _ in range(2000):
        flips = rng.choice(64, rng.integers(0, 28), replace=False)
        windows.append(int(items[rng.integers(50)]) ^ sum(1 << int(b) for b in flips))
    windows = np.array(windows, dtype=np.uint64)
    got = set(zip(*(x.tolist() for x in index.candidates(windows, RADIUS))))
    want = {(int(w), int(i)) for w, i in np.argwhere(np.bitwise_count(windows[:, None] ^ items[None, :]) <= RADIUS)}
    assert got == want


def test_sliding_fingerprints():
    hashes = np.random.default_rng(1).integers(0, 2**63, 30, dtype=np.uint64)
    for s, value in enumerate(window_fingerprints(hashes, 7)):
        assert value == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[s : s + 7]) > 7)


def test_index_of_no_items():
    assert ItemIndex([], []).matches("a b") == []


def whole_or_windows(text, items):
    """``slow`` with a text shorter than an item as one whole window."""
    words, out = words_of(text), slow(text, items)
    for key, item in items:
        goal = words_of(item)
        if 0 < len(words) < len(goal) and (value := weighted_similarity(words, goal)) >= 0.8:
            out[key] = round(value, 6)
    return out


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(11)
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(300)] + ["a"] * 40, k=n))) for i, n in enumerate([5, 6, 9, 20, 30, 30, 50, 60] * 3)]
    texts = []
    for _, item in items:
        words = item.split()
        for cut in range(1, min(12, len(words))):
            at = rng.randrange(len(words))
            texts += [" ".join(words[:-cut]), " ".join(words[cut:]).upper(), " ".join(words[:at] + words[at + 1 :])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = contaminated(docs, bench).collect()
    got = sorted((r.doc_id, r.item_id, r.similarity) for r in found)
    want = sorted((d, k, v) for d, t in enumerate(texts) for k, v in whole_or_windows(t, items).items())
    assert got == want and len(want) > sum(len(slow(t, items)) for t in texts) + 50
    assert all(0 <= r.start < r.end <= len(texts[r.doc_id].split()) for r in found)
    assert {r.doc_id for r in clean(docs, bench).collect()} == set(range(len(texts))) - {d for d, _, _ in want}
