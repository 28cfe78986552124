import random

import numpy as np
import pytest

from rankmill.llm import simhash_similar
from rankmill.llm.simhash import majority
from rankmill.llm.simhash_similar import keep_one, simhash_links, similar_documents


def sets(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def classes(texts):
    """Smallest index reachable by links at a similarity of 0.8."""
    groups, s = list(range(len(texts))), [sets(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (not s[i] and not s[j]) or (s[i] | s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])):
                a, b = groups[i], groups[j]
                groups = [min(a, b) if g in (a, b) else g for g in groups]
    return groups


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    out = []
    for _ in range(n):
        base = rng.choices(words, k=rng.randint(60, 300))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(max(1, len(base) // 80)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    return out + out[:9] + ["", None, " ", "one two", "one two", "long " * 30000]


@pytest.mark.parametrize("small", [False, True])
def test_one_of_each_class_stays(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 2), ("VERIFIED", 2)):
            monkeypatch.setattr(simhash_similar, name, value)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "r", 1, "b") for i, t in enumerate(texts)], "doc_id long, text string, root string, copies int, best string").repartition(4)
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == set(classes(texts))


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "x"), (None, "x"), (7, "y")], "doc_id long, text string")
    assert sorted(map(tuple, keep_one(docs).collect()), key=str) == [(4, "a b c d e f"), (7, "y"), (None, "x")]
    assert keep_one(docs.limit(0)).count() == 0 and similar_documents(docs.limit(0)).count() == 0


def edited(seed=4, n=60):
    """Pairs whose similarity is 0.8 to 0.85 by one cut, appended or replaced block, half of them with repeats."""
    rng = random.Random(seed)
    words, out = [f"w{i}" for i in range(5000)], []
    while len(out) < 2 * n:
        base = rng.choices(words, k=rng.randint(150, 500))
        if len(out) % 4:
            base[50:50] = ["again"] * 60 + base[:20] * 3
        size = rng.randint(len(base) // 12, len(base) // 4)
        at, new = rng.randrange(len(base) - size), rng.choices(words, k=size)
        copy = rng.choice([base[:-size], base + new, base[:at] + new + base[at + size :]])
        a, b = sets(" ".join(base)), sets(" ".join(copy))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            out += [" ".join(base), " ".join(copy)]
    return out


@pytest.mark.parametrize("limits", [None, (1, 1)])
def test_no_edited_block_is_missed(spark, monkeypatch, limits):
    if limits:
        monkeypatch.setattr(simhash_similar.prefix_links, "__defaults__", (0.8, *limits))
    texts = edited(n=6 if limits else 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in keep_one(docs).collect()} == set(range(0, len(texts), 2))


def test_common_passages_do_not_hide_links(spark, monkeypatch):
    monkeypatch.setattr(simhash_similar, "COMMON", 0.001)
    passage = " ".join(f"p{i}" for i in range(120))
    texts = [f"{passage} {t}" for t in edited(5, 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in keep_one(docs).collect()} == set(classes(texts))


def test_simhash_tables_meet_light_edits(spark):
    rng = random.Random(6)
    prints = {}
    for i in range(0, 200, 2):
        words = rng.choices([f"w{i}" for i in range(3000)], k=400)
        prints[i] = majority(np.unique(simhash_similar.shingles(" ".join(words))))
        words[rng.randrange(400)] = "other"
        prints[i + 1] = majority(np.unique(simhash_similar.shingles(" ".join(words))))
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    for crowd in (None, 10**6):
        found = {(r.a, r.b) for r in simhash_links(spark.createDataFrame(rows, "node long, fp long"), crowd).collect()}
        assert len(found & {(i, i + 1) for i in range(0, 200, 2)}) >= 95
    assert all((prints[a] ^ prints[b]).bit_count() <= simhash_similar.RADIUS for a, b in found)


def test_pairs_that_share_a_passage_are_not_all_verified(spark, monkeypatch):
    rng, verified, checked = random.Random(7), [], simhash_similar._verified
    passage = [f"p{i}" for i in range(500)]
    texts = [" ".join(passage + rng.choices([f"w{i}" for i in range(5000)], k=200)) for _ in range(30)]
    texts += [texts[0] + " more", texts[0] + " or less"]
    monkeypatch.setattr(simhash_similar, "_verified", lambda pairs, *rest: verified.append(pairs.count()) or checked(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in keep_one(docs).collect()} == set(range(30))
    assert 2 <= sum(verified) <= 3
