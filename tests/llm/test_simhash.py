import random

import pytest
import xxhash

from rankmill.llm.simhash import fingerprint, links, mask_table, near_duplicates


def slow_fingerprint(text, width=4):
    words, cur = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            words, cur = (words + [cur] if cur else words), ""
        else:
            cur += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, radius):
    """values: [(id, fingerprint)]; smallest id reachable by links."""
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i][1] ^ values[j][1]).count("1") <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(values):
        least[root(i)] = min(least.get(root(i), key), key)
    return [least[root(i)] for i in range(len(values))]


def texts(seed=1, n=120):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(n // 3)]
    out = base + [t + " tail" for t in base] + base[:5] + ["", None, "  \n", "Éa b", "one", "x" * 5000 + " y" * 3000]
    return out


@pytest.mark.parametrize("text", ["", None, " \t\n", "A b C d", "a", "É é x y z w", "a b c d e a b c d e"])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_masks_cover_every_pair_within_the_radius():
    masks, rng = mask_table(4), random.Random(3)
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not diff & m for m in masks)


@pytest.mark.parametrize("bucket", [1024, 2])
def test_components_match_brute_force(spark, bucket):
    """A tiny bucket bound sends every crowded bucket through the midpoint path."""
    rows = [(i, t, "s", 5) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, __n int").repartition(5)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs, bucket=bucket).collect()}
    values = [(i, slow_fingerprint(t)) for i, t, _, _ in rows]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(values, slow_components(values, 4))}
    assert got == want


@pytest.mark.parametrize("bucket", [1024, 3])
def test_links_of_dense_fingerprints(spark, bucket):
    rng = random.Random(9)
    centre = rng.getrandbits(63)
    values = sorted({centre ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 7))) for _ in range(150)})
    edges = links(spark.createDataFrame([(v,) for v in values], "__fp long"), 4, bucket).collect()
    linked = slow_components([(v, v) for v in values], 4)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[root(a)] = root(b)
    assert len({(root(v), c) for v, c in zip(values, linked)}) == len(set(linked)) == len({root(v) for v in values})


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (None, "c d e f g")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == [(3, 3), (3, 3), (None, 3), (None, None)]
    assert near_duplicates(docs.limit(0)).count() == 0
