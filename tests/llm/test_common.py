"""Connected components against union-find."""

import random

import pytest

from rankmill.llm.common import connected_components


def brute(pairs):
    parent = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a in parent and b in parent and a != b and a is not None:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


def shuffled_chain(n):
    names = random.Random(3).sample(range(10 * n), n)
    return list(zip(names, names[1:]))


RANDOM = random.Random(7)
GRAPHS = {
    "chain in order": [(i, i + 1) for i in range(40)],
    "chain in any order": shuffled_chain(60),
    "star": [(500, i) for i in range(400, 500)] + [(500, 501)],
    "sparse": [(RANDOM.randrange(150), RANDOM.randrange(150)) for _ in range(110)],
    "nulls, self links and repeats": [(1, None), (None, 2), (3, 3), (4, 5), (5, 4), (4, 5), (-6, 5)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_match_union_find(spark, name):
    edges = spark.createDataFrame(GRAPHS[name], "l long, r long").repartition(3)
    found = [tuple(r) for r in connected_components(edges, "l", "r").select("node", "root").collect()]
    assert len(found) == len(set(found))
    assert dict(found) == brute(GRAPHS[name])


def test_no_edges_give_no_rows(spark):
    assert connected_components(spark.createDataFrame([], "l long, r long"), "l", "r").count() == 0
