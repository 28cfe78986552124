import random
import re
from itertools import permutations

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from rankmill.llm.filter_audit import FILTERS, ORDERS, SQL, audit, failure_sets, interval_edges, lehmer_rank

NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
DDL = "doc_id long, text string, source string, bits int, digest string"


def fails(doc_id, text, docs):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(
        letter
        for letter, hit in zip(
            FILTERS,
            (
                len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                re.search("[#$%&*|]", text), doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, *_ in docs),
            ),
            strict=True,
        )
        if hit
    )


def slow(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    rows, shapley = {}, {}
    for part in {s or "" for _, _, s, *_ in docs}:
        mine = [(d, fails(d, t or "", docs)) for d, t, s, *_ in docs if (s or "") == part]
        for order in map("".join, permutations(FILTERS)):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                out = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(out)
                rows[part, order, step] = [
                    len(left), len(out), sum(letter in f for _, f in mine) - len(out), sum(f == letter for _, f in mine),
                    sum(d in good for d, _ in out), sum(d in toxic for d, _ in out),
                ]
    return sorted((*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in rows.items())


def corpus():
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(260):
        text = " ".join(rng.choices(pool[: rng.choice((12, 80, 400))], k=rng.choice((0, 3, 49, 50, 51, 90))))
        text = text.upper() if rng.random() < 0.2 else text
        text = text + rng.choice(("", "", "", " | #", "\x0b\x85  é"))
        docs.append((i, rng.choice([text, text, docs[-1][1] if docs else "x", "same words of a large group"]), rng.choice(["s0"] * 4 + ["s1", None, ""]), 9, "d"))
    extra = [(3, docs[3][1], "s1"), (3, "other", None), (None, None, "s2"), (None, "", "s2"), (900, "", "s3"), (901, None, "s3"), (902, "long " * 60000, "s3")]
    docs += [(*x, None, None) for x in extra]
    labels = [(rng.randrange(270), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(200)] + [(None, 1, 1)]
    return docs, labels


def test_ranks_and_intervals():
    assert [lehmer_rank(o) for o in ORDERS] == list(range(120)) and ORDERS == sorted(ORDERS)
    removed = {}
    for bits, step, rank, sign in interval_edges():
        for r in range(rank, 120):
            removed[bits, r, step] = removed.get((bits, r, step), 0) + sign
    for bits in range(1, 32):
        for rank, order in enumerate(ORDERS):
            first = next(i for i, x in enumerate(order, 1) if bits >> FILTERS.index(x) & 1)
            assert [removed.get((bits, rank, s), 0) for s in range(1, 6)] == [int(s == first) for s in range(1, 6)]


def test_equals_replay_of_all_orders(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, DDL).repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = audit(failure_sets(frame, known))
    assert got.columns == list(NAMES)
    assert sorted(map(tuple, got.collect())) == slow(docs, labels)


def test_sql_equals_replay():
    docs, labels = corpus()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([d[:3] for d in docs], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    rows = con.sql(SQL.format(documents="documents", labels="labels"))
    assert sorted(rows.project(", ".join(NAMES)).fetchall()) == slow(docs, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DDL)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(failure_sets(docs, labels)).count() == 0
    one = audit(failure_sets(spark.createDataFrame([(1, None, None, None, None)], DDL), labels)).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {r.kept for r in one if r.step == 5} == {0}
