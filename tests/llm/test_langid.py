import random

import numpy as np

from rankmill.llm.langid import SPAN, Network, identify, split_windows


def corpus(n=240):
    rng = random.Random(4)
    parts = {"aa": ["kal", "tor", "min", "zu"], "bb": ["ñe", "ció", "ra", "los"], "cc": ["wh", "ing", "the", "ea"]}
    rows = []
    for i in range(n):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 120))), lang))
    return rows


def test_windows_cover_whole_texts():
    texts = [b"", b"a" * SPAN, b"b" * (2 * SPAN + 3), b"c"]
    owner, windows, lengths = split_windows(texts)
    assert owner.tolist() == [1, 2, 2, 2, 3] and lengths.tolist() == [SPAN, SPAN, SPAN, 3, 1]
    rebuilt = [b"".join(windows[i, : lengths[i]].tobytes() for i in np.flatnonzero(owner == k)) for k in range(4)]
    assert rebuilt == texts


def test_gradients_match_finite_differences():
    net, rng = Network.fresh(["x", "y"], hidden=3), np.random.default_rng(0)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    data, target, valid = rng.integers(0, 256, (5, 4)), np.array([0, 1, 1, 0]), np.ones((5, 4))
    valid[3:, 1] = 0
    _, grads = net.gradients(data, target, valid)
    for name, at in (("f_gates", (1, 2)), ("f_new", (0, 1)), ("b_gates", (2, 5)), ("b_new", (1, 1)), ("out", (4, 0)), ("f_in", (data[2, 0], 4)), ("b_in", (data[0, 3], 0))):
        losses = []
        for sign in (1, -1):
            net.weights[name][at] += sign * 1e-2
            losses.append(net.gradients(data, target, valid)[0])
            net.weights[name][at] -= sign * 1e-2
        assert abs((losses[0] - losses[1]) / 2e-2 - grads[name][at]) < 2e-4


def test_held_out_accuracy_and_special_texts(spark):
    rows = corpus() + [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !! 34", "aa"), (1003, "ciórañe " * 3000, None), (None, "theing thewh ea", "cc")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, lang_pred string").repartition(4)
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[:240] if got[r[0]].held_out]
    assert held and sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "bb" and 0 < got[1003].score <= 1
    assert identify(docs.limit(0)).count() == 0
    nothing = identify(docs.where("lang is null")).collect()
    assert [r.lang_pred for r in nothing] == ["und"]
