import os

import numpy as np
import pytest

from rankmill.llm.quality import LABELLERS, LabelModel, Scorer, classify, pattern, votes

SF_DIR = os.environ.get("RANKMILL_SF_DIR", "/root/testdata/sf0.01")


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(40000) < 0.7
    on_good, on_bad = np.array([0.9, 0.8, 0.75, 0.6, 0.95]), np.array([0.85, 0.7, 0.9, 0.65, 0.6])
    right = rng.random((len(truth), 5)) < np.where(truth[:, None], on_good, on_bad)
    votes = np.where(right, truth[:, None], ~truth[:, None]).astype(float)
    votes[rng.random(votes.shape) < 0.3] = np.nan
    model = LabelModel.fit(votes, np.ones(len(votes)))
    assert abs(model.prior - 0.7) < 0.03 and np.abs(model.on_good - on_good).max() < 0.04 and np.abs(model.on_bad - on_bad).max() < 0.06
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.85


def test_patterns_weigh_like_their_documents():
    votes = np.array([[1, 1, np.nan], [0, 0, 1], [np.nan] * 3])
    a = LabelModel.fit(votes, np.array([3.0, 2.0, 1.0]))
    b = LabelModel.fit(np.repeat(votes, [3, 2, 1], axis=0), np.ones(6))
    assert np.allclose(a.posterior(votes), b.posterior(votes))


def test_scorer_generalises():
    rng = np.random.default_rng(1)
    make = lambda good: " ".join(rng.choice(["the", "house", "of", "green", "garden"] if good else ["xx##", "!!", "BUY", "NOW!!", "of"], 30))
    target = np.array([float(i % 2) for i in range(200)])
    model = Scorer.fit([make(t) for t in target], target)
    assert all((model.score(make(i % 2)) > 0.5) == bool(i % 2) for i in range(100)) and model.score(None) == model.score(" ") == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_agrees_with_given_labels(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = classify(docs).join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").toPandas()
    assert ((got["score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.85


def test_special_texts(spark):
    rows = [(1, None, 3), (2, "", 3), (3, "The house of the garden is green. " * 20, 3), (3, "The house of the garden is green. " * 20, 3), (None, "## !! ##", 3), (5, "x " * 30000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = classify(docs).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and 0 <= r.p_good <= 1 for r in got)
    assert all(r.score == 0 and not r.good for r in got if r.doc_id in (1, 2))
    assert classify(docs.limit(0)).count() == 0
    assert pattern(votes(None)) == pattern(votes("")) and votes("a | b | c | d |")[LABELLERS.index("table")] == 0
