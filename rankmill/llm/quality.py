"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the
counts of all vote patterns estimates how often each labeller is right on good and on bad documents,
without any true label. The posterior of a document's pattern is its training label for a linear scorer over
hashed words and word shapes, which then scores the whole text of every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.common import hash_share

#: Frequent function words; fixed values.
STOPWORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their "
    "de la le les des et en un une du est que dans pour qui par sur pas au avec "
    "der die und den von zu das mit sich dem ein ist im nicht eine als auch es an auf "
    "el los del las por con una para al se su no lo"
).split()
#: Documents the scorer is trained on: a fixed upper bound.
TRAIN_ROWS = 4000
BUCKETS = 1 << 16
EPOCHS, RATE = 6, 4.0
#: Words whose weights a task remembers.
REMEMBERED = 300_000


LABELLERS = ("symbols", "upper", "repeats", "length", "word_length", "lines", "stopwords", "table", "echo")
VOTES = [f"vote_{k}" for k in LABELLERS]
_STOPWORDS = frozenset(STOPWORDS)


def _vote(good: bool, bad: bool) -> int | None:
    return 0 if bad else 1 if good else None


def echoes(words: list[str]) -> int:
    """Words that repeat the word before them."""
    return sum(map(eq, words, words[1:]))


def votes(text: str | None) -> tuple[int | None, ...]:
    """One vote per labeller on the whole text: 1 good, 0 bad, None no vote."""
    text = text or ""
    words = text.split()
    size, chars = max(1, len(words)), max(1, sum(map(len, words)))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = codes | 32
    latin = (folded >= 97) & (folded <= 122)
    letters = int(latin.sum() + (codes >= 0xC0).sum())
    upper = int(((codes >= 65) & (codes <= 90)).sum() + ((codes >= 0xC0) & (codes <= 0xDE)).sum()) / max(1, letters)
    symbols = 1 - min(1.0, (letters + int(((codes >= 48) & (codes <= 57)).sum())) / chars)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct, lone = len(set(words)) / size, len(set(lines)) / max(1, len(lines))
    stops = sum(map(_STOPWORDS.__contains__, text.lower().split())) / size
    mean, echo = chars / size, echoes(words) / size
    return (
        _vote(symbols < 0.08, symbols > 0.15), _vote(upper < 0.2, upper > 0.5),
        _vote(distinct > 0.5, distinct < 0.35) if 20 <= size <= 3000 else None,
        _vote(len(words) >= 40, len(words) < 8), _vote(3 < mean < 9, mean < 2.5 or mean > 11),
        _vote(lone > 0.9, lone < 0.6) if len(lines) >= 4 else None,
        _vote(stops > 0.12, stops < 0.03) if size >= 20 else None, 0 if words.count("|") > 0.2 * size else None,
        _vote(echo < 0.03, echo > 0.15) if size >= 8 else None,
    )


def pattern(found: tuple[int | None, ...]) -> str:
    return "".join("-" if v is None else str(v) for v in found)


@dataclass
class LabelModel:
    """Share of good documents, and per labeller the share of right votes on good and on bad ones."""

    prior: float
    on_good: np.ndarray
    on_bad: np.ndarray

    @staticmethod
    def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
        """``votes`` (patterns, labellers) in {1, 0, nan}; ``counts`` documents per pattern.

        Starts from the majority vote. A weak prior keeps every accuracy inside (0, 1) and, with the
        start, keeps good and bad from changing places.
        """
        cast = ~np.isnan(votes)
        good = np.where(cast, votes, 0.0)
        cast_count = cast.sum(axis=1)
        p = np.where(cast_count > 0, good.sum(axis=1) / np.maximum(1, cast_count), 0.5)
        model = LabelModel(0.5, np.full(votes.shape[1], 0.7), np.full(votes.shape[1], 0.7))
        for _ in range(rounds):
            weight = counts * p
            other = counts * (1 - p)
            model = LabelModel(
                float((weight.sum() + 1) / (counts.sum() + 2)),
                (weight @ good + 3.5) / (weight @ cast + 5), (other @ (cast - good) + 3.5) / (other @ cast + 5),
            )
            after = model.posterior(votes)
            if np.abs(after - p).max(initial=0) < 1e-7:
                break
            p = after
        return model

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for each vote pattern."""
        cast, good = ~np.isnan(votes), np.nan_to_num(votes)
        yes = cast * (good * np.log(self.on_good) + (1 - good) * np.log(1 - self.on_good))
        no = cast * (good * np.log(1 - self.on_bad) + (1 - good) * np.log(self.on_bad))
        odds = np.log(self.prior / (1 - self.prior)) + yes.sum(axis=1) - no.sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def label_model(documents: DataFrame, text: str = "text") -> tuple[LabelModel, dict[str, float]]:
    """The label model, and the posterior by vote pattern.

    Patterns are counted over all documents. There are at most 3 to the power of the labellers of them, so
    their counts and posteriors are held by the driver.
    """

    @F.pandas_udf("string")
    def patterns(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: pattern(votes(x)), na_action=None)

    counted = documents.select(patterns(F.col(text)).alias("pattern")).groupBy("pattern").count().toPandas()
    table = np.array([[{"1": 1.0, "0": 0.0}.get(c, np.nan) for c in p] for p in counted["pattern"]]).reshape(-1, len(LABELLERS))
    model = LabelModel.fit(table, counted["count"].to_numpy(dtype=float))
    return model, dict(zip(counted["pattern"], model.posterior(table).tolist()))


#: Stands for a word that repeats the word before it.
ECHO = "\x00"
_SHAPE = re.compile(r"(.)\1+")


def _shape(word: str) -> str:
    kinds = "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in word)
    return _SHAPE.sub(r"\1", kinds)


def features(word: str) -> tuple[int, int]:
    """Hash buckets of a word and of its shape."""
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in ("w" + word.lower(), "s" + _shape(word)))


class Scorer(dict):
    """Linear scorer; as a mapping it gives the weight of a word and remembers it."""

    def __init__(self, weights: np.ndarray, bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __reduce__(self):
        return Scorer, (self.weights, self.bias)

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = float(sum(self.weights[i] for i in features(word)))
        return value

    def score(self, text: str | None) -> float:
        """Probability of good; 0 for a text without words."""
        words = (text or "").split()
        if not words:
            return 0.0
        odds = self.bias + (sum(map(self.__getitem__, words)) + echoes(words) * self[ECHO]) / len(words)
        return float(1 / (1 + np.exp(-np.clip(odds, -50, 50))))

    @staticmethod
    def fit(texts: list[str], target: np.ndarray, seed: int = 2) -> Scorer:
        rng, weights, bias = np.random.default_rng(seed), np.zeros(BUCKETS), 0.0
        split = [t.split() for t in texts]
        rows = [np.array([i for w in words + [ECHO] * echoes(words) for i in features(w)], dtype=np.int64) for words in split]
        squares = np.full(BUCKETS, 1e-6)
        for _ in range(EPOCHS):
            for k in rng.permutation(len(rows)):
                row = rows[k]
                if not len(row):
                    continue
                ids, count = np.unique(row, return_counts=True)
                share = count / len(split[k])
                slope = target[k] - 1 / (1 + np.exp(-np.clip(bias + weights[ids] @ share, -50, 50)))
                step = slope * share
                squares[ids] += step * step
                weights[ids] += RATE * step / np.sqrt(squares[ids] + 0.01)
                bias += 0.02 * slope
        return Scorer(weights, bias)


def classify(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """All columns of ``documents`` but the text, plus votes, ``p_good``, ``score`` and ``good``.

    ``p_good`` is the label model's posterior, ``score`` the scorer's probability (0 without words) and
    ``good`` whether it is 0.5 or more. The scorer is fitted on at most ``rows`` documents drawn by the hash
    of their id. Null texts count as empty. Every row comes back once; an empty table gives no rows.
    Columns named like an output are replaced.
    """
    keep = [c for c in documents.columns if c not in (text, "p_good", "score", "good", *VOTES)]
    _, posterior = label_model(documents, text)
    total = max(1, documents.count())
    drawn = documents.where(F.length(text) > 0).where(hash_share(F.col(doc_id).cast("string")) < min(1.0, 1.1 * rows / total))
    sample = [r[0] for r in drawn.select(text).limit(rows).collect()]
    scorer = Scorer.fit(sample, np.array([posterior.get(pattern(votes(x)), 0.5) for x in sample]))
    held = documents.sparkSession.sparkContext.broadcast((scorer, posterior))

    @F.pandas_udf(", ".join(f"{v} int" for v in VOTES) + ", p_good double, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer, posterior = held.value
        for batch in batches:
            found = [votes(x) for x in batch]
            out = pd.DataFrame(found, columns=VOTES, dtype="Int32")
            out["p_good"] = [posterior[pattern(f)] for f in found]
            out["score"] = [scorer.score(x) for x in batch]
            yield out

    judged = documents.select(*keep, judge(F.col(text)).alias("__judged"))
    return judged.select(*keep, "__judged.*", (F.col("__judged.score") >= 0.5).alias("good"))
