"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows of ``SPAN`` bytes, starting from a zero state in each, once from
either end. Every byte position gets a distribution over the languages; a document's distribution is the
mean over the positions of all its windows. Training is plain numpy: cross-entropy at every position,
backpropagation through time, Adam.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.llm.common import hash_share, slices

#: Bytes of one window.
SPAN = 64
#: Training rows per language, an upper bound whatever the size of the table.
TRAIN_ROWS = 400
#: Most windows of one training row, drawn over its whole length.
TRAIN_WINDOWS = 6
HIDDEN = 12
UNKNOWN = "und"
#: Windows that go through the network at once.
BLOCK = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Two gated recurrent layers (forwards, backwards) and one linear read-out per position."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        weights: dict[str, np.ndarray] = {}
        for way in "fb":
            weights[f"{way}_in"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            weights[f"{way}_gates"] = rng.normal(0, 0.3, (hidden, 2 * hidden)).astype(np.float32)
            weights[f"{way}_new"] = rng.normal(0, 0.3, (hidden, hidden)).astype(np.float32)
        weights["out"] = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        weights["bias"] = np.zeros(len(languages), dtype=np.float32)
        return Network(languages, weights)

    def states(self, data: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (span, rows, hidden) for byte columns ``data`` (span, rows)."""
        table, gates, new = (self.weights[f"{way}_{k}"] for k in ("in", "gates", "new"))
        hidden = new.shape[0]
        out = np.empty((*data.shape, hidden), dtype=np.float32)
        h = np.zeros((data.shape[1], hidden), dtype=np.float32)
        for t in range(len(data)) if way == "f" else range(len(data) - 1, -1, -1):
            x = table[data[t]]
            rz = _sigmoid(x[:, : 2 * hidden] + h @ gates)
            r, z = rz[:, :hidden], rz[:, hidden:]
            rh = r * h
            n = np.tanh(x[:, 2 * hidden :] + rh @ new)
            if keep is not None:
                keep.append((t, h, r, z, rh, n))
            h = n + z * (h - n)
            out[t] = h
        return out

    def _read(self, data: np.ndarray, way: str, logits: np.ndarray) -> None:
        """Add one direction's read-out of byte columns ``data`` to ``logits`` (span, languages, rows).

        The same steps as ``states``, with rows side by side and in buffers that are used again; states are not
        kept, and the halves of the sigmoids are in the weights.
        """
        hidden, rows = self.weights["f_new"].shape[0], data.shape[1]
        out = np.ascontiguousarray((self.weights["out"][:hidden] if way == "f" else self.weights["out"][hidden:]).T)
        half = np.r_[np.full(2 * hidden, 0.5, np.float32), np.ones(hidden, np.float32)]
        table = np.ascontiguousarray((self.weights[f"{way}_in"] * half).T)
        gates, new = np.ascontiguousarray(self.weights[f"{way}_gates"].T) * np.float32(0.5), np.ascontiguousarray(self.weights[f"{way}_new"].T)
        h, x = np.zeros((hidden, rows), np.float32), np.empty((3 * hidden, rows), np.float32)
        rz, n, rh, read = np.empty((2 * hidden, rows), np.float32), np.empty_like(h), np.empty_like(h), np.empty(logits.shape[1:], np.float32)
        for t in range(len(data)) if way == "f" else range(len(data) - 1, -1, -1):
            np.take(table, data[t], axis=1, out=x, mode="clip")
            np.matmul(gates, h, out=rz)
            rz += x[: 2 * hidden]
            np.tanh(rz, out=rz)
            rz *= np.float32(0.5)
            rz += np.float32(0.5)
            np.multiply(rz[:hidden], h, out=rh)
            np.matmul(new, rh, out=n)
            n += x[2 * hidden :]
            np.tanh(n, out=n)
            h -= n
            h *= rz[hidden:]
            h += n
            np.matmul(out, h, out=read)
            logits[t] += read

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Language probabilities (span, rows, languages) of every position."""
        logits = np.empty((len(data), len(self.languages), data.shape[1]), dtype=np.float32)
        logits[:] = self.weights["bias"][:, None]
        for way in "fb":
            self._read(data, way, logits)
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.transpose(0, 2, 1)

    def gradients(self, data: np.ndarray, target: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the valid positions and its gradients through time."""
        w, hidden, count = self.weights, self.weights["f_new"].shape[0], max(1, int(valid.sum()))
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.states(data, way, kept[way]) for way in "fb"], axis=2)
        logits = both @ w["out"] + w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        rows = np.arange(data.shape[1])
        loss = float(-(np.log(p[:, rows, target] + 1e-9) * valid).sum() / count)
        p[:, rows, target] -= 1
        p *= valid[:, :, None] / count
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        flat = p.reshape(-1, p.shape[2])
        grads["out"] = both.reshape(-1, both.shape[2]).T @ flat
        grads["bias"] = flat.sum(axis=0)
        for way, part in (("f", slice(0, hidden)), ("b", slice(hidden, None))):
            gates, new = w[f"{way}_gates"], w[f"{way}_new"]
            upper = p @ w["out"][part].T
            dh = np.zeros((data.shape[1], hidden), dtype=np.float32)
            for t, h, r, z, rh, n in reversed(kept[way]):
                dh = dh + upper[t]
                dn = dh * (1 - z) * (1 - n * n)
                drh = dn @ new.T
                drz = np.concatenate([drh * h * r * (1 - r), dh * (h - n) * z * (1 - z)], axis=1)
                grads[f"{way}_new"] += rh.T @ dn
                grads[f"{way}_gates"] += h.T @ drz
                np.add.at(grads[f"{way}_in"], data[t], np.concatenate([drz, dn], axis=1))
                dh = dh * z + drh * r + drz @ gates.T
        return loss, grads

    def fit(self, data: np.ndarray, target: np.ndarray, lengths: np.ndarray, epochs: int = 8, batch: int = 256, rate: float = 0.01, seed: int = 5) -> list[float]:
        """Adam over shuffled batches of windows; returns the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, losses = 0, []
        for _ in range(epochs):
            order, total = rng.permutation(len(target)), []
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                valid = (np.arange(data.shape[0])[:, None] < lengths[pick][None, :]).astype(np.float32)
                loss, grads = self.gradients(data[:, pick], target[pick], valid)
                total.append(loss)
                step += 1
                for k, g in grads.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.weights[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(total)))
        return losses

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Pooled language distribution (rows, languages) of whole byte texts; empty ones give zeros."""
        owner, windows, lengths = split_windows(texts)
        totals = np.zeros((len(texts), len(self.languages)))
        for i in range(0, len(owner), BLOCK):
            part, size = windows[i : i + BLOCK], lengths[i : i + BLOCK]
            p = self.positions(np.ascontiguousarray(part.T))
            p *= (np.arange(SPAN)[:, None] < size[None, :])[:, :, None]
            np.add.at(totals, owner[i : i + BLOCK], p.sum(axis=0))
        return totals / np.maximum(1, [len(x) for x in texts])[:, None]


def split_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bytes, valid bytes) of the consecutive windows that cover every text."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    counts = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(texts)), counts)
    padded = b"".join(x + bytes(-len(x) % SPAN) for x in texts)
    windows = np.frombuffer(padded, dtype=np.uint8).reshape(-1, SPAN)
    lengths = np.full(len(owner), SPAN)
    last = np.cumsum(counts)[sizes > 0] - 1
    lengths[last] = sizes[sizes > 0] - (counts[sizes > 0] - 1) * SPAN
    return owner, windows, lengths


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def train(documents: DataFrame, doc_id: str, text: str, lang: str, usable: Column, rows: int = TRAIN_ROWS, hidden: int = HIDDEN) -> Network | None:
    """A network fitted on at most ``rows`` usable documents per language; None if there are none.

    The sample takes documents by the hash of their id, at the rate that gives a little more than
    ``rows`` of a language, and no more than ``rows`` of those. From each, at most ``TRAIN_WINDOWS`` windows
    spread over the whole text are used. Tasks cut them and one task fits the network, so texts never reach
    the driver.
    """
    labelled = documents.where(usable & F.col(lang).isNotNull() & (F.length(text) > 0))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}  # one row per language
    languages = sorted(counts)
    if not languages:
        return None
    rates = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, 1.3 * rows / counts[k])))])
    windows_of = F.pandas_udf(_drawn_windows, "array<binary>")
    named = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("body"), hash_share(F.col(doc_id).cast("string")).alias("rank"))
    cut = named.where(F.col("rank") < rates[F.col("lang")]).select("lang", "rank", F.xxhash64("body").alias("tie"), windows_of("body").alias("windows"))
    # the rows of the smallest hashes of each language, whatever the partitions
    ranked = cut.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "tie"))).where(F.col("place") <= rows)
    sample = ranked.select(F.lit(0).alias("task"), "lang", "place", F.posexplode("windows").alias("at", "window"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["lang", "place", "at"])
        _, windows, lengths = split_windows(part["window"].tolist())
        network = Network.fresh(languages, hidden)
        network.fit(np.ascontiguousarray(windows.T), np.searchsorted(languages, part["lang"].to_numpy(str)), lengths)
        return pd.DataFrame([(k, list(w.shape), w.astype(np.float32).tobytes()) for k, w in network.weights.items()], columns=["name", "shape", "weights"])

    fitted = sample.groupBy("task").applyInPandas(fit, "name string, shape array<int>, weights binary").collect()  # one row per matrix
    return Network(languages, {r["name"]: np.frombuffer(r["weights"], dtype=np.float32).reshape(r["shape"]) for r in fitted})


def _drawn_windows(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """At most ``TRAIN_WINDOWS`` windows of each text, drawn over its whole length."""

    def drawn(data: bytes) -> list[bytes]:
        count = -(-len(data) // SPAN)
        rng = np.random.default_rng(zlib.crc32(data))
        return [data[i * SPAN : (i + 1) * SPAN] for i in sorted(rng.choice(count, min(count, TRAIN_WINDOWS), replace=False))]

    for batch in texts:
        yield pd.Series([drawn(_encode(x)) for x in batch], dtype=object)


def predict(documents: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``documents`` without ``text``, plus ``lang_pred`` and ``score`` (mean probability of that language).

    Null texts, texts without a letter, and every text when nothing could be learned give ``und`` and 0.
    Every row comes back once; other columns are kept, and columns named like the outputs are replaced.
    """

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = [], []
            for part in slices(iter([batch.to_frame("text")])):
                pooled = network.documents([_encode(x) for x in part["text"]])
                best = pooled.argmax(axis=1)
                names += [network.languages[i] for i in best]
                scores += pooled[np.arange(len(best)), best].clip(0, 1).tolist()
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    keep = [c for c in documents.columns if c not in (text, "lang_pred", "score")]
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    found = label(F.col(text)) if network else F.lit(None).cast("struct<lang_pred:string,score:double>")
    return documents.withColumn("__found", found).select(
        *keep,
        F.when(lettered, F.coalesce("__found.lang_pred", F.lit(UNKNOWN))).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(lettered, F.coalesce("__found.score", F.lit(0.0))).otherwise(F.lit(0.0)).alias("score"),
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the rows that are not held out and label all rows; see ``train`` and ``predict``.

    Returns the id, ``held_out``, ``lang_pred`` and ``score``. An empty table gives no rows.
    """
    network = train(documents, doc_id, text, lang, ~held_out(doc_id))
    rows = documents.select(doc_id, held_out(doc_id).alias("held_out"), F.col(text).alias("__text"))
    return predict(rows, network, "__text")
