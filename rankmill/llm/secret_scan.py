"""Secret scan with DataFrame functions only.

Fixed patterns give the base spans. Character Markov models add more: bigram models of random strings
(the values the base patterns find) and of ordinary identifiers (other words of sampled documents) are
compared by their log-likelihood ratio on every long token outside the base spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.llm.common import hash_share

#: Kind, pattern, group that holds the value, least characters of the value; kinds in this order.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
MARKOV = "markov"
#: Characters of a token that the models judge, and its least length.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_-]{3,}"
#: Upper bounds of the training sample (documents in the mean): secret values, the documents they are taken
#: from, and documents whose other words are ordinary.
TRAIN_VALUES = 4000
SECRET_DOCUMENTS = 20_000
TRAIN_DOCUMENTS = 1000
#: Log-likelihood ratio, in nats, from which a token counts as random.
MIN_RATIO = 12.0
#: Characters that tokens may hold, about, and the prior count of each.
SYMBOLS = 66
SMOOTHING = 0.5
#: Weight of the learned bigrams. Random strings keep more of the uniform share, as secrets in alphabets
#: that the sample lacks are random too.
RANDOM_WEIGHT = 0.25
ORDINARY_WEIGHT = 0.6
#: Occurrences of a character at which its bigrams have half of their weight.
RARE = 50
_SYMBOLS = 128
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans(text: Column, kind: str, rank: int, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has ``least`` characters or more.

    The pieces between the matches and the matches themselves alternate in the text, so the running sum
    of their lengths gives the positions.
    """
    regex = F.lit(pattern)
    step = F.struct(
        F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, regex, F.lit(0)).alias("found"),
        F.regexp_extract_all(text, regex, F.lit(group)).alias("values"),
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def add(state: Column, item: Column) -> Column:
        start = state["at"] + F.length(item["pieces"])
        end = start + F.length(item["found"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(
            end.alias("at"),
            F.when(F.length(item["values"]) >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    matched = F.arrays_zip(step["pieces"], step["found"], step["values"])
    rows = F.filter(matched, lambda item: item["found"].isNotNull())
    return F.when(F.length(F.regexp_extract(text, pattern, 0)) > 0, F.aggregate(rows, empty, add, lambda s: s["out"])).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    return F.concat(*[spans(text, kind, rank, pattern, group, least) for rank, (kind, pattern, group, least) in enumerate(BASE)])


def _values(text: Column) -> Column:
    parts = [
        F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v, least=least: F.length(v) >= least)
        for _, pattern, group, least in BASE
    ]
    return F.concat(*parts)


def _bigrams(tokens: DataFrame, random: bool) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substr(F.col("token"), i, F.lit(2)))
    return tokens.where(F.length("token") > 1).select(F.explode(pairs).alias("pair"), F.lit(random).alias("random"))


def train(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", values: int = TRAIN_VALUES, sample: int = TRAIN_DOCUMENTS) -> list[float]:
    """The table of log-likelihood ratios by (character, next character), 128 x 128 values.

    Positive samples are base values of at most ``SECRET_DOCUMENTS`` documents drawn by the hash of their id,
    no more than ``values``; negative ones all words of at most ``sample`` of those documents, with base
    matches cut out. The bounds are fixed and only counts reach the driver. Without any sample the ratios
    are zero and nothing is added.
    """
    total = max(1, documents.count())
    body, key = F.coalesce(F.col(text), F.lit("")), hash_share(F.col(doc_id).cast("string"))
    secret = documents.where(key < min(1.0, SECRET_DOCUMENTS / total)).select(F.explode(_values(body)).alias("token"), key.alias("place")).orderBy("place", "token").limit(values).select("token")
    some = documents.where(key < min(1.0, sample / total)).select(body.alias("body"))
    clean = F.col("body")
    for _, pattern, _, _ in BASE[:2]:
        clean = F.regexp_replace(clean, pattern, " ")
    clean = F.regexp_replace(clean, r"[0-9a-f]{24,}", " ")
    plain = some.select(F.explode(F.regexp_extract_all(clean, F.lit(IDENTIFIER), F.lit(0))).alias("token"))
    counted = _bigrams(secret, True).union(_bigrams(plain, False)).where(r"pair rlike '^[\\x00-\\x7f]{2}$'").groupBy("random", "pair").count()
    counts = {(r["random"], ord(r["pair"][0]), ord(r["pair"][1])): r["count"] for r in counted.collect()}
    totals: dict = {}
    singles: dict = {}
    for (kind, a, b), n in counts.items():
        totals[kind, a] = totals.get((kind, a), 0) + n
        singles[kind, b] = singles.get((kind, b), 0) + n
    sums = {kind: sum(n for (k, *_), n in counts.items() if k is kind) for kind in (True, False)}

    def share(random: bool, a: int, b: int) -> float:
        """Bigram share mixed with a uniform share (random strings) or the character's own (identifiers)."""
        rest = 1 / SYMBOLS if random else (singles.get((False, b), 0) + SMOOTHING) / (sums[False] + SMOOTHING * SYMBOLS)
        total = totals.get((random, a), 0)
        weight = (RANDOM_WEIGHT if random else ORDINARY_WEIGHT) * total / (total + RARE)
        return (1 - weight) * rest + weight * counts.get((random, a, b), 0) / max(1, total)

    if not counts:
        return [0.0] * _SYMBOLS**2
    return [math.log(share(True, a, b) / share(False, a, b)) for a in range(_SYMBOLS) for b in range(_SYMBOLS)]


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of random against ordinary for an ASCII token, in time proportional to its length."""
    weights = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("total"))

    def add(state: Column, letter: Column) -> Column:
        code = F.ascii(letter)
        weight = F.when(state["last"] >= 0, F.get(weights, state["last"] * _SYMBOLS + code)).otherwise(F.lit(0.0))
        return F.struct(code.alias("last"), (state["total"] + weight).alias("total"))

    return F.aggregate(F.filter(F.split(token, ""), lambda x: x != ""), start, add, lambda state: state["total"])


def scan(documents: DataFrame, table: list[float], doc_id: str = "doc_id", text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """(doc_id, base, added) for every row; base and added are sorted arrays of (start, rank, kind, end).

    Positions are code points, the end exclusive. Null texts count as empty and give empty arrays. Added
    spans never overlap base spans. Repeated rows come back repeated; an empty table gives no rows; other
    columns are ignored.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.select("doc_id", "body", F.array_sort(base_spans(F.col("body"))).alias("base"), spans(F.col("body"), MARKOV, len(BASE), TOKEN).alias("tokens"))
    apart = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    rows = rows.withColumn("tokens", apart)
    token = lambda t: F.substr(F.col("body"), t["start"] + 1, t["end"] - t["start"])
    added = F.filter("tokens", lambda t: ratio(token(t), table) >= min_ratio)
    return rows.select("doc_id", "base", added.alias("added"))


def joined(found: Column) -> Column:
    """Spans as kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind, *_ in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_markov"),
    )
