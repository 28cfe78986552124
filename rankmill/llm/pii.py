"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans in other spellings.

The patterns find e-mail addresses, IP addresses, card and phone numbers in their plain forms. The field scores
whole candidate segments (how many digits, which groups and separators, checksum, what stands beside) and a
dynamic program over segments of a bounded number of tokens chooses boundaries and types together.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.common import hash_share, slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# The base patterns, written so that no start is tried twice; tests compare them with their plain form.
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Most tokens and characters of an added span, and the characters beside it that features look at.
MAX_TOKENS = 20
MAX_LENGTH = 90
BESIDE = 24
#: What an added span must hold; everywhere else the best labelling is "outside", so only surroundings of
#: these places are decoded.
TRIGGER = re.compile(r"[0-9@]|[\[({]\s?(?:at|dot)\s?[\])}]|\sdot\s", re.I)
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)
_AT = r"(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?|\sat\s)"
_DOT = r"(?:\s?\.\s?|\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?|\sdot\s)"
_MARK = re.compile(_AT, re.I)
#: Loose forms of each kind: the candidate segments.
FORMS = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*", re.I),
    "ip": re.compile(rf"[0-9]{{1,3}}(?:(?:{_DOT}|-)[0-9]{{1,3}}){{3}}", re.I),
    "card": re.compile(r"[0-9](?:[ ./_-]{0,3}[0-9]){11,18}"),
    "phone": re.compile(r"(?:\+|00)?[ (]?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}"),
}
#: Words before a span that name its kind (fixed values).
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon"),
}
_CUE = {kind: re.compile(rf"\b(?:{'|'.join(words)})\b", re.I) for kind, words in CUES.items()}

#: Bounds of the training sample: documents in the mean, windows taken from them, generated windows.
TRAIN_DOCUMENTS = 20_000
TRAIN_WINDOWS = 400
GENERATED = 900
EPOCHS = 25
RATE = 0.5
DECAY = 1e-3
#: Taken off the score of each candidate when decoding: the odds an added span must have.
MARGIN = 1.0


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end) of the fixed patterns, sorted; time grows with the length of the text."""
    found, end = [], 0
    for m in _HOST.finditer(text):
        before = text[max(end, text.rfind("@", 0, m.start()) + 1) : m.start()]
        size = len(before) - len(before.rstrip(_LOCAL))
        if size:
            end = m.end()
            found.append((m.start() - size, 0, "email", end))
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, "ip", m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37:
                digits = re.sub("[ -]", "", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, "card", m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                found.append((m.start(), 3, "phone", m.end()))
    return sorted(found)


def islands(text: str, taken: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens (start, end) that hold every span which could be added: around triggers, outside ``taken``."""
    first = 0
    for hole, after in [*sorted(taken), (len(text), len(text))]:
        zones: list[list[int]] = []
        for m in TRIGGER.finditer(text, first, max(first, hole)):
            low, high = max(first, m.start() - MAX_LENGTH), min(hole, m.end() + MAX_LENGTH)
            if zones and zones[-1][1] >= low:
                zones[-1][1] = high
            else:
                zones.append([low, high])
        for low, high in zones:
            # a zone that begins or ends inside a word leaves that word out
            while first < low < high and text[low - 1].isalnum() and text[low].isalnum():
                low += 1
            while low < high < hole and text[high - 1].isalnum() and text[high].isalnum():
                high -= 1
            tokens = [m.span() for m in _TOKEN.finditer(text, low, high)]
            if tokens:
                yield tokens
        first = max(first, after)


_BIAS, _DIGITS, _GROUPS, _FLAGS = 1, 21, 8, 30
FEATURES = _BIAS + _DIGITS + _GROUPS + _FLAGS


def features(text: str, start: int, end: int, kind: str) -> list[int]:
    """The features that hold for a whole segment, as positions."""
    segment = text[start:end]
    groups = re.findall("[0-9]+", segment)
    sizes = [len(g) for g in groups]
    count = sum(sizes)
    marks = re.sub(r"[0-9A-Za-z]+", " ", segment).split()
    left, right = text[start - 1 : start], text[end : end + 1]
    before = text[max(0, start - BESIDE) : start]
    flags = [
        segment[:1] == "+" or segment[:2] == "00", segment[:1] == "(" or segment[:2] == "+(", segment.count("(") == segment.count(")"), "@" in segment,
        bool(re.search(r"[\[({]\s?(?:at|dot)\s?[\])}]|\sdot\s", segment, re.I)), bool(re.search(r"\sat\s", segment, re.I)),
        len(set(marks)) <= 1, " " in segment, "-" in segment, "." in segment, "/" in segment, bool(re.search("[A-Za-z]", segment)),
        kind == "card" and luhn("".join(groups)), kind == "card" and sizes[:-1] == [4] * (len(sizes) - 1),
        sizes[-2:] == [3, 4], sizes[-3:] == [3, 3, 4], len(sizes) == 4 and all(int(g) <= 255 for g in groups if len(g) <= 3), any(len(g) > 1 and g[0] == "0" for g in groups),
        bool(re.search(rf"{_DOT}[A-Za-z]{{2,6}}$", segment, re.I)), bool(re.search(rf"{_DOT}", segment, re.I)),
        left.isalnum() or left == "_", right.isalnum() or right == "_", left != "" and left in "+@#$-./:,([", right != "" and right in "@%-/:+",
        right in (".", ",") and text[end + 1 : end + 2].isalnum(), bool(_CUE[kind].search(before)), any(c.search(before) for k, c in _CUE.items() if k != kind),
        bool(re.fullmatch(r"(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}).*", segment)), max(sizes, default=0) >= 7, bool(re.search(r"\s{2}", segment)),
    ]
    return [0, _BIAS + min(count, _DIGITS - 1), _BIAS + _DIGITS + min(len(groups), _GROUPS - 1)] + [_BIAS + _DIGITS + _GROUPS + i for i, on in enumerate(flags) if on]


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, list[int]]]:
    """(first token, token after the last, kind, features) of all segments that have the loose form of a kind."""
    low, high = tokens[0][0], tokens[-1][1]
    marks = [m.span() for m in _MARK.finditer(text, low, high)]
    opened = [a for a, _ in marks]
    digits = np.cumsum([0] + [b - a if "0" <= text[a] <= "9" else 0 for a, b in tokens]).tolist()
    out = []
    for i, (start, _) in enumerate(tokens):
        head = text[start]
        mark = bisect_right(opened, start)  # the first sign between name and host, if near
        number, word = head in "+(" or "0" <= head <= "9", head.isalnum() and mark < len(marks) and opened[mark] - start <= MAX_LENGTH
        if not (number or word):
            continue
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            end = tokens[j - 1][1]
            if end - start > MAX_LENGTH:
                break
            if not text[end - 1].isalnum():
                continue
            n = digits[j] - digits[i]
            if number and n > 19 and not word:
                break
            for kind in ("ip", "card", "phone") if number and n >= 4 else ():
                if FORMS[kind].fullmatch(text, start, end):
                    out.append((i, j, KINDS.index(kind), features(text, start, end, kind)))
            if word and marks[mark][1] < end and FORMS["email"].fullmatch(text, start, end) and TRIGGER.search(text, start, end):
                out.append((i, j, 0, features(text, start, end, "email")))
    return out


def scores(found: list[tuple[int, int, int, list[int]]], weights: np.ndarray) -> list[float]:
    return [float(weights[kind, on].sum()) for _, _, kind, on in found]


def best_path(n: int, found: list[tuple[int, int, int]], values: list[float]) -> list[int]:
    """Positions in ``found`` of the segments on the best labelling of ``n`` tokens.

    A labelling is a sequence of outside tokens (score 0) and segments; between two segments stands an outside
    token at least. Ties go to fewer and earlier segments.
    """
    ends: dict[int, list[int]] = {}
    for k, (_, j, *_) in enumerate(found):
        ends.setdefault(j, []).append(k)
    outside, inside, back = [0.0] * (n + 1), [-math.inf] * (n + 1), [-1] * (n + 1)
    came = [False] * (n + 1)  # whether the best labelling that ends outside came from a segment
    for j in range(1, n + 1):
        came[j] = inside[j - 1] > outside[j - 1]
        outside[j] = max(outside[j - 1], inside[j - 1])
        for k in ends.get(j, ()):
            score = outside[found[k][0]] + values[k]
            if score > inside[j]:
                inside[j], back[j] = score, k
    path, j, seg = [], n, inside[n] > outside[n]
    while j > 0:
        if seg:
            path.append(back[j])
            j, seg = found[back[j]][0], False
        else:
            seg = came[j]
            j -= 1
    return path[::-1]


def likelihood(n: int, found: list[tuple[int, int, int]], values: list[float], gold: set[int]) -> tuple[float, list[float]]:
    """Log-likelihood of the gold segments and the probability of every segment, by forward and backward sums."""
    starts: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    for k, (i, j, *_) in enumerate(found):
        starts.setdefault(i, []).append(k)
        ends.setdefault(j, []).append(k)
    add = lambda a, b: b if a == -math.inf else a if b == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))
    outside, inside = [0.0] * (n + 1), [-math.inf] * (n + 1)
    for j in range(1, n + 1):
        outside[j] = add(outside[j - 1], inside[j - 1])
        for k in ends.get(j, ()):
            inside[j] = add(inside[j], outside[found[k][0]] + values[k])
    total = add(outside[n], inside[n])
    # after[j]: all that follows when the next token may be anything; apart[j]: when it must be outside
    after, apart = [0.0] * (n + 1), [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        apart[i] = after[i + 1]
        after[i] = apart[i]
        for k in starts.get(i, ()):
            after[i] = add(after[i], values[k] + apart[found[k][1]])
    share = [math.exp(outside[i] + values[k] + apart[j] - total) for k, (i, j, *_) in enumerate(found)]
    return sum(values[k] for k in gold) - total, share


def fit(windows: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by kind and feature from (text, gold spans), by steps along the scaled gradient of the likelihood.

    A gold span that is no candidate is left out, as decoding cannot find it either.
    """
    cases = []
    for text, gold in windows:
        want = set(gold)
        for tokens in islands(text, []):
            found = candidates(text, tokens)
            if found:
                right = {k for k, (i, j, kind, _) in enumerate(found) if (tokens[i][0], tokens[j - 1][1], KINDS[kind]) in want}
                cases.append((len(tokens), found, right))
    weights = np.zeros((len(KINDS), FEATURES))
    squares = np.full_like(weights, 1e-6)
    order = random.Random(1)
    for _ in range(epochs):
        order.shuffle(cases)
        for at in range(0, len(cases), 50):
            step = -DECAY * weights * len(cases[at : at + 50])
            for n, found, right in cases[at : at + 50]:
                _, share = likelihood(n, found, scores(found, weights), right)
                for k, (_, _, kind, on) in enumerate(found):
                    step[kind, on] += (k in right) - share[k]
            squares += step**2
            weights += RATE * step / np.sqrt(squares)
    return weights


def _variant(kind: str, plain: str, rng: random.Random) -> str:
    """Another spelling of a span of the base patterns."""
    digits = re.sub("[^0-9]", "", plain)
    if kind == "phone":
        a, b, c = digits[-10:-7] or digits[:2], digits[-7:-4], digits[-4:]
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a} {b}{c}", f"00{digits[:2]} {a} {b}{c}", f"0{a}/{b}{c}"])
    if kind == "card":
        cut = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return rng.choice([".", "/", "  ", "_", " - "]).join(cut)
    if kind == "ip":
        return rng.choice(["[.]", "(.)", " . ", " dot ", "[dot]"]).join(plain.split("."))
    name, host = plain.split("@")
    at, dot = rng.choice([(" (at) ", "."), ("[at]", "."), (" at ", " dot "), (" @ ", " . "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("{at}", "."), (" @ ", ".")])
    return name + at + dot.join(host.split("."))


def _plain(kind: str, rng: random.Random) -> str:
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    if kind == "email":
        return rng.choice([f"{word()}.{number(2)}", word(), f"{word()}.{word()}", f"{word()}_{number(3)}"]) + "@" + rng.choice([f"{word()}.com", f"mail{number(1)}.{word()}.org", f"{word()}-{word()}.de"])
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "phone":
        return f"+{rng.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}"
    digits = str(rng.randint(3, 6)) + number(14)
    return digits + next(d for d in "0123456789" if luhn(digits + d))


def _other(rng: random.Random) -> str:
    """Numbers and signs that are no personal data."""
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    fake = number(16)
    fake = fake if not luhn(fake) else fake[:-1] + str((int(fake[-1]) + 1) % 10)
    return rng.choice([
        f"20{number(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}.0{rng.randint(1, 9)}.20{number(2)}", f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}",
        f"{number(1)},{number(3)}.{number(2)}", f"{rng.randint(1, 9)} {number(3)} {number(3)}", f"v{rng.randint(1, 9)}.{number(1)}.{number(1)}", f"Version {rng.randint(1, 9)}.{number(1)}.{number(1)}.{number(1)}",
        fake, " ".join(fake[i : i + 4] for i in range(0, 16, 4)), ".".join(fake[i : i + 4] for i in range(0, 16, 4)), f"19{number(2)}-20{number(2)}", f"@{''.join(rng.choices('abcdefgh', k=6))}", number(rng.randint(4, 24)),
        "".join(rng.choices("0123456789abcdef", k=40)), f"No. {number(5)}-{number(2)}", f"{number(3)}.{number(3)}.{number(3)} EUR", f"20{number(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)} {rng.randint(10, 23)}:{rng.randint(10, 59)}",
        f"{rng.randint(256, 999)}.{number(2)}.{number(2)}.{number(2)}", "look at this dot and that", f"see you at {number(2)}", f"ISBN 978-3-{number(2)}-{number(6)}-{number(1)}", f"{number(2)}/{number(2)}", f"({number(2)}) {number(3)}",
    ])


def generated(n: int, words: list[str], seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled windows: plain and other spellings of each kind, and look-alikes, between ``words``."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text, gold = " ".join(rng.choices(words, k=rng.randint(2, 6))) + " ", []
        for _ in range(rng.randint(1, 2)):
            kind = KINDS[(i + len(gold)) % len(KINDS)]
            if rng.random() < 0.5:
                text += f"{rng.choice(CUES[kind])}{rng.choice([': ', ' ', ' is '])}" if rng.random() < 0.4 else ""
                span = _plain(kind, rng)
                span = span if rng.random() < 0.25 else _variant(kind, span, rng)
                gold.append((len(text), len(text) + len(span), kind))
            else:
                span = _other(rng)
            text += span + rng.choice([" ", ". ", ", ", "\n", "!! "]) + " ".join(rng.choices(words, k=rng.randint(2, 5))) + " "
        out.append((text, gold))
    return out


def sampled_windows(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", windows: int = TRAIN_WINDOWS) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """At most ``windows`` windows of about ``TRAIN_DOCUMENTS`` documents, labelled by the base patterns.

    Documents and windows are drawn by hash, so the sample does not depend on partitions.
    """
    total = max(1, documents.count())
    rows = documents.select(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("key"), F.col(text).alias("body"))
    rows = rows.where(hash_share(F.col("key")) < min(1.0, TRAIN_DOCUMENTS / total)).where(F.col("body").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            out = []
            for key, body in zip(batch.key, batch.body, strict=True):
                last = -1
                for m in TRIGGER.finditer(body):
                    if m.start() > last:
                        last = m.start() + MAX_LENGTH
                        window = body[max(0, m.start() - MAX_LENGTH) : last]
                        out.append((hashlib.sha256(f"{key}:{m.start()}".encode()).hexdigest(), window))
                        if len(out) > 20 * windows:
                            out = sorted(out)[:windows]
            yield pd.DataFrame(sorted(out)[:windows], columns=["place", "part"])

    parts = rows.mapInPandas(run, "place string, part string").orderBy("place", "part").limit(windows).collect()
    return [(r.part, [(a, b, kind) for a, _, kind, b in base_spans(r.part)]) for r in parts]


def train(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights from sampled windows of the table and generated ones; without any text from the latter alone."""
    found = sampled_windows(documents, doc_id, text)
    words = sorted({w for part, _ in found for w in re.findall(r"[^\W\d_]{2,12}", part)})[:2000] or ["word", "the", "of", "text", "more"]
    return fit(found + generated(GENERATED, words))


def added_spans(text: str, base: list[tuple[int, int, str, int]], weights: np.ndarray, margin: float = MARGIN) -> list[tuple[int, int, str, int]]:
    """Spans of the best labelling that overlap no base span."""
    out = []
    for tokens in islands(text, [(a, b) for a, _, _, b in base]):
        found = candidates(text, tokens)
        values = [v - margin for v in scores(found, weights)]
        for k in best_path(len(tokens), found, values):
            i, j, kind, _ = found[k]
            out.append((tokens[i][0], kind, KINDS[kind], tokens[j - 1][1]))
    return out


def scan(documents: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, added) for every row; base and added are sorted arrays of (start, rank, kind, end).

    Positions are code points, the end exclusive. A null text counts as empty and has no spans. Base spans of
    different kinds may overlap; added ones overlap nothing. Repeated rows come back repeated, null ids stay, an
    empty table gives no rows, other columns are ignored. Texts of any length are read whole: patterns and
    dynamic program take time in proportion to the length, added spans have at most ``MAX_TOKENS`` tokens.
    """

    @F.pandas_udf("base array<int>, added array<int>")
    def spans(texts: pd.Series) -> pd.DataFrame:
        base, added = [], []
        for body in texts:
            known = base_spans(body) if body else []
            more = added_spans(body, known, weights) if body and TRIGGER.search(body) else []
            base.append([x for start, rank, _, end in known for x in (start, rank, end)])
            added.append([x for start, rank, _, end in more for x in (start, rank, end)])
        return pd.DataFrame({"base": base, "added": added})

    names = F.array(*[F.lit(k) for k in KINDS])
    at = lambda flat, i, k: F.get(flat, i * 3 + k)
    named = lambda flat: F.transform(
        F.filter(F.transform(flat, lambda x, i: i), lambda i: i < F.size(flat) / 3),
        lambda i: F.struct(at(flat, i, 0).alias("start"), at(flat, i, 1).alias("rank"), F.get(names, at(flat, i, 1)).alias("kind"), at(flat, i, 2).alias("end")),
    )
    rows = documents.select(F.col(doc_id).alias("doc_id"), spans(F.coalesce(F.col(text), F.lit(""))).alias("found"))
    return rows.select("doc_id", named(F.col("found.base")).alias("base"), named(F.col("found.added")).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Base spans by kind, the hash of the base spans, all spans as text and the number of added ones."""
    joined = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
