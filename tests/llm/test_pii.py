import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill.llm import pii
from rankmill.llm.pii import KINDS, base_spans, best_path, candidates, digest, fit, generated, islands, likelihood, luhn, scan, scores, train

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORDS = "the an of where shown ention ér lich ación weiß ungen text more under version".split()


def slow(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def corpus(seed=3, n=400):
    rng = random.Random(seed)
    bits = [lambda: pii._plain(rng.choice(KINDS), rng), lambda: pii._other(rng), lambda: rng.choice(WORDS), lambda: "".join(rng.choices("0123456789.-+@ ()a%_", k=rng.randint(1, 40)))]
    texts = [rng.choice(("", " ", "\n")).join(rng.choice(bits)() for _ in range(rng.randint(0, 12))) for _ in range(n)]
    return texts + [None, "", "a@b.c_d@e.f@g.h", "😀é 1.2.3.4.5.6.7.8", "x@y@z.w", "4111 1111 1111 1111", "0001.2.3.004", "+1234567890123", "@a.b", "1" * 3000, "a" * 20000 + "@b.cd"]


@pytest.fixture(scope="module")
def weights():
    return fit(generated(700, WORDS, seed=21))


def test_base_patterns():
    for text in corpus():
        assert base_spans(text or "") == slow(text), text


def test_luhn():
    assert luhn("4111111111111111") and luhn("79927398713") and not luhn("79927398710")


def test_long_texts_in_proportional_time(weights):
    for text in ("a" * 10**6, "1" * 10**6, "a.b-" * 250_000 + "@", "1." * 500_000, "+" * 10**6, "+1" + "(" * 10**6, "@" * 10**6, "a@" * 500_000):
        start = time.perf_counter()
        base = base_spans(text)
        pii.added_spans(text[:100_000], [s for s in base if s[3] <= 100_000], weights)
        assert time.perf_counter() - start < 20, text[:9]


def labellings(n, found):
    """All sets of segments that are apart by a token at least."""
    for size in range(n // 2 + 2):
        for chosen in itertools.combinations(range(len(found)), size):
            spans = sorted(found[k][:2] for k in chosen)
            if all(a[1] < b[0] for a, b in itertools.pairwise(spans)):
                yield chosen


def test_dynamic_program_equals_enumeration():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 7)
        found = [(i, j, rng.randrange(4)) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.3][:9]
        values = [rng.uniform(-2, 3) for _ in found]
        every = list(labellings(n, found))
        total = lambda chosen: sum(values[k] for k in chosen)
        assert math.isclose(total(best_path(n, found, values)), max(map(total, every)), abs_tol=1e-9)
        norm = math.log(sum(math.exp(total(c)) for c in every))
        gold = set(rng.choice(every))
        value, share = likelihood(n, found, values, gold)
        assert math.isclose(value, total(gold) - norm, abs_tol=1e-9)
        for k in range(len(found)):
            assert math.isclose(share[k], sum(math.exp(total(c) - norm) for c in every if k in c), abs_tol=1e-9)


def test_islands_lose_no_candidate(weights):
    for text in corpus(8, 150):
        text = f"{text or ''} {'word ' * 40} {text or ''}"
        taken = [(a, b) for a, _, _, b in base_spans(text)]
        got = set()
        for tokens in islands(text, taken):
            got |= {(tokens[i][0], tokens[j - 1][1], kind) for i, j, kind, _ in candidates(text, tokens)}
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        want = {(tokens[i][0], tokens[j - 1][1], kind) for i, j, kind, _ in candidates(text, tokens)}
        assert {w for w in want if not any(w[0] < b and a < w[1] for a, b in taken)} <= got


def test_other_spellings_on_held_out_windows(weights):
    found = hits = gold = wrong = 0
    for text, want in generated(600, WORDS, seed=99):
        base = base_spans(text)
        got = {(a, b, k) for a, _, k, b in pii.added_spans(text, base, weights)}
        known = {(a, b, k) for a, _, k, b in base}
        rest = {w for w in want if not any(w[0] < b and a < w[1] for a, b, _ in known)}
        gold, hits, found = gold + len(rest), hits + len(rest & got), found + len(got)
        wrong += len(got - set(want))
    assert hits >= 0.9 * gold and hits >= 0.95 * found, (hits, gold, found)


def test_query_columns(spark, weights):
    rows = list(enumerate(corpus())) + [(5, "again me@x.yz"), (5, "again me@x.yz"), (None, "call (678) 555-5272 now"), (2**60 + 1, None)]
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, base int, found string").repartition(4)
    got = digest(scan(docs, weights)).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(i) for i, _ in rows)
    by_text = {}
    for row in got:
        by_text.setdefault(row.doc_id, []).append(row)
    for i, text in rows[: len(corpus())]:
        row, base = by_text[i][0], slow(text)
        if i == 5:
            continue
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
        assert row.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in KINDS] == [sum(x[2] == k for x in base) for k in KINDS]
        spans = [(int(a), KINDS.index(k), k, int(b)) for k, a, b in (s.split(":") for s in filter(None, row.spans.split(",")))]
        assert spans == sorted(spans) and set(base) <= set(spans) and len(spans) == len(base) + row.n_added
        added = set(spans) - set(base)
        assert not any(a[0] < b[3] and b[0] < a[3] for a in added for b in base)
    assert by_text[None][0].spans == "phone:5:19"


def test_training_needs_no_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = train(empty)
    assert model.shape == (4, pii.FEATURES) and np.isfinite(model).all()
    assert digest(scan(empty, model)).count() == 0
    docs = spark.createDataFrame([(i, f"w{i} at 10.1.2.{i} or me@h{i}.org") for i in range(60)] + [(1, None), (2, "")], "doc_id long, text string")
    assert (train(docs) == train(docs.repartition(7).withColumn("key", F.lit(1)))).all()
