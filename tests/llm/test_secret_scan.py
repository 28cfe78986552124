import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from rankmill.llm.secret_scan import digest, ratio, scan, train

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def slow(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def corpus(seed=2, n=150):
    rng = random.Random(seed)
    words = ["the", "value", "of_the", "résumé", "identifier", "user-name", "😀", "face", "deadbeef", "token", "configuration"]
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    keys = lambda k: "".join(rng.choices(string.ascii_uppercase + string.digits, k=k))
    bits = [
        lambda: f'password = "{hexes(rng.randint(3, 40))}"', lambda: f"API_KEY:'{keys(rng.randint(2, 30))}", lambda: f"apikey={hexes(30)}",
        lambda: "AKIA" + keys(rng.randint(10, 20)), lambda: hexes(rng.randint(20, 64)), lambda: 'token="token":abcdefgh', lambda: "Secret==abc/def+x",
    ]
    rows = []
    for _ in range(n):
        parts = [rng.choice(bits)() if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randint(0, 60))]
        rows.append(rng.choice([" ", "\n", ", "]).join(parts))
    return rows + [None, "", "a" * 30000, "token: " + "x" * 20000, "ſecret=abcdefgh PASSWORD=Abc.def-gh", " ".join(hexes(24) for _ in range(400))]


def test_base_spans_match_regular_expressions(spark):
    rows = list(enumerate(corpus()))
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, base string").repartition(4)
    got = {r.doc_id: r for r in digest(scan(docs, train(docs))).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = slow(text)
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), text
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for _, _, k, _ in want) for x in ("assign", "access", "hex")]
        assert set(filter(None, line.split(","))) <= set(got[i].spans.split(","))


def test_models_add_random_tokens_only(spark):
    rng = random.Random(8)
    secrets = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(60)]
    plain = "the quick brown foxes jumped over many lazy dogs while vexed zebras and quiet koalas kept watching from their boxes"
    texts = [f"the long identifier configuration_value_of_the_user {s} and other_names {plain}" for s in secrets]
    texts += ["plain x9f3kq07zb1d5j8w2c6v4n7m and internationalization_of_the_configuration", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.added] for r in scan(docs, train(docs)).collect()}
    assert found[60] == [(6, 30)] and found[0] == [] and found[61] == found[62] == []


def test_no_samples_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "secret=abcdef"), (1, "secret=abcdef"), (None, "x")], "doc_id long, text string")
    got = digest(scan(docs, train(docs.limit(0))))
    assert sorted((str(r.doc_id), r.n_assign, r.spans) for r in got.collect()) == [("1", 1, "assign:0:13")] * 2 + [("None", 0, "")]
    assert digest(scan(docs.limit(0), train(docs))).count() == 0


def test_plan_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "secret=abcdef")], "doc_id long, text string")
    plan = digest(scan(docs, [0.0] * 128**2))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_long_tokens_take_proportional_time(spark):
    import time

    rng = random.Random(3)
    token = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=1_000_000))
    docs = spark.createDataFrame([(1, f"blob {token} end"), (2, "z" * 1_000_000)], "doc_id long, text string")
    start = time.perf_counter()
    got = {r.doc_id: r for r in digest(scan(docs, train(docs.limit(0)))).collect()}
    assert got[1].base_sha256 == got[2].base_sha256 and time.perf_counter() - start < 60


def test_ratio_adds_neighbouring_letters(spark):
    rng = random.Random(4)
    weights = [rng.uniform(-2, 2) for _ in range(128 * 128)]
    tokens = ["ab", "a", "x9f3kq07zb1d5j8w", "Aa" * 40]
    frame = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = [r.v for r in frame.select(ratio(F.col("token"), weights).alias("v")).collect()]
    for t, v in zip(tokens, got):
        assert abs(v - sum(round(weights[ord(a) * 128 + ord(b)], 5) for a, b in zip(t, t[1:]))) < 1e-6
