import os
import random

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from rankmill.llm.pieces import Pieces, decoded, encode, model, prepared, states, times  # noqa: E402

PATH = os.environ.get("RANKMILL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no model file")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(PATH)


def texts(seed=1, n=400):
    rng = random.Random(seed)
    parts = ["the", "tion", "er", "ou", "é", "ción", "aaaa", "  ", " ", "\n", "\t", "你", "🙂", "%%%", "***", ",", ". ", "SCUM!!", "0123", "http://", "ß", "́", "a", "l", "ll", "----", "\x00", "ing"]
    out = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(n)]
    words = ["Erreth was", "retihaou", "the", "ciónasque", "enschber", "éeuxeuxai", "worthless", "+1 (678) 555-5272", "token = \"24be64\"", "internationalization"]
    return out + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(100)] + ["", " ", "   ", "a" * 300, " " * 100, "\n\n", "ab" * 200]


def test_ids_equal_the_library(pieces, library):
    for text in texts():
        assert pieces.encode(text).tolist() == library.encode(text), text


def test_round_trip(pieces):
    for text in [*texts(2), "a▁b ▁", "▁", "▁▁ x"]:
        assert pieces.decode(pieces.encode(text).tolist()) == text


@pytest.mark.parametrize("size", [20, 33, 64])
def test_chunks_equal_the_whole(pieces, size):
    for text in texts(4, 60):
        whole = prepared(text)
        if not text or len(whole) <= size:
            continue
        cuts = [*range(0, len(whole), size), len(whole)]
        spans = list(zip(cuts, cuts[1:]))
        rows = [pieces.transfer(whole, a, b, a == 0, b == len(whole)) for a, b in spans]
        left = times(times(rows[0], rows[1]), rows[-1]) if len(rows) == 3 else None
        assert left is None or left == times(rows[0], times(rows[1], rows[2]))
        total = rows[0]
        for m in rows[1:]:
            total = times(total, m)
        assert total[0].bit_count() == 1
        at = states(rows, 0, total[0].bit_length() - 1)
        ids = b"".join(pieces.trace(whole, a, b, a == 0, b == len(whole), at[k], at[k + 1]) for k, (a, b) in enumerate(spans))
        assert np.frombuffer(ids, dtype=np.int32).tolist() == pieces.encode(text).tolist()


def test_table(spark, library):
    rows = [(i, t, "s") for i, t in enumerate(texts(7, 60))] + [(900, None, "s"), (901, "x▁y " * 40, "s"), (901, "x▁y " * 40, "s"), (None, "word " * 9000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string").repartition(3)
    held = model(spark, PATH)
    got = encode(docs, held, chunk=50).withColumn("back", decoded(held)("piece_ids")).collect()
    assert len(got) == len(rows) and all(r.back == r.text for r in got)
    for r in got:
        if r.text is not None and "▁" not in r.text:
            assert list(r.piece_ids) == library.encode(r.text)
    assert [r.piece_ids for r in got if r.text is None] == [None]
    assert encode(docs.limit(0), held).count() == 0


def test_words_that_come_again_are_not_solved_again():
    from rankmill.llm.pieces import Remembered

    solved = []
    held = Remembered(lambda word: solved.append(word) or word.encode(), limit=3)
    for i in range(20):
        assert held["often"] == b"often" and held[f"once{i}"] == f"once{i}".encode()
        assert len(held) <= 3 and len(held.older) <= 3
    assert solved.count("often") == 1 and len(solved) == 21
