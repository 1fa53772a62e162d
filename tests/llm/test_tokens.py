import os
import random

import pytest

from lociloom.llm.tokens import VOCABULARY, Bpe, encode

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
ALPHABETS = ["ab", "a", "abcdefgh ", "a b'st\n\t  ", "0123ab .,", "的一是不了人我在有他", "あいう、。漢字 ", "éàü ñ-—", "!?'#$%", "😀👍🏽 a", " \n", "  　 x"]


def texts(seed, n, size):
    rng = random.Random(seed)
    for _ in range(n):
        a = rng.choice(ALPHABETS) if rng.random() < 0.6 else "".join(rng.sample(ALPHABETS, 3))
        yield "".join(rng.choice(a) for _ in range(rng.randint(2, size)))


def test_join_equals_whole():
    bpe = Bpe.load(VOCABULARY)
    rng = random.Random(1)
    for t in texts(2, 1500, 500):
        k = rng.randint(0, len(t))
        assert bpe.join(bpe.encode(t[:k]), bpe.encode(t[k:]), window=rng.choice([1, 4, 32])) == bpe.encode(t), repr(t)


def test_join_in_one_long_run():
    bpe = Bpe.load(VOCABULARY)
    rng = random.Random(3)
    for a in ("ab", "a", "abcdefghijklmnop", "的一是不了人", "0123456789", "!?#$"):
        for _ in range(6):
            t = "".join(rng.choice(a) for _ in range(6000))
            parts = [bpe.encode(t[i : i + 1500]) for i in range(0, 6000, 1500)]
            assert bpe.join_all(parts) == bpe.encode(t), a


def test_column(spark):
    rows = [(1, "Hello world <|endoftext|>", "x", 0), (2, "", None, 1), (3, None, None, 2), (4, " \n ", "y", 3), (None, "lost id", "z", 4), (6, "a" * 5000 + " 的" * 3000, "q", 5), (6, "a" * 5000 + " 的" * 3000, "q", 5)]
    rows += [(10 + i, t, "r", i) for i, t in enumerate(texts(8, 40, 900))]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, uid int")
    bpe = Bpe.load(VOCABULARY)
    want = sorted((str(r[0]), bpe.encode(r[1]) if r[1] else []) for r in rows)
    got = encode(df, "text", ["doc_id"], leaf_chars=100)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got.collect()) == want
    counts = encode(df, "text", ["doc_id"], leaf_chars=100, count_only=True)
    assert sorted((str(r.doc_id), r.n_tokens) for r in counts.collect()) == sorted((k, len(v)) for k, v in want)
    assert encode(df.limit(0), "text", ["doc_id"]).count() == 0
