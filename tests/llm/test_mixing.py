import itertools
import os
import random

import numpy as np
import pytest

from lociloom.llm.mixing import Mix, fit, subset
from lociloom.llm.picking import pick
from lociloom.llm.tokens import VOCABULARY
from lociloom.scratch import Scratch
from pyspark.sql import functions as F


def test_subset_equals_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(1, 4))]
        counts = [rng.randint(0, 3) for _ in sizes]
        target = rng.randint(0, 40)
        best = max(s for s in (sum(a * b for a, b in zip(sizes, take)) for take in itertools.product(*[range(c + 1) for c in counts])) if s <= target)
        take, got = subset(sizes, counts, target)
        assert got == best == sum(a * b for a, b in zip(sizes, take)) and all(0 <= t <= c for t, c in zip(take, counts))


def test_fit_meets_the_budget():
    rng = np.random.default_rng(2)
    sizes = np.unique(rng.integers(50, 4000, 300))
    counts = rng.integers(1, 40, len(sizes))
    total = int((sizes * counts).sum())
    for budget in (0, 10, total // 3, total, 2 * total + 12345, 5 * total):
        passes, extra = fit(sizes, counts, budget, 3)
        used = passes * total + int((sizes * extra).sum())
        assert used <= budget and (extra <= counts).all() and passes + (extra > 0).any() <= 3
        assert budget < 50 or used == min(budget, 3 * total)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice([" A", "a", "B", "b ", "c", None, "zz"]), "word " * rng.randint(1, 60), i) for i in range(400)] + [(900, "a", None, 0), (901, "b", "", 0), (None, "c", "null id", 1)]
    targets = [("a", 0.5, 1), ("B ", 0.3, 2), ("c", 0.1, 3), ("none", 0.1, 3), (None, 0.2, 1)]
    mix = Mix(spark.createDataFrame(docs, "doc_id long, source string, text string, copies int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), Scratch(spark, "t"))
    rows, report = mix.documents().collect(), {r.source: r for r in mix.report().collect()}
    limits = {"a": 1, "b": 2, "c": 3}
    assert all(1 <= r.copies <= limits[r.source] and r.n_tokens > 0 for r in rows)
    for s in limits:
        assert sum(r.copies * r.n_tokens for r in rows if r.source == s) == report[s].used_tokens
    assert set(report) == {"a", "b", "c", "none"} and report["none"].used_tokens == 0
    for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(report[s].actual_share - want) < 0.002


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_empty(spark):
    mix = Mix(spark.createDataFrame([], "doc_id long, source string, text string"), spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"), Scratch(spark, "t"))
    assert mix.documents().count() == 0 and [r.used_tokens for r in mix.report().collect()] == [0]


def test_pick_of_a_key_whose_rows_share_their_u(spark):
    rows = [("a", i, 0.99, 5, 1000) for i in range(1000)] + [("b", i, (i + 0.5) / 1000, 5, 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, id int, u double, q long, n long")
    out = pick(df, df.groupBy("k").agg(F.first("q").alias("q")), ["k"], "q", "n", "u", Scratch(spark, "t")).collect()
    assert sorted(r.k for r in out) == ["a"] * 5 + ["b"] * 5 and {r.id for r in out if r.k == "b"} == set(range(5))


def test_only_long_documents_are_left():
    """What the window's program can't hold is fitted in units, then exactly."""
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(40_000, 900_000, 60))
    counts = np.full(len(lengths), 2)
    budget = int(lengths.sum() * 0.9) + 17
    passes, extra = fit(lengths, counts, budget, 1)
    used = int((lengths * extra).sum())
    assert passes == 0 and (extra <= counts).all() and 0 <= budget - used < lengths.min()
    passes, extra = fit(np.array([100_000]), np.array([3]), 250_001, 1)
    assert extra.tolist() == [2]
