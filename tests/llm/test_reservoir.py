from collections import Counter

import numpy as np

from lociloom.llm import picking, reservoir
from lociloom.llm.picking import pick
from lociloom.llm.reservoir import Draws, Reservoir, by_inversion, hypergeometric, sample_batches, split, survivors
from lociloom.scratch import Scratch
from pyspark.sql import functions as F


def batches(spark, sizes):
    rows = [(b, f"{b}-{i}", None if i % 7 else "n", i) for b, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "batch_no int, name string, b string, quota int")


def test_size_and_subset(spark):
    df = batches(spark, [10, 300, 5, 120])
    out = [r.name for r in sample_batches(df, "batch_no", 60, Scratch(spark, "t"), slots=4).collect()]
    assert len(out) == len(set(out)) == 60 and set(out) <= {r.name for r in df.collect()}
    assert sample_batches(df, "batch_no", 1000, Scratch(spark, "t")).count() == 435
    assert sample_batches(df.limit(0), "batch_no", 5, Scratch(spark, "t")).count() == 0


def test_null_batch_and_equal_rows(spark):
    df = spark.createDataFrame([(None, "x")] * 30 + [(1, "x")] * 30, "batch_no int, name string")
    assert sample_batches(df, "batch_no", 25, Scratch(spark, "t")).count() == 25


def test_every_row_is_equally_likely():
    """Counts per batch over many runs of the draws: a batch of share s gets k * s rows on average, with the hypergeometric spread."""
    sizes, k, runs = [400, 50, 1000, 3], 100, 800
    got = np.zeros((runs, 4))
    counts = np.array([[n // 5 + (i < n % 5) for i in range(5)] for n in sizes])
    for seed in range(runs):
        got[seed] = survivors(counts, k, seed).sum(axis=1)
    assert (got.sum(axis=1) == k).all()
    total = sum(sizes)
    for b, n in enumerate(sizes):
        p = n / total
        sd = (k * p * (1 - p) * (total - k) / (total - 1)) ** 0.5
        assert abs(got[:, b].mean() - k * p) < 5 * sd / runs**0.5
        assert 0.85 < got[:, b].std() / sd < 1.15


def test_rows_within_a_batch_are_equally_likely(spark):
    df = batches(spark, [40, 80])
    seen = Counter(r.name for seed in range(30) for r in sample_batches(df, "batch_no", 60, Scratch(spark, "t"), seed=seed, slots=3).collect())
    counts = np.array([seen.get(r.name, 0) for r in df.collect()])
    assert counts.sum() == 30 * 60
    chi = ((counts - 15) ** 2 / (15 * 0.5)).sum()  # about 120 degrees of freedom
    assert chi < 120 + 6 * (2 * 120) ** 0.5


def test_split_is_exact():
    rng = np.random.default_rng(1)
    c = np.array([5, 0, 9, 1])
    for n in range(16):
        out = split(rng, c, n)
        assert out.sum() == n and (out <= c).all() and (out >= 0).all()


def test_small_batches_after_many_rows():
    """Beyond NumPy's range: mean and spread of the new rows of batches of 5, 5,000 and 10,000 after 2 * 10^9 rows."""
    seen, k, runs = 2 * 10**9, 100_000, 4000
    for b in (5, 5_000, 10_000):
        rng = np.random.default_rng(b)
        got = np.array([by_inversion(rng, b, seen, k) for _ in range(runs)])
        n = seen + b
        mean, sd = k * b / n, (k * b / n * (seen / n) * (n - k) / (n - 1)) ** 0.5
        assert abs(got.mean() - mean) < 5 * sd / runs**0.5 and abs(got.std() - sd) < 0.15 * sd
    rng = np.random.default_rng(0)
    assert {by_inversion(rng, 7, 0, 4), by_inversion(rng, 3 * 10**9, 0, 5)} == {4, 5} and by_inversion(rng, 0, 2 * 10**9, 9) == 0


def test_inversion_follows_the_probabilities():
    from math import comb

    rng = np.random.default_rng(5)
    good, bad, draws, runs = 9, 14, 11, 20_000
    got = Counter(by_inversion(rng, good, bad, draws) for _ in range(runs))
    p = [comb(good, x) * comb(bad, draws - x) / comb(good + bad, draws) for x in range(good + 1)]
    assert sum((got[x] - runs * p[x]) ** 2 / (runs * p[x]) for x in range(good + 1)) < 9 + 6 * 18**0.5
    big = hypergeometric(rng, np.array([5, 10**12]), np.array([7, 10**12]), np.array([6, 10**6]))
    assert 0 <= big[0] <= 5 and abs(big[1] - 500_000) < 5_000


def test_many_batches_take_seconds():
    import time

    began = time.time()
    counts = np.random.default_rng(2).integers(0, 50, (5_000, 64))
    counts[7] = 10**8
    out = survivors(counts, 1_000_000)
    assert out.sum() == 1_000_000 and (out <= counts).all() and (out >= 0).all() and time.time() - began < 60
    d = Draws(10, 4)
    kept, came = d.arrive(np.array([0, 0, 0, 0]))
    assert kept.sum() == came.sum() == d.seen == 0


def test_cells_beyond_a_broadcast_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(reservoir, "BROADCAST_CELLS", 3)
    df = batches(spark, [50, 90]).withColumnsRenamed({"name": "u", "b": "s", "quota": "new"})
    assert sample_batches(df, "batch_no", 70, Scratch(spark, "t"), slots=4).select("u").distinct().count() == 70
    r = Reservoir(30, Scratch(spark, "t"), slots=4)
    r.update(df.limit(0))
    r.update(df)
    assert r.result().columns == df.columns and r.result().count() == 30


def test_incremental(spark):
    r = Reservoir(50, Scratch(spark, "t"), seed=3, slots=4)
    df = batches(spark, [30, 90, 0, 200])
    for b in range(4):
        r.update(df.filter(F.col("batch_no") == b))
    out = [x.name for x in r.result().collect()]
    assert len(out) == len(set(out)) == 50 and r.draws.seen == 320


def test_pick_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(picking, "BUCKET_ROWS", 10)
    rng = np.random.default_rng(0)
    rows = [("a", float(u), 95, 200) for u in rng.random(200)] + [("b", float(u), 3, 9) for u in rng.random(9)] + [("c", 0.5, 0, 1)]
    wanted = spark.createDataFrame([("a", 95), ("b", 3), ("c", 0)], "k string, quota int")
    out = pick(spark.createDataFrame(rows, "k string, u double, quota int, total int"), wanted, ["k"], "quota", "total", "u", Scratch(spark, "t")).collect()
    for k, q in (("a", 95), ("b", 3)):
        assert sorted(r.u for r in out if r.k == k) == sorted(r[1] for r in rows if r[0] == k)[:q]
    assert not any(r.k == "c" for r in out)
