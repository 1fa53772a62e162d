"""Pairs that are compared, resampled or restored in the tile that scores them."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociloom.operators import compare, patterns, stability
from lociloom.operators import pairs as P
from lociloom.operators.matrix import marginals
from lociloom.scratch import Scratch

SAMPLES, KEPT = 40, 25


@pytest.fixture(scope="module")
def sides(spark):
    """A matrix with linked, equal and one-state rows, and its first samples alone."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (60, SAMPLES))
    x[10:20] = x[:10] ^ (rng.random((10, SAMPLES)) < 0.1)
    x[20:24], x[30], x[31, :KEPT] = x[0], 1, 0
    frame = lambda a: spark.createDataFrame([(100 + i, i, [int(v) for v in r]) for i, r in enumerate(a)], "locus long, row_pos long, x array<tinyint>")
    weights = lambda w: spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "sample_pos int, weight double")
    w = rng.uniform(0.2, 2, SAMPLES)
    return frame(x), weights(w), frame(x[:, :KEPT]), weights(w[:KEPT]), weights(np.ones(SAMPLES))


def rows(df, keys=2):
    out = {tuple(r)[:keys]: tuple(r)[keys:] for r in df.collect()}
    return out


def test_f3_few_pairs_are_scored(sides):
    """Of independent rows only the few that may reach the threshold are scored, and no such pair is lost."""
    rng = np.random.default_rng(4)
    x, w = rng.integers(0, 2, (300, 200), dtype=np.uint8), rng.uniform(0.2, 2, 200)
    row = pd.Series({"locus": np.arange(300).tobytes(), "row_pos": np.arange(300).tobytes(), "dp": (x @ w).tobytes(), "bits": np.packbits(x, axis=1).tobytes(), "extra": P.pickle.dumps([None] * 300)})
    a, every = P.Block(row, [w]), slice(None)
    v = P.exact(a, a, 0, every, every, *np.triu_indices(300, 1), np.ones(300 * 299 // 2, bool), P.CLIP)
    for t in (0.1, 0.2, 0.3):
        keep = P.screen(a, a, 0, every, every, t)[np.triu_indices(300, 1)]
        assert keep[v >= t].all()
    assert P.screen(a, a, 0, every, every, 0.2).mean() < 0.1


@pytest.mark.parametrize("tile", [16, 1024])
def test_f6_comparison_without_stored_pairs(sides, tile):
    full, w, high, wh, _ = sides
    want = rows(compare.complete_comparison(P.all_pairs(full, w, 0.2), P.all_pairs(high, wh, 0.25), full, w, high, wh))
    got = rows(compare.scored_comparison(full, w, high, wh, 0.2, 0.25, tile))
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-9) for k in want) and len(want) > 50


def test_f6_equal_scores_stand_together(spark):
    """Nearly all pairs reach the threshold: a part's rows come in runs of equal numbers, and its loci have few different marginals."""
    rng = np.random.default_rng(6)
    x = (rng.integers(0, 5, (600, 60)) == 0) | (np.arange(60) >= rng.poisson(40, 600)[:, None])
    frame = lambda a: spark.createDataFrame([(i, 600 - i, [int(v) for v in r]) for i, r in enumerate(a)], "locus long, row_pos long, x array<tinyint>")
    ones = lambda n: spark.createDataFrame([(i, 1.0) for i in range(n)], "sample_pos int, weight double")
    full, high = frame(x), frame(x[:, x[0]])
    runs = {}
    for tile in (128, 1024):
        out = compare.scored_comparison(full, ones(60), high, ones(int(x[0].sum())), 0.1, 0.1, tile).withColumn("p", F.spark_partition_id()).collect()
        v = [(r.p, round(r.v_f, 6), round(r.v_h, 6)) for r in out]
        assert len(v) > 100_000 and len({(r.locus1, r.locus2) for r in out}) == len(v)
        runs[tile] = 1 + sum(a != b for a, b in zip(v, v[1:]))
        assert tile < 600 or runs[tile] == len(set(v))
    assert runs[128] < 2 * runs[1024] < len(v)


@pytest.mark.parametrize("uniform", [True, False])
def test_f1_resampling_without_stored_pairs(sides, uniform):
    full, w, _, _, ones = sides
    w = ones if uniform else w
    want = rows(stability.pair_bootstrap(P.all_pairs(full, w, 0.2), full, w, 0.2, SAMPLES, 20))
    got = rows(stability.all_pair_bootstrap(full, w, 0.2, 0.2, SAMPLES, 20, tile=16))
    assert set(got) == set(want) and all(np.allclose(np.array(got[k], float), np.array(want[k], float), atol=1e-12) for k in want)


def test_f1_looked_up_scores_equal_computed_ones():
    rng = np.random.default_rng(5)
    bags = np.stack([np.bincount(rng.integers(0, 30, 30), minlength=30) for _ in range(8)]).astype(float)
    x, y = rng.integers(0, 2, (50, 30)).astype(float), rng.integers(0, 2, (50, 30)).astype(float)
    x[0], y[1] = 1, 0
    want = np.nan_to_num(P.scores((x * y) @ bags.T, x @ bags.T, y @ bags.T, bags.sum(axis=1)[None, :]), nan=0.0)
    assert (stability._replicate_scores(bags)(x, y, x @ bags.T, y @ bags.T) == want).all()


@pytest.mark.parametrize("part, most", [(2, 3), (512, 262_144)])
def test_f2_restoring_without_stored_pairs(sides, part, most):
    full, w, _, _, _ = sides
    m = patterns.collapse(marginals(full, w))
    want = rows(patterns.restore_between(P.all_pairs(patterns.representatives(full, m), w, 0.1), m))
    out = patterns.restored_pairs(full, m, w, 0.1, 16, part, most).collect()
    assert len(out) == len(want) and {(r.locus1, r.locus2): (r.v,) for r in out} == want


def test_queries_have_no_guard_and_store_no_pairs(sides, spark, monkeypatch):
    """nothing that grows with the number of pairs is written, and a result of any size is restored."""
    from lociloom.queries import pairs as Q

    full, w, _, _, ones = sides
    letters = full.selectExpr("locus", "row_pos", "transform(x, v -> if(v = 1, 'A', 'T')) as alleles")
    names, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name="t": names.append((name, "locus2" in df.columns)) or save(self, df, name))
    monkeypatch.setattr(patterns, "expansion_size", lambda *a, **k: 10**9)
    monkeypatch.setattr(Q, "snp", lambda *a: letters)
    monkeypatch.setattr(Q, "weights", lambda *a: w)
    assert Q.restore_between(spark, "").count() > 0
    assert Q._resampled(spark, letters, ones, 0.2, 0.2).count() > 0 and Q._completed(spark, letters, w, 100).count() > 0
    assert names and not any(wide for _, wide in names)


def test_f1_all_pairs_of_a_part_are_looked_up(spark):
    """Where every sample counts once, a part's scores are those of exact() at a fraction of its time, and they come rounded."""
    rng = np.random.default_rng(8)
    x, w = (rng.random((1024, 99)) < rng.uniform(0.3, 0.7, (1024, 1))).astype(np.uint8), np.ones(99)
    x[0], x[1] = 1, 0
    row = pd.Series({"locus": np.arange(1024).tobytes(), "row_pos": rng.permutation(1024).tobytes(), "dp": (x @ w).tobytes(), "bits": np.packbits(x, axis=1).tobytes(), "extra": P.pickle.dumps([None] * 1024)})
    a, every = P.Block(row, [w]), slice(None)
    first = a.pos[:, None] < a.pos[None, :]
    r, c = np.divmod(np.arange(1024 * 1024), 1024)
    took = []
    for find in (lambda: P.looked_up(a, a, 0, every, every, first).reshape(-1), lambda: np.nan_to_num(P.exact(a, a, 0, every, every, r, c, first[r, c], P.CLIP), nan=0.0)):
        find()
        began = time.time()
        took.append((find(), time.time() - began))
    assert (took[0][0] == took[1][0]).all() and took[0][1] < took[1][1] / 3
    full, high, ones = x[:200], x[:200, x[5] == 1], lambda n: spark.createDataFrame([(i, 1.0) for i in range(n)], "sample_pos int, weight double")
    frame = lambda m: spark.createDataFrame([(i, int(k), [int(v) for v in m[i]]) for i, k in enumerate(rng.permutation(len(m)))], "locus long, row_pos long, x array<tinyint>")
    f, h, wf, wh = frame(full), frame(high), ones(99), ones(high.shape[1])
    h = h.drop("row_pos").join(f.select("locus", "row_pos"), "locus").select(*f.columns)  # the same positions on both sides
    want = rows(compare.complete_comparison(P.all_pairs(f, wf, 0.1), P.all_pairs(h, wh, 0.15), f, wf, h, wh))
    for tile in (32, 1024):
        got = rows(compare.scored_comparison(f, wf, h, wh, 0.1, 0.15, tile, digits=6))
        assert set(got) == set(want) and len(want) > 500 and all(np.allclose(got[k], want[k], rtol=0, atol=5.1e-7) and all(round(v, 6) == v for v in got[k]) for k in want)


def test_f3_a_rows_pairs_are_resampled_together(spark):
    """One product and one table for a row and a part's columns, either being the reference."""
    rng = np.random.default_rng(9)
    n = 99
    bags = np.stack([np.bincount(rng.integers(0, n, n), minlength=n) for _ in range(100)]).astype(float)
    x, y = (rng.random((8, n)) < 0.5).astype(float), (rng.random((1000, n)) < rng.uniform(0.1, 0.9, (1000, 1))).astype(float)
    y[3], x[1] = 0, 1
    dx, dy, score = x @ bags.T, y @ bags.T, stability._replicate_scores(bags)
    together = stability.Resampler(bags, 0.2, y, dy)
    for k in range(8):
        first, at = bool(k % 2), np.arange(5, 990)
        got = together(x[k], dx[k], 5, 990, first)
        p, q = np.broadcast_to(dx[k], (len(at), 100)), dy[at]
        s = score(np.broadcast_to(x[k], (len(at), n)), y[at], p if first else q, q if first else p)
        want = (s >= 0.2).sum(axis=1), s.mean(axis=1), s.std(axis=1)
        assert (got[0] == want[0]).all() and np.allclose(got[1], want[1], rtol=0, atol=1e-13) and np.allclose(got[2], want[2], rtol=0, atol=1e-13)
    z = (np.arange(90) >= rng.poisson(60, 160)[:, None]) | (rng.random((160, 90)) < 0.2)
    f = spark.createDataFrame([(i, int(k), [int(v) for v in z[i]]) for i, k in enumerate(rng.permutation(160))], "locus long, row_pos long, x array<tinyint>")
    w = spark.createDataFrame([(i, 1.0) for i in range(90)], "sample_pos int, weight double")
    want = rows(stability.pair_bootstrap(P.all_pairs(f, w, 0.2), f, w, 0.2, 90, 100))
    for tile in (64, 1024):
        got = rows(stability.all_pair_bootstrap(f, w, 0.2, 0.2, 90, 100, tile=tile, digits=6))
        assert set(got) == set(want) and len(want) > 5000 and all(np.allclose(np.array(got[k], float), np.array(want[k], float), rtol=0, atol=5.1e-7) and round(got[k][2], 6) == got[k][2] for k in want)
