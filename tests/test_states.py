"""All states of all backgrounds in one job against a plan for each state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociloom.config import HighOrderConfig, VpConfig
from lociloom.operators import thresholds as T
from lociloom.plans import highorder as H
from lociloom.plans import states as S
from lociloom.plans.vp import run_vp

TOTAL = 5_165_770


@pytest.fixture(scope="module")
def data(spark):
    """Linked, equal and rare rows over both chromosomes and genes with and without a place; some rows stand out of the order of their ids."""
    rng = np.random.default_rng(11)
    base = rng.choice(list("ATC"), (80, 90), p=[0.6, 0.3, 0.1])
    for i in range(0, 78, 3):
        base[i + 1] = np.where(rng.random(90) < 0.15, rng.choice(list("AT"), 90), base[i])
        base[i + 2] = base[i] if i % 2 else np.where(np.arange(90) < 45, base[i], rng.choice(list("AT"), 90))
    ids = [1000 + 61_000 * i for i in range(72)] + [TOTAL + k for k in range(8)]
    order = rng.permutation(80)
    base[5] = np.where(np.arange(90) < 80, "A", "T")
    m = spark.createDataFrame([(ids[k], int(p), list(base[k])) for k, p in enumerate(order)], "locus long, row_pos long, alleles array<string>")
    rows = [(TOTAL + 1, 150, 100, 200, None), (TOTAL + 2, 450, 500, 400, None), (TOTAL + 3, 4_000_050, 4_000_000, 4_000_100, None), (TOTAL + 4, None, None, None, "c"), (TOTAL + 5, None, None, None, "c"), (TOTAL + 6, 160, 120, 260, None)]
    places = spark.createDataFrame(rows, "locus_id long, mid long, start long, end long, contig string")
    return m, places, ids


def by_row(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("background", "state", "status", "message", *[c.split()[0] for c in H.PAIRS.split(", ")]).fillna(-9).collect())


@pytest.mark.parametrize("method, model, genes", [("iqr", "SCC", True), ("auto", "NW", False), ("quantile", "SCC", True)])
def test_f4_one_job_for_all_states(spark, data, tmp_path, method, model, genes, monkeypatch):
    m, places, ids = data
    vp = VpConfig(k=0.1, threshold=0.1, weight_model=model, scc_threshold=0.7)
    cfg = HighOrderConfig(method=method, bootstrap=20, sample_size=1000, min_rows=1, k_upper=0, k_lower=0, min_tail=20, min_abs=0.01)
    loci, near = [ids[3], ids[4], ids[5], ids[40], 7], places if genes else None
    alone = H.run_backgrounds(m, loci, vp, cfg, f"file://{tmp_path}/a", near, analyse=lambda *a, **k: run_vp(*a, **k))
    with monkeypatch.context() as c:
        c.setattr(H, "run_batch", None)  # no plan for a state
        got = by_row(H.run_backgrounds(m, loci, vp, cfg, f"file://{tmp_path}/t", near))
        c.setattr(H, "all_states", None)  # a second call computes failed states alone
        ok = [x for x in loci if x != 7 and "failed" not in {r[2] for r in got if r[0] == x}]
        again = by_row(H.run_backgrounds(m, ok, vp, cfg, f"file://{tmp_path}/t", near)) if ok else []
    assert got == by_row(alone) and (method == "auto" or sum(r[4] > 0 for r in got) > 30)
    assert {r[2] for r in got} >= {"failed", "too_few"} and {r[2] for r in again} <= {"skipped"}
    assert [r[4:] for r in again] == [r[4:] for r in got if r[0] in ok]


def test_f4_resampled_quantiles_equal_sorted_draws():
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=5000), np.round(rng.normal(size=7000), 1), np.sort(rng.normal(size=9000)), rng.normal(size=40)):
        n = len(values)
        got = S.resampled(values, (0.25, 0.75), 5, 6000, "b")
        for r in range(5):
            draws = values[S._hashes("b", r, min(n, 6000)).astype(np.int64) % n]
            assert np.allclose(got[r], np.quantile(draws, [0.25, 0.75]), atol=1e-12)


def test_f4_hashes_and_large_modes(spark):
    want = spark.range(3).select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"), "id").select("id", "i", T.draw(F.col("id"), F.col("i"), "p").alias("h")).collect()
    assert all(S.hashes("p", 3, 5)[r.id, r.i] == r.h for r in want)
    rng = np.random.default_rng(3)
    d = np.concatenate([rng.normal(0.5, 0.05, 1500), rng.normal(-0.5, 0.05, 500)])
    loci = spark.createDataFrame([(i, i, float(x), "chr1") for i, x in enumerate(d)], "locus1 long, locus2 long, diff double, chrom string")
    cfg = HighOrderConfig(bootstrap=20, sample_size=1000)
    chosen = T.select_auto(loci, "chrom", cfg)
    mask, limits = S.selected(d, np.zeros(len(d), np.int8), cfg)
    t = chosen.thresholds.first()
    assert S.bimodal(d, 128, 0.15) and np.allclose(limits[0], (t.stable_upper, t.stable_lower), atol=1e-12)
    assert {r.locus1 for r in chosen.rows.filter("direction <> 'not_selected'").collect()} == set(np.flatnonzero(mask))
