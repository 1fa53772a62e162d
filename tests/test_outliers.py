"""Outliers of all pairs without storing the pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociloom.operators import gwes, stability
from lociloom.operators.pairs import all_pairs
from lociloom.scratch import Scratch

TOTAL = 5_165_770


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (90, 50))
    x[1::7] = x[0::7][: len(x[1::7])] ^ (rng.random((len(x[1::7]), 50)) < 0.05)
    ids = [60_001 * i + 1 for i in range(82)] + [TOTAL + i for i in range(8)]
    df = spark.createDataFrame([(ids[i], ids[i], [int(v) for v in r]) for i, r in enumerate(x)], "locus long, row_pos long, x array<tinyint>")
    w = spark.range(50).select(F.col("id").cast("int").alias("sample_pos"), (1 + F.col("id") % 2).cast("double").alias("weight"))
    rows = [(TOTAL + 1, 150, 100, 200, None), (TOTAL + 2, 450, 500, 400, None), (TOTAL + 3, 4_000_050, 4_000_000, 4_000_100, None), (TOTAL + 4, None, None, None, "c"), (TOTAL + 5, None, None, None, "c")]
    return df, w, spark.createDataFrame(rows, "locus_id long, mid long, start long, end long, contig string")


def rows(df):
    return sorted((r.locus1, r.locus2, round(r.v, 12), r.geno_dis, r.chrom or "", r.LD) for r in df.collect())


@pytest.mark.parametrize("tried, reach, genes", [(10**9, 0.01, True), (4, 0.2, True), (4, 0.0, False)])
def test_f7_outliers_without_stored_pairs(spark, data, monkeypatch, tried, reach, genes):
    """Counted in full, from some parts, and from some parts without any reach, so that quartiles may have to be counted again."""
    df, w, places = data
    near = places if genes else None
    want, _, t = gwes.run_gwes(all_pairs(df, w, 0.05), 2, places=near)
    counts, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, d, name="t": (lambda b: counts.append(b.count() if "locus2" in b.columns else 0) or b)(save(self, d, name)))
    monkeypatch.setattr(gwes, "TRIED", tried)
    monkeypatch.setattr(gwes, "REACH", reach)
    got, u = gwes.all_pair_outliers(df, w, 0.05, 2, places=near, tile=8)
    assert abs(t - u) < 1e-12 and rows(got) == rows(want) and len(rows(want)) > 3
    assert tried < 10**9 or max(counts) < all_pairs(df, w, 0.05).count()


def test_f7_query_stores_no_pairs(spark, data, monkeypatch):
    from lociloom.queries import pairs as Q

    df, w, places = data
    monkeypatch.setattr(Q, "snp", lambda *a: df.selectExpr("locus", "row_pos", "transform(x, v -> if(v = 1, 'A', 'T')) as alleles"))
    monkeypatch.setattr(Q, "weights", lambda *a: w)
    monkeypatch.setattr(Q, "gene_table", lambda *a: places)
    names, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, d, name="t": names.append((name, "locus2" in d.columns)) or save(self, d, name))
    assert Q.gwes_bootstrap(spark, "").count() > 0 and {n for n, wide in names if wide} == {"found", "candidates"}


def test_f7_no_pair_far_enough(spark, data):
    df, w, _ = data
    assert gwes.all_pair_outliers(df, w, 0.999999, 2)[1] == 0.0
