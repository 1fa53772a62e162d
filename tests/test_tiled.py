"""Selection of a subgroup's changed pairs without storing the comparison."""

import pytest
from pyspark.sql import functions as F
from test_states import data  # noqa: F401

from lociloom.config import HighOrderConfig, VpConfig
from lociloom.plans import highorder as H
from lociloom.plans.tiled import selected_in_tiles
from lociloom.plans.vp import prepared, run_vp
from lociloom.scratch import Scratch


@pytest.mark.parametrize("tile, genes", [(8, True), (1024, False)])
def test_f8_changed_pairs_without_a_stored_comparison(spark, data, monkeypatch, tile, genes):  # noqa: F811
    m, places, ids = data
    s, near = Scratch(spark, "t"), places if genes else None
    vp = VpConfig(weight_model="NW", threshold=0.1)
    cfg = HighOrderConfig(method="iqr", bootstrap=20, sample_size=1000, min_rows=1, k_upper=0.3, k_lower=0.3, min_abs=0.02)
    sub = s.save(H.split_by_background(m, ids[3], 1), "sub")
    full, high = run_vp(m, vp, s, places=near), run_vp(sub, vp, s, places=near)
    want = H.compare(full, high, cfg, s, near)
    names, save = [], Scratch.save
    with monkeypatch.context() as c:
        c.setattr(Scratch, "save", lambda self, d, name="t": names.append((name, "locus2" in d.columns)) or save(self, d, name))
        chosen, limits = selected_in_tiles(prepared(m, vp, s), prepared(sub, vp, s), cfg, s, near, tile)
    assert {n for n, wide in names if wide} == {"chosen"}
    assert sorted((r.chrom, round(r.stable_upper, 9), round(r.stable_lower, 9)) for r in limits.collect()) == sorted((r.chrom, round(r.stable_upper, 9), round(r.stable_lower, 9)) for r in want.selection.thresholds.collect())
    rows = lambda d: sorted((r.locus1, r.locus2, round(r.v_f, 9), round(r.v_h, 9)) for r in d.collect())
    got = rows(chosen)
    assert got == rows(want.selection.rows.filter("direction <> 'not_selected'")) and len(got) > 50


def test_f8_no_spread_is_an_error_as_before(spark, data):  # noqa: F811
    """The subgroup of a background with one state is the whole data: all differences are 0."""
    m, _, ids = data
    s, vp = Scratch(spark, "t"), VpConfig(weight_model="NW", threshold=0.1)
    p = prepared(m, vp, s)
    with pytest.raises(ValueError, match="no spread of the differences"):
        selected_in_tiles(p, p, HighOrderConfig(method="iqr", bootstrap=20, sample_size=1000), s)


def test_f8_query_keeps_no_comparison_and_has_no_guard(spark, data, monkeypatch):  # noqa: F811
    from lociloom.queries import highorder as Q

    m, _, ids = data
    monkeypatch.setattr(Q, "snp", lambda *a: m.withColumn("row_pos", F.col("locus")))
    monkeypatch.setattr(Q, "shard", lambda *a: spark.createDataFrame([(0, ids[3])], "ordinal long, locus long"))
    monkeypatch.setattr(Q, "table", lambda *a: None)
    monkeypatch.setattr("lociloom.operators.patterns.expansion_size", lambda *a, **k: 10**9)
    names, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, d, name="t": names.append((name, "locus2" in d.columns)) or save(self, d, name))
    assert Q.highorder_pipeline(spark, "").count() > 0 and {n for n, wide in names if wide} == {"chosen"}
