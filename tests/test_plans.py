import numpy as np
import pytest

from lociloom.config import HighOrderConfig, VpConfig
from lociloom.operators import gwes, patterns, ranks, stability, thresholds
from lociloom.operators.pairs import all_pairs
from lociloom.plans.files import analysis_from_files, pairs_from_files
from lociloom.plans.highorder import PAIRS, changed_pairs, compare, restore_selected, run_backgrounds, split_by_background
from lociloom.plans.vp import VpResult, restore_physical, run_vp
from lociloom.scratch import Scratch
from lociloom.sources.readers import read_pairs
from lociloom.sources.sinks import delete
from lociloom.streaming.backgrounds import run_stream
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(7)
    base = rng.choice(list("AT"), (30, 60))
    for i in range(0, 30, 3):
        base[i + 1] = np.where(rng.random(60) < 0.1, rng.choice(list("AT"), 60), base[i])
        base[i + 2] = base[i]
    rows = [(1000 + 40_000 * i, i, list(r)) for i, r in enumerate(base)]
    return spark.createDataFrame(rows, "locus long, row_pos long, alleles array<string>")


def test_whole_analysis(spark, matrix):
    s = Scratch(spark, "t")
    cfg = VpConfig(k=0.2, threshold=0.2)
    r = run_vp(matrix, cfg, s)
    assert r.pairs.count() > 0 and r.pairs.filter("v <= 0.2").count() == 0
    assert r.pattern_map.filter("pattern_size > 1").count() >= 20
    full = restore_physical(r, cfg)
    assert full.filter("restoration_source = 'within'").count() >= 10
    with pytest.raises(ValueError):
        run_vp(matrix, VpConfig(threshold=0.9999, weight_model="NW"), s)


def test_subgroup_analysis(spark, matrix):
    s = Scratch(spark, "t")
    cfg = VpConfig(k=0.1, threshold=0.1, weight_model="NW")
    full = run_vp(matrix, cfg, s)
    high = run_vp(s.save(split_by_background(matrix, 1000, 1), "sub"), cfg, s)
    ho = HighOrderConfig(method="iqr", bootstrap=20, sample_size=1000, min_rows=1, k_upper=0, k_lower=0)
    c = compare(full, high, ho, s)
    assert c.rows.filter(F.col("v_f").isNull() | F.col("v_h").isNull()).count() == 0
    chosen = c.selection.rows.filter("direction <> 'not_selected'")
    out = restore_selected(chosen, full, high, c.selection.thresholds, ho)
    assert out.filter("change_direction is null or abs(diff - (v_h - v_f)) > 1e-12").count() == 0


def test_all_backgrounds_in_both_states(spark, matrix, tmp_path):
    s = Scratch(spark, "t")
    few = matrix.withColumn("alleles", F.when(F.col("locus") == 1000, F.expr("transform(sequence(1, 60), i -> if(i <= 50, 'A', 'T'))")).otherwise(F.col("alleles")))
    ho = HighOrderConfig(method="iqr", bootstrap=20, sample_size=1000, min_rows=1, k_upper=0, k_lower=0)
    folder, calls = f"file://{tmp_path}/runs", []
    loci = [1000, 121_000, 7]

    def analyse(m, cfg, scratch, **more):
        calls.append("subgroup" if "least_ess" in more else "full")
        return run_vp(m, cfg, scratch, **more)

    def compare_with(*a):
        calls.append("comparison")
        return changed_pairs(*a)

    run = lambda: run_backgrounds(few, loci, VpConfig(k=0.1, threshold=0.1, weight_model="NW"), ho, folder, parallel=3, final_only=False, analyse=analyse, compare_with=compare_with).collect()
    out = run()
    status = {(r.background, r.state): r.status for r in out}
    assert status == {(1000, 1): "done", (1000, 0): "too_few", (121_000, 1): "done", (121_000, 0): "done", (7, 1): "failed", (7, 0): "failed"}
    assert {(r.background, r.state) for r in out if r.locus1 is not None} == {(1000, 1), (121_000, 1), (121_000, 0)}
    assert all("10 samples" in r.message for r in out if r.background == 1000)
    assert {c: calls.count(c) for c in set(calls)} == {"full": 1, "subgroup": 4, "comparison": 3}
    assert spark.read.parquet(f"{folder}/121000/0/comparison").count() >= spark.read.parquet(f"{folder}/121000/0/filtered_pairs").count() > 0
    again = run()
    assert len(calls) == 8 and {(r.background, r.locus1, r.locus2) for r in again} == {(r.background, r.locus1, r.locus2) for r in out}


def test_one_full_run_six_subgroups_six_comparisons(spark, tmp_path):
    """Four letters' rows, three backgrounds: a second call runs nothing, a third one with a mark gone runs that state alone."""
    m = spark.createDataFrame([(10, 0, list("AACC")), (11, 1, list("ACCA")), (12, 2, list("CCTT")), (100, 3, list("GGAA"))], "locus long, row_pos long, alleles array<string>")
    pairs = spark.createDataFrame([(10, 100, 0.5)], "locus1 long, locus2 long, v double")
    calls = {"full": 0, "subgroup": 0, "comparison": 0}

    def analyse(matrix, cfg, scratch, **more):
        calls["subgroup" if "least_ess" in more else "full"] += 1
        return VpResult(pairs, pairs, matrix.select("locus"), matrix.select("locus"), pairs, 0.3, 0.3, {"loci": 4})

    def compare_with(full, high, cfg, scratch, places, folder):
        calls["comparison"] += 1
        assert full.counts == {"loci": 4} and full.pairs.count() == 1
        return spark.createDataFrame([(10, 100, 0.1, 0.5, 7, 0.4, "chr1", "strengthened")], PAIRS)

    run = lambda: run_backgrounds(m, [10, 11, 12], VpConfig(), HighOrderConfig(), f"file://{tmp_path}/b", analyse=analyse, compare_with=compare_with)
    assert run().count() == 6 and calls == {"full": 1, "subgroup": 6, "comparison": 6}
    assert run().filter("status = 'skipped' and locus1 = 10").count() == 6 and calls == {"full": 1, "subgroup": 6, "comparison": 6}
    delete(spark, f"file://{tmp_path}/b/12/0/marker.json")
    assert run().count() == 6 and calls == {"full": 1, "subgroup": 7, "comparison": 7}


def test_files_to_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.choice(list("AT"), (12, 40))
    base[1::2] = np.where(rng.random((6, 40)) < 0.1, base[1::2], base[::2])
    (tmp_path / "m.tsv").write_text("\n".join(["\t".join(["locus", *[f"s{i}" for i in range(40)]]), *["\t".join([str(1000 + 90_000 * i), *r]) for i, r in enumerate(base)]]) + "\n")
    (tmp_path / "w.csv").write_text("sample,wet\n" + "".join(f"s{i},{1 + i % 2}\n" for i in range(40)))
    m, w = str(tmp_path / "m.tsv"), str(tmp_path / "w.csv")
    whole = pairs_from_files(spark, m, w, 0.2, str(tmp_path / "p.parquet")).count()
    assert whole > 0 and read_pairs(spark, str(tmp_path / "p")).count() == whole  # the Parquet beside the name
    assert sum(pairs_from_files(spark, m, w, 0.2, places=p).count() for p in ((0, 5), (5, 12))) == whole
    r = analysis_from_files(spark, m, str(tmp_path / "out"), VpConfig(k=0.2, threshold=0.2), w)
    assert r.counts["loci"] == 12 and r.counts["samples"] == 40 and r.counts["final_pairs"] == spark.read.parquet(str(tmp_path / "out/final_pairs")).count() > 0
    assert spark.read.parquet(str(tmp_path / "out/restored_pairs")).count() >= r.counts["final_pairs"]


def test_genes_are_annotated_by_their_places(spark):
    total = 5_165_770
    places = spark.createDataFrame([(total + 5, 150, 100, 200, None), (total + 6, 450, 400, 500, None), (total + 7, 4_000_050, 4_000_000, 4_000_100, None)], "locus_id long, mid long, start long, end long, contig string")
    pairs = spark.createDataFrame([(90, total + 5, 0.5), (total + 5, total + 6, 0.6), (total + 5, total + 7, 0.7), (10, 20_000, 0.4), (5, total + 9, 0.9)], "locus1 long, locus2 long, v double")
    got = {(r.locus1, r.locus2): (r.geno_dis, r.chrom, r.LD) for r in gwes.annotate(pairs, places=places).collect()}
    assert got == {(90, total + 5): (10, "chr1", 1), (total + 5, total + 6): (200, "chr1", 1), (total + 5, total + 7): (-1, "chr1", 0), (10, 20_000): (19_990, "chr1", 0), (5, total + 9): (-1, "chr1", 0)}
    assert {r.locus2: r.gene_chrom for r in gwes.gene_pair_chromosome(pairs, places).collect()} == {total + 6: "chr1", total + 7: None}
    assert gwes.annotate(pairs).filter("geno_dis = -2").count() == 4
    assert {r.locus1 for r in gwes.by_chromosome(pairs.toDF("a", "b", "c"), places=places).collect()} == {90, 10}


def test_outliers_with_resampling_and_another_scorer(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (40, 50))
    x[1] = x[0]
    df = spark.createDataFrame([(10_000 * i + 1, i, [int(v) for v in r]) for i, r in enumerate(x)], "locus long, row_pos long, x array<tinyint>")
    w = spark.range(50).select(F.col("id").cast("int").alias("sample_pos"), F.lit(1.0).alias("weight"))
    scored = all_pairs(df, w, 0.0)
    kept, tried, t = stability.gwes_bootstrap(scored, df, w, 50, replicates=20)
    assert (1, 10_001) in {(r.locus1, r.locus2) for r in kept.collect()} and tried.count() >= kept.count() and t < 1
    never = lambda p, *a: p.select("locus1", "locus2", F.lit(False).alias("stable"))
    assert stability.gwes_bootstrap(scored, df, w, 50, scorer=never)[0].count() == 0


def test_changes_from_scores(spark):
    df = spark.createDataFrame([(str(0.5 + i / 1000), "0.5", 1) for i in range(-50, 51)] + [("0.9", "0.1", 1), ("0.1", "0.9", 1), ("x", "0.1", 1)], "v_h string, v_f string, geno_dis long")
    rows, (up, lo) = thresholds.changes(df)
    assert [r.direction for r in rows.orderBy("diff").collect() if r.direction] == ["weakened", "strengthened"] and lo < -0.1 < 0.1 < up
    assert thresholds.changes(df, fixed=(float("inf"), -0.04))[0].filter("direction = 'strengthened'").count() == 0
    assert thresholds.changes(df, outlier="kde")[0].filter("direction is not null").count() >= 2
    flat = spark.createDataFrame([(i, i + 7000, 0.2, "chr1") for i in range(30)], "locus1 long, locus2 long, diff double, chrom string")
    with pytest.raises(ValueError, match="no spread"):
        thresholds.require_spread(flat, "chrom")


def test_positions_of_a_hot_order_column_and_quantiles(spark):
    rows = [(1, 5, i, float(v)) for i, v in enumerate(np.random.default_rng(1).permutation(3000))] + [(None, 5, 1, 0.5), (2, 9, 1, 0.1)]
    df = spark.createDataFrame(rows, "g long, locus1 long, locus2 long, x double")
    got = ranks.positions(df, ["g"], ["locus1", "locus2"], "at", "n").collect()
    assert all(r.at == (r.locus2 if r.g == 1 else 0) and r.n == (3000 if r.g == 1 else 1) for r in got)
    v = np.array([r[3] for r in rows])
    for cells in (2, 1024):
        assert ranks.quantiles(df, "x", (0.0, 0.25, 0.5, 0.99, 1.0), cells) == pytest.approx(list(np.quantile(v, (0.0, 0.25, 0.5, 0.99, 1.0))))
    assert ranks.quantiles(df.limit(0), "x", (0.5,)) is None


def test_salted_restoration_of_a_hot_pattern(spark, monkeypatch):
    parts = ranks.bounded_parts
    monkeypatch.setattr(patterns, "bounded_parts", lambda m, key: parts(m, key, rows_per_task=7, hot_keys=100))
    rows = [(i, i, 0, 60) for i in range(60)] + [(100 + i, 100 + i, 100, 3) for i in range(3)]
    m = spark.createDataFrame([(*r, 0.5) for r in rows], "locus long, row_position long, representative long, pattern_size long, within_pattern_v double")
    pairs = spark.createDataFrame([(0, 100, 0.5)], "locus1 long, locus2 long, v double")
    assert patterns.restore_between(pairs, m).distinct().count() == 180 and patterns.restore_within(m, 0.4).distinct().count() == 60 * 59 // 2 + 3


def comparison(spark, bimodal):
    rng = np.random.default_rng(2026)
    n = 1500
    d = np.concatenate([rng.normal(-0.5, 0.08, n // 2), rng.normal(0.5, 0.08, n // 2)]) if bimodal else rng.normal(0, 0.18, n)
    rows = [(i, i + 7000, float(x), 1000, "chr1") for i, x in enumerate(d)] + [(4_000_000 + i, 4_100_000 + i, float(x), 1000, "chr2") for i, x in enumerate(rng.normal(0, 0.18, n))]
    return spark.createDataFrame([(*r, 0) for r in rows], "locus1 long, locus2 long, diff double, geno_dis long, chrom string, extra int")


@pytest.mark.parametrize("method", ["auto", "iqr", "quantile"])
def test_all_methods_run(spark, method):
    cfg = HighOrderConfig(method=method, bootstrap=20, sample_size=1000)
    r = thresholds.select_auto(comparison(spark, True), "chrom", cfg)
    t = {x.chrom: x for x in r.thresholds.collect()}
    assert set(t) == {"chr1", "chr2"} and r.rows.count() == 3000
    assert t["chr2"].stable_upper >= 0.15 and t["chr2"].stable_lower <= -0.15
    if method == "auto":
        assert t["chr1"].threshold_method == "directional_combination" and t["chr2"].threshold_method.startswith("iqr")
    with pytest.raises(ValueError):
        thresholds.select_auto(comparison(spark, False).limit(500), "chrom", HighOrderConfig(bootstrap=20)).rows


def test_bimodality(spark):
    got = {r.chrom: r for r in thresholds.bimodality(comparison(spark, True), "chrom").collect()}
    assert got["chr1"].bimodal and not got["chr2"].bimodal
    assert abs(got["chr1"].left_mode + 0.5) < 0.06 and abs(got["chr1"].right_mode - 0.5) < 0.06


def test_positions_and_draws(spark):
    df = comparison(spark, False)
    n = thresholds.numbered(df.select("chrom", "locus1", "locus2", "diff"), "chrom", ["locus1", "locus2"]).collect()
    for c in ("chr1", "chr2"):
        rows = sorted((r.locus1, r.at) for r in n if r.chrom == c)
        assert [a for _, a in rows] == list(range(1500))


def test_iqr_and_kde_thresholds(spark):
    v = np.random.default_rng(1).beta(2, 8, 500)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    q1, q3 = np.quantile(v, [0.25, 0.75])
    assert gwes.iqr_threshold(df, 2.9) == pytest.approx(q3 + 3 * (q3 - q1)) and gwes.iqr_threshold(df, 0.4) == 0.4
    h = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min(), v.max(), 512)
    assert gwes.kde_peak(df) == pytest.approx(grid[np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(1).argmax()])
    assert gwes.kde_peak(df.limit(1)) is None and gwes.iqr_threshold(df.limit(0)) == 0


def test_adaptive_threshold(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, i, [int(v) for v in r]) for i, r in enumerate(rng.integers(0, 2, (60, 24)))], "locus long, row_pos long, x array<tinyint>")
    w = spark.range(24).select(F.col("id").cast("int").alias("sample_pos"), F.lit(1.0).alias("weight"))
    r = stability.adaptive_threshold(df, w, target=500, sample=2000, floor=0.0)
    assert r["total_pairs"] == 1770 and r["retained"] <= 500 * 0.6 / 1770
    assert stability.adaptive_threshold(df, w, target=10**9, sample=2000)["threshold"] == 0.3
    b = stability.pair_bootstrap(df.select(F.col("locus").alias("locus1"), (F.col("locus") + 1).alias("locus2")).filter("locus2 < 60"), df, w, 0.2, 24, 20).collect()
    assert len(b) == 59 and all(x.bootstrap_valid_count == 20 and 0 <= x.bootstrap_stability <= 1 for x in b)


def test_stream_runs_new_files_once(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    run = lambda df, i: seen.extend(r.locus for r in df.collect())
    for locus in (7, 8):
        spark.createDataFrame([(0, locus)], "ordinal long, locus long").write.mode("append").parquet(src)
        run_stream(spark, src, str(tmp_path / "ck"), run)
    assert seen == [7, 8]


def test_short_tails_are_kept_or_refused(spark):
    """Groups: both tails long, the negative one short, both short."""
    value = {"a": lambda i: (-1) ** i * (0.3 + i / 1000), "b": lambda i: (0.3 + i / 1000) * (-1 if i < 20 else 1), "c": lambda i: (-1) ** i * 0.1}
    rows = [(i, i + 7000, float(value[g](i)), g) for g, n in (("a", 300), ("b", 300), ("c", 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "locus1 long, locus2 long, diff double, g string")
    cfg = HighOrderConfig(bootstrap=20, sample_size=1000, k_upper=0, k_lower=0)
    tails = thresholds.stable(thresholds.bootstrap_tails(df, "g", cfg), "g", cfg)
    assert {r.g: (r.stable_upper is None, r.stable_lower is None) for r in tails.collect()} == {"a": (False, False), "b": (False, True)}
    iqr = thresholds.stable(thresholds.bootstrap_fences(df, "g", cfg), "g", cfg)
    out = {r.g: r for r in thresholds.combine(iqr, tails, thresholds.extremes(df, "g"), "g").collect()}
    assert set(out) == {"a", "b", "c"} and out["b"].upper_source == "quantile_bootstrap" and out["b"].lower_source == "iqr_bootstrap_short_tail"
    assert len(out["b"].lowers) == 20 and out["b"].stable_lower == {r.g: r.stable_lower for r in iqr.collect()}["b"]
    with pytest.raises(ValueError, match="tail"):
        thresholds.select_auto(df.filter("g = 'b'"), "g", HighOrderConfig(method="quantile", bootstrap=20, sample_size=1000))
    two = spark.createDataFrame([(i, i + 7000, 0.5 + i / 1e4 if i < 120 else -0.5 - i / 1e4, "x") for i in range(180)], "locus1 long, locus2 long, diff double, g string")
    with pytest.raises(ValueError, match="tail"):
        thresholds.select_auto(two, "g", HighOrderConfig(bootstrap=20, sample_size=1000, min_rows=1))


def test_bootstrap_queries_draw_by_default_settings(spark):
    """Brute force over all 200 replicates of a group's full size."""
    from hashlib import md5

    from lociloom.queries import highorder as Q

    assert Q.CFG == HighOrderConfig() and (Q.CFG.bootstrap, Q.CFG.sample_size) == (200, 100_000)
    v = np.random.default_rng(5).normal(0.05, 0.4, 1200)
    df = spark.createDataFrame([(i, i + 7000, float(x), "g") for i, x in enumerate(v)], "locus1 long, locus2 long, diff double, g string")
    ups = []
    for r in range(200):
        q1, q3 = np.quantile(v[[int(md5(f"b:{r}:{i}".encode()).hexdigest()[:8], 16) % 1200 for i in range(1200)]], [0.25, 0.75])
        ups.append(max(max(q3, 0) + 1.5 * (q3 - q1), 0.15))
    got = thresholds.stable(thresholds.bootstrap_fences(df, "g", Q.CFG), "g", Q.CFG).first()
    assert np.allclose(sorted(ups), got.uppers) and got.stable_upper == pytest.approx(np.quantile(ups, 0.8))
