"""Queries of subgroup comparisons over df_merged and of the whole pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociloom.config import HighOrderConfig, VpConfig
from lociloom.operators import compare
from lociloom.operators import thresholds as T
from lociloom.plans import highorder as H
from lociloom.plans.batch import shard
from lociloom.plans.tiled import selected_in_tiles
from lociloom.plans.vp import VpResult, prepared, restore_physical, run_vp
from lociloom.queries.fixtures import CALLS, COMPARISON, all_pairs_sql, annotated_sql, binary_sql, comparison, gene_table, genes_sql, snp, weights
from lociloom.queries.tables import table
from lociloom.scratch import Scratch

CFG = HighOrderConfig()


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Comparison rows with a chromosome, written once; a threshold group is a background's chromosome."""
    return Scratch(spark, "ho").save(comparison(spark, d).filter("chrom is not null"), "rows")


def chromosome_class_highorder(spark: SparkSession, d: str) -> DataFrame:
    return comparison(spark, d).select("background", "locus1", "locus2", "geno_dis", "chrom")


def diff_iqr_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    up, lo = T.plain_fences(rows, "diff", 1.0, 2.0)
    way = F.when(F.col("diff") > up, "strengthened").when(F.col("diff") < lo, "weakened")
    return rows.select("background", "locus1", "locus2", F.round("diff", 6).alias("diff"), way.alias("direction")).filter("direction is not null")


def diff_histogram(spark: SparkSession, d: str) -> DataFrame:
    return T.histogram(_rows(spark, d), "chrom").select("chrom", "bin", F.round("centre", 6).alias("centre"), "n")


def smoothed_histogram(spark: SparkSession, d: str) -> DataFrame:
    return T.smoothed(T.histogram(_rows(spark, d), "chrom"), "chrom").select("chrom", "bin", F.round("height", 6).alias("height"))


def bimodality(spark: SparkSession, d: str) -> DataFrame:
    b = T.bimodality(_rows(spark, d), "chrom")
    return b.select("chrom", *[F.round(c, 6).alias(c) for c in ("left_mode", "right_mode", "valley", "valley_ratio", "negative", "positive")], "bimodal")


def bootstrap_iqr_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """At default settings, by background's chromosome."""
    t = T.stable(T.bootstrap_fences(_rows(spark, d), "g", CFG), "g", CFG)
    return t.select("g", F.round("stable_upper", 9).alias("stable_upper"), F.round("stable_lower", 9).alias("stable_lower"))


def tail_quantile_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Every group; the threshold of a short tail is null and its source says so."""
    rows = _rows(spark, d)
    t = T.extremes(rows, "g").select("g").join(T.stable(T.bootstrap_tails(rows, "g", CFG), "g", CFG), "g", "left")
    source = lambda c: F.when(F.col(c).isNull(), "short_tail").otherwise("quantile_bootstrap")
    return t.select("g", F.round("stable_upper", 9).alias("stable_upper"), F.round("stable_lower", 9).alias("stable_lower"), source("stable_upper").alias("upper_source"), source("stable_lower").alias("lower_source"))


def directional_combine(spark: SparkSession, d: str) -> DataFrame:
    """Every group; where a tail is short, its IQR threshold stays and the source says so."""
    rows = _rows(spark, d)
    iqr, tails = T.stable(T.bootstrap_fences(rows, "g", CFG), "g", CFG), T.stable(T.bootstrap_tails(rows, "g", CFG), "g", CFG)
    t = T.combine(iqr, tails, T.extremes(rows, "g"), "g")
    return t.select("g", F.round("stable_upper", 9).alias("stable_upper"), F.round("stable_lower", 9).alias("stable_lower"), "upper_source", "lower_source")


def stability_annotate(spark: SparkSession, d: str) -> DataFrame:
    s = Scratch(spark, "stab")
    rows = _rows(spark, d)
    t = s.save(T.stable(T.bootstrap_fences(rows, "chrom", CFG), "chrom", CFG), "thresholds")
    out = T.annotate_stability(rows, t, "chrom", CFG, inclusive=False)
    return out.select("background", "locus1", "locus2", F.round("diff", 6).alias("diff"), F.round("stability", 6).alias("stability"), "direction")


def select_auto(spark: SparkSession, d: str) -> DataFrame:
    """The automatic method per chromosome."""
    out = T.select_auto(_rows(spark, d), "chrom", CFG).rows
    return out.filter("direction <> 'not_selected'").select("background", "locus1", "locus2", F.round("diff", 6).alias("diff"), "direction")


def kde_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    one, two = T.kde_difference(rows), T.kde_difference(rows, two_sided=True)
    return spark.createDataFrame([("symmetric", *(round(float(x), 6) for x in one)), ("two_sided", *(round(float(x), 6) for x in two))], "rule string, upper double, lower double")


def first_known_scores(spark: SparkSession, d: str) -> DataFrame:
    """Per pair the scores of its first background that has them, each column for itself."""
    m = table(spark, d, "df_merged").filter(F.col("locus1").isNotNull() & F.col("locus2").isNotNull())
    ok = lambda c: F.when(F.col(c).between(0, 1) & ~F.isnan(c), F.col(c)).alias(c)
    return compare.first_known(m.select(F.least("locus1", "locus2").alias("locus1"), F.greatest("locus1", "locus2").alias("locus2"), "background", ok("v_f"), ok("v_h")).groupBy("locus1", "locus2", "background").agg(F.min("v_f").alias("v_f"), F.min("v_h").alias("v_h")), "background", ["v_f", "v_h"])


VP = VpConfig(weight_model="NW", threshold=0.1, maf=0.05)


def _analysed(spark: SparkSession, d: str, s: Scratch) -> tuple[VpResult, DataFrame]:
    """The whole analysis of the given allele matrix with its given weights, and the places of its genes."""
    m = s.save(snp(spark, d), "snp")
    genes = s.save(gene_table(spark, d, m), "genes")
    return run_vp(m, VP, s, weights(spark, d), places=genes), genes


def vp_pipeline(spark: SparkSession, d: str) -> DataFrame:
    r, _ = _analysed(spark, d, Scratch(spark, "vp"))
    return r.pairs.select("locus1", "locus2", F.round("v", 6).alias("v"), "geno_dis", F.col("LD").cast("int").alias("LD"))


def vp_restored(spark: SparkSession, d: str) -> DataFrame:
    """Its final pairs as pairs of all loci."""
    r, genes = _analysed(spark, d, Scratch(spark, "vpr"))
    return restore_physical(r, VP, places=genes).select("locus1", "locus2", F.round("v", 6).alias("v"), "geno_dis", "restoration_source")


def highorder_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The first background's major state against the whole data, selected by the IQR bootstrap and restored."""
    s = Scratch(spark, "high")
    m = s.save(snp(spark, d), "snp")
    full = prepared(m, VP, s)
    first = shard(table(spark, d, "backgrounds")).join(m.select("locus"), "locus", "left_semi").orderBy("ordinal").first()
    high = prepared(s.save(H.split_by_background(m, first.locus, 1), "sub"), VP, s)
    cfg = HighOrderConfig(method="iqr", bootstrap=50, sample_size=5000, min_rows=1, k_upper=0.5, k_lower=0.5, min_abs=0.05)
    chosen, thresholds = selected_in_tiles(full, high, cfg, s)
    return H.restore_selected(chosen, full, high, s.save(thresholds, "thresholds"), cfg, max_rows=None)


def highorder_batch(spark: SparkSession, d: str) -> DataFrame:
    """All backgrounds in both states, at default settings."""
    s = Scratch(spark, "batch")
    m = s.save(snp(spark, d), "snp")
    loci = [r.locus for r in shard(table(spark, d, "backgrounds")).orderBy("ordinal").collect()]  # a list of chosen loci is small
    return H.run_backgrounds(m, loci, VpConfig(), HighOrderConfig(), f"{s.root}/runs", s.save(gene_table(spark, d, m), "genes"), parallel=8)


QUERIES = {q.__name__: q for q in (chromosome_class_highorder, diff_iqr_filter, diff_histogram, smoothed_histogram, bimodality, bootstrap_iqr_thresholds, tail_quantile_bootstrap, directional_combine, stability_annotate, select_auto, kde_difference, first_known_scores, vp_pipeline, vp_restored, highorder_pipeline, highorder_batch)}

_R = f"{COMPARISON}, r AS (SELECT * FROM cmp WHERE chrom IS NOT NULL)"


def _boot(group: str, where: str, salt: str, name: str, least: int = 0) -> str:
    """CTE name(grp, rep, diff): hash draws per group and replicate."""
    return f"""{name}_n AS (SELECT {group} AS grp, diff, row_number() OVER (PARTITION BY {group} ORDER BY locus1, locus2, diff) - 1 AS at, count(*) OVER (PARTITION BY {group}) AS n FROM r WHERE {where}),
  {name}_g AS (SELECT grp, any_value(n) AS n FROM {name}_n WHERE n >= {least} GROUP BY grp),
  {name}_i AS (SELECT grp, n, unnest(range(least(n, {CFG.sample_size}))) AS i FROM {name}_g),
  {name}_d AS (SELECT grp, rep, ('0x' || substr(md5('{salt}:' || rep || ':' || i), 1, 8))::BIGINT % n AS at FROM {name}_i, range({CFG.bootstrap}) a(rep)),
  {name} AS (SELECT d.grp, d.rep, m.diff FROM {name}_d d JOIN {name}_n m ON m.grp = d.grp AND m.at = d.at)"""


def _fences(group: str) -> str:
    """CTEs fe(grp, rep, up, lo) and fs(grp, stable_upper, stable_lower)."""
    return f"""{_boot(group, 'true', 'b', 'bo')}, qq AS (SELECT grp, rep, quantile_cont(diff, 0.25) AS q1, quantile_cont(diff, 0.75) AS q3 FROM bo GROUP BY ALL),
  fe AS (SELECT grp, rep, greatest(greatest(q3, 0) + 1.5 * 1 * (q3 - q1), 0.15) AS up, least(least(q1, 0) - 1.5 * 2 * (q3 - q1), -0.15) AS lo FROM qq),
  fs AS (SELECT grp, quantile_cont(up, 0.8) AS stable_upper, quantile_cont(lo, 0.2) AS stable_lower FROM fe GROUP BY grp)"""


def _tails(group: str) -> str:
    """CTEs te(grp, rep, up) and tf(grp, rep, lo) of the tails' quantiles and ts(grp, stable_upper, stable_lower), null for a short tail."""
    return f"""{_boot(group, 'diff > 0', 'p', 'bp', 100)}, {_boot(group, 'diff < 0', 'n', 'bn', 100)},
  te AS (SELECT grp, rep, quantile_cont(diff, 0.95) AS up FROM bp GROUP BY ALL), tf AS (SELECT grp, rep, quantile_cont(diff, 0.05) AS lo FROM bn GROUP BY ALL),
  ts AS (SELECT e.grp, u.t AS stable_upper, l.t AS stable_lower FROM (SELECT DISTINCT {group} AS grp FROM r) e LEFT JOIN (SELECT grp, quantile_cont(up, 0.8) AS t FROM te GROUP BY grp) u ON u.grp = e.grp
    LEFT JOIN (SELECT grp, quantile_cont(lo, 0.2) AS t FROM tf GROUP BY grp) l ON l.grp = e.grp)"""


_COMBINED = """en AS (SELECT grp, min(diff) AS least_, max(diff) AS most, count(*) AS n FROM bo_n GROUP BY grp),
  jn AS (SELECT grp, fs.stable_upper AS iu, fs.stable_lower AS il, ts.stable_upper AS qu, ts.stable_lower AS ql, least_, most, fs.stable_upper <= most AND fs.stable_upper <= 1 AS oku,
    fs.stable_lower >= least_ AND fs.stable_lower >= -1 AS okl FROM fs JOIN ts USING (grp) JOIN en USING (grp)),
  cb AS (SELECT grp, CASE WHEN oku AND qu > iu THEN qu ELSE iu END AS stable_upper, CASE WHEN okl AND ql < il THEN ql ELSE il END AS stable_lower,
    CASE WHEN NOT oku THEN 'iqr_bootstrap_out_of_range_empty' WHEN qu IS NULL THEN 'iqr_bootstrap_short_tail' WHEN qu > iu THEN 'quantile_bootstrap' ELSE 'iqr_bootstrap' END AS upper_source,
    CASE WHEN NOT okl THEN 'iqr_bootstrap_out_of_range_empty' WHEN ql IS NULL THEN 'iqr_bootstrap_short_tail' WHEN ql < il THEN 'quantile_bootstrap' ELSE 'iqr_bootstrap' END AS lower_source FROM jn)"""
_HIST = """ends AS (SELECT chrom, least(-1, min(diff)) AS lo, greatest(1, max(diff)) AS hi FROM r GROUP BY chrom),
  hc AS (SELECT chrom, least(127, floor((diff - lo) / ((hi - lo) / 128)))::INT AS bin, count(*) AS n FROM r JOIN ends USING (chrom) GROUP BY ALL),
  hi AS (SELECT e.chrom, i::INT AS bin, lo + (i + 0.5) * (hi - lo) / 128 AS centre, coalesce(n, 0) AS n FROM ends e CROSS JOIN range(128) t(i) LEFT JOIN hc ON hc.chrom = e.chrom AND hc.bin = i)"""
_SMOOTH = """k AS (SELECT i - 8 AS k, exp(-0.5 * ((i - 8) / 2.0) ** 2) / sum(exp(-0.5 * ((i - 8) / 2.0) ** 2)) OVER () AS w FROM range(17) t(i)),
  sm AS (SELECT h.chrom, h.bin, any_value(h.centre) AS centre, sum(o.n * w) AS height FROM hi h CROSS JOIN k JOIN hi o ON o.chrom = h.chrom AND o.bin = least(greatest(h.bin + k, 0), 127) GROUP BY h.chrom, h.bin)"""

_BIMODAL = """lx AS (SELECT chrom, centre AS lm, height AS lh, bin AS lb FROM sm WHERE centre < 0 QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY round(height, 9) DESC, bin) = 1),
  hx AS (SELECT chrom, centre AS rm, height AS rh, bin AS rb FROM sm WHERE centre > 0 QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY round(height, 9) DESC, bin) = 1),
  vx AS (SELECT chrom, any_value(lm) AS lm, any_value(rm) AS rm, min(height) AS valley, any_value(least(lh, rh)) AS peak FROM sm JOIN lx USING (chrom) JOIN hx USING (chrom) WHERE bin BETWEEN lb AND rb GROUP BY chrom),
  sx AS (SELECT chrom, avg((diff < 0)::INT) AS negative, avg((diff > 0)::INT) AS positive FROM r GROUP BY chrom),
  bm AS (SELECT *, negative >= 0.05 AND positive >= 0.05 AND lm <= -0.15 AND rm >= 0.15 AND rm - lm >= 0.3 AND valley / peak <= 0.5 AS bimodal FROM vx JOIN sx USING (chrom))"""


def _kde(where: str, name: str) -> str:
    """CTE name(peak, width): the density's peak with a bandwidth of 0.3 standard deviations, and 1.5 IQR within [0.15, 0.55]."""
    return f"""{name}_x AS (SELECT diff FROM r WHERE {where}), {name}_s AS (SELECT min(diff) AS lo, max(diff) AS hi, 0.3 * stddev_samp(diff) AS h, least(greatest(1.5 * (quantile_cont(diff, 0.75) - quantile_cont(diff, 0.25)), 0.15), 0.55) AS width FROM {name}_x),
  {name}_g AS (SELECT i, any_value(lo + i * ((hi - lo) / 511)) AS place, sum(exp(-0.5 * ((lo + i * ((hi - lo) / 511) - diff) / h) ** 2)) AS y FROM {name}_x CROSS JOIN {name}_s CROSS JOIN range(512) t(i) GROUP BY i),
  {name} AS (SELECT (SELECT arg_max(place, y) FROM {name}_g) AS peak, width FROM {name}_s)"""


_VP = f"""{CALLS}, {binary_sql('snp', 'sb')}, {genes_sql('SELECT DISTINCT locus AS x FROM snp')},
  kp AS (SELECT locus FROM sb GROUP BY locus HAVING least(sum(x), count(*) - sum(x)) / count(*) >= 0.05 AND least(sum(x), count(*) - sum(x)) >= 5),
  bt AS (SELECT locus, string_agg(x::VARCHAR, '' ORDER BY sample_pos) AS bits FROM sb WHERE locus IN (SELECT locus FROM kp) GROUP BY locus),
  rp AS (SELECT min(locus) AS locus FROM bt GROUP BY bits), vb AS (SELECT * FROM sb WHERE locus IN (SELECT locus FROM rp)), {all_pairs_sql('vb', 'weights')},
  sk AS (SELECT * FROM sc WHERE v >= 0.1), an AS ({annotated_sql('sk')}),
  th AS (SELECT quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS t FROM an WHERE (chrom = 'chr1' AND geno_dis > 5000) OR (chrom = 'chr2' AND geno_dis > 17500)),
  fin AS (SELECT an.* FROM an CROSS JOIN th WHERE v > t AND ((chrom = 'chr1' AND geno_dis > 5000) OR (chrom = 'chr2' AND geno_dis > 17500) OR geno_dis = -1))"""

ORACLES = {
    "chromosome_class_highorder": f"WITH {COMPARISON} SELECT background, locus1, locus2, geno_dis, chrom FROM cmp",
    "diff_iqr_filter": f"""WITH {_R}, q AS (SELECT quantile_cont(diff, 0.25) AS q1, quantile_cont(diff, 0.75) AS q3 FROM r),
        f AS (SELECT greatest(q3 + 1.5 * (q3 - q1), 0.15) AS u, least(q1 - 3 * (q3 - q1), -0.15) AS l FROM q)
        SELECT background, locus1, locus2, round(diff, 6) AS diff, CASE WHEN diff > u THEN 'strengthened' ELSE 'weakened' END AS direction FROM r CROSS JOIN f WHERE diff > u OR diff < l""",
    "diff_histogram": f"WITH {_R}, {_HIST} SELECT chrom, bin, round(centre, 6) AS centre, n FROM hi",
    "smoothed_histogram": f"WITH {_R}, {_HIST}, {_SMOOTH} SELECT chrom, bin, round(height, 6) AS height FROM sm",
    "bimodality": f"""WITH {_R}, {_HIST}, {_SMOOTH}, {_BIMODAL} SELECT chrom, round(lm, 6) AS left_mode, round(rm, 6) AS right_mode, round(valley, 6) AS valley, round(valley / peak, 6) AS valley_ratio,
        round(negative, 6) AS negative, round(positive, 6) AS positive, bimodal FROM bm""",
    "bootstrap_iqr_thresholds": f"WITH {_R}, {_fences('g')} SELECT grp AS g, round(stable_upper, 9) AS stable_upper, round(stable_lower, 9) AS stable_lower FROM fs",
    "tail_quantile_bootstrap": f"""WITH {_R}, {_tails('g')} SELECT grp AS g, round(stable_upper, 9) AS stable_upper, round(stable_lower, 9) AS stable_lower,
        CASE WHEN stable_upper IS NULL THEN 'short_tail' ELSE 'quantile_bootstrap' END AS upper_source, CASE WHEN stable_lower IS NULL THEN 'short_tail' ELSE 'quantile_bootstrap' END AS lower_source FROM ts""",
    "directional_combine": f"""WITH {_R}, {_fences('g')}, {_tails('g')}, {_COMBINED} SELECT grp AS g, round(stable_upper, 9) AS stable_upper, round(stable_lower, 9) AS stable_lower, upper_source, lower_source FROM cb""",
    "stability_annotate": f"""WITH {_R}, {_fences('chrom')}, us AS (SELECT grp, list_sort(list(up)) AS ups, list_sort(list(lo)) AS los FROM fe GROUP BY grp),
        st AS (SELECT background, locus1, locus2, diff, stable_upper, stable_lower, list_count(list_filter(ups, lambda x: x < diff)) / 200 AS us, list_count(list_filter(los, lambda x: x > diff)) / 200 AS ls FROM r JOIN us ON us.grp = chrom JOIN fs ON fs.grp = chrom)
        SELECT background, locus1, locus2, round(diff, 6) AS diff, round(greatest(us, ls), 6) AS stability,
          CASE WHEN diff > stable_upper AND us >= 0.8 THEN 'strengthened' WHEN diff < stable_lower AND ls >= 0.8 THEN 'weakened' ELSE 'not_selected' END AS direction FROM st""",
    "select_auto": f"""WITH {_R}, {_HIST}, {_SMOOTH}, {_BIMODAL}, {_fences('chrom')}, {_tails('chrom')}, {_COMBINED},
        th AS (SELECT cb.grp, coalesce(bimodal, false) AS two, CASE WHEN bimodal THEN cb.stable_upper ELSE fs.stable_upper END AS su, CASE WHEN bimodal THEN cb.stable_lower ELSE fs.stable_lower END AS sl,
          coalesce(bimodal, false) AND upper_source = 'quantile_bootstrap' AS qu, coalesce(bimodal, false) AND lower_source = 'quantile_bootstrap' AS ql FROM cb JOIN fs USING (grp) LEFT JOIN bm ON bm.chrom = cb.grp),
        ups AS (SELECT grp, list(up) AS l FROM (SELECT fe.grp, up FROM fe JOIN th USING (grp) WHERE NOT qu UNION ALL SELECT te.grp, up FROM te JOIN th USING (grp) WHERE qu) GROUP BY grp),
        los AS (SELECT grp, list(lo) AS l FROM (SELECT fe.grp, lo FROM fe JOIN th USING (grp) WHERE NOT ql UNION ALL SELECT tf.grp, lo FROM tf JOIN th USING (grp) WHERE ql) GROUP BY grp),
        st AS (SELECT background, locus1, locus2, diff, su, sl, two, list_count(list_filter(ups.l, lambda x: x < diff)) / 200 AS us, list_count(list_filter(los.l, lambda x: x > diff)) / 200 AS ls
          FROM r JOIN th ON th.grp = chrom JOIN ups ON ups.grp = chrom JOIN los ON los.grp = chrom),
        w AS (SELECT *, CASE WHEN (diff > su OR (two AND diff = su)) AND us >= 0.8 THEN 'strengthened' WHEN (diff < sl OR (two AND diff = sl)) AND ls >= 0.8 THEN 'weakened' END AS direction FROM st)
        SELECT background, locus1, locus2, round(diff, 6) AS diff, direction FROM w WHERE direction IS NOT NULL""",
    "kde_difference": f"""WITH {_R}, {_kde('true', 'a')}, med AS (SELECT greatest(0, quantile_cont(diff, 0.5)) AS c FROM r), {_kde('diff > (SELECT c FROM med)', 'u')}, {_kde('diff <= (SELECT c FROM med)', 'l')}
        SELECT 'symmetric' AS rule, round(a.peak + a.width, 6) AS upper, round(a.peak - a.width, 6) AS lower FROM a UNION ALL SELECT 'two_sided', round(u.peak + u.width, 6), round(l.peak - l.width, 6) FROM u CROSS JOIN l""",
    "vp_pipeline": f"""WITH {_VP} SELECT locus1, locus2, round(v, 6) AS v, geno_dis, (geno_dis >= 0 AND geno_dis < 3000)::INT AS "LD" FROM fin""",
    "vp_restored": f"""WITH {_VP}, pm AS (SELECT locus, bits, min(locus) OVER (PARTITION BY bits) AS rep FROM bt), en AS (SELECT locus, sum(x * weight) / sum(weight) AS p FROM sb JOIN weights USING (sample_pos) GROUP BY locus),
        phys AS (SELECT least(a.locus, b.locus) AS locus1, greatest(a.locus, b.locus) AS locus2, v, 'between' AS src FROM fin JOIN pm a ON a.rep = fin.locus1 JOIN pm b ON b.rep = fin.locus2
          UNION ALL SELECT a.locus, b.locus, sqrt(-(p * log2(p) + (1 - p) * log2(1 - p))), 'within' FROM pm a JOIN pm b ON a.bits = b.bits AND a.locus < b.locus JOIN en ON en.locus = a.rep
          WHERE p > 1e-12 AND p < 1 - 1e-12 AND sqrt(-(p * log2(p) + (1 - p) * log2(1 - p))) >= 0.1)
        SELECT locus1, locus2, round(v, 6) AS v, geno_dis, src AS restoration_source FROM ({annotated_sql('phys', 'v, src')})""",
    "first_known_scores": """WITH t AS (SELECT least(locus1, locus2) AS locus1, greatest(locus1, locus2) AS locus2, background, CASE WHEN v_f BETWEEN 0 AND 1 AND NOT isnan(v_f) THEN v_f END AS v_f,
        CASE WHEN v_h BETWEEN 0 AND 1 AND NOT isnan(v_h) THEN v_h END AS v_h FROM df_merged WHERE locus1 IS NOT NULL AND locus2 IS NOT NULL),
        u AS (SELECT locus1, locus2, background, min(v_f) AS v_f, min(v_h) AS v_h FROM t GROUP BY ALL)
        SELECT locus1, locus2, arg_min(v_f, background) FILTER (v_f IS NOT NULL) AS v_f, arg_min(v_h, background) FILTER (v_h IS NOT NULL) AS v_h FROM u GROUP BY ALL""",
}
