"""Queries of pair scores, distances, outlier thresholds, merging and restoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociloom.functions import distance as D
from lociloom.operators import compare, gwes, patterns, stability
from lociloom.operators import pairs as P
from lociloom.operators.matrix import binarise, marginals
from lociloom.functions.encode import keep_samples
from lociloom.plans.batch import shard
from lociloom.plans.highorder import background_mask, split_by_background
from lociloom.queries.fixtures import CALLS, EVENTS, HIGH_CLASS, PAIRS, STEPS, VECTORS, all_pairs_sql, annotated_sql, binary_sql, clean_pairs, distance_sql, event_matrix, gene_table, genes_sql, gwes_class_sql, score_sql, snp, step_weights, uniform, vector_matrix, weights
from lociloom.queries.tables import table
from lociloom.scratch import Scratch

GE_T, GB_T = 0.2, 0.3
LEVELS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("locus1", "locus2", F.round("v", 6).alias("v"))


def epistasis_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: take the major alleles of the given matrix, score all pairs with the given weights, keep the dependent ones."""
    return _rounded(P.all_pairs(binarise(snp(spark, d)), weights(spark, d), GE_T))


def epistasis_all(spark: SparkSession, d: str) -> DataFrame:
    """The same over the events of all users."""
    e, n = event_matrix(spark, d)
    return _rounded(P.all_pairs(binarise(e), uniform(spark, n), GE_T))


def weighted_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(P.all_pairs(vector_matrix(spark, d), step_weights(spark, 64), GB_T))


def block_kernel_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(P.all_pairs(vector_matrix(spark, d), step_weights(spark, 64), GB_T, tile=256))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Requested pairs: every vector with those of the next three ids."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("locus1"))
    return e.withColumn("locus2", F.explode(F.array(*[(F.col("locus1") + k) for k in (1, 2, 3)]))).join(e.select(F.col("locus1").alias("locus2")), "locus2", "left_semi")


def selected_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(P.selected_pairs(_neighbours(spark, d), vector_matrix(spark, d), step_weights(spark, 64)))


def score_survival(spark: SparkSession, d: str) -> DataFrame:
    s = P.selected_pairs(_neighbours(spark, d), vector_matrix(spark, d), step_weights(spark, 64)).select(F.round("v", 6).alias("v"))
    return stability.survival(s).select("v", "n", F.round("survival", 6).alias("survival"))


def adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    """By the default sample of pairs of the given matrix, for 2,000 pairs."""
    m = Scratch(spark, "adaptive").save(binarise(snp(spark, d)), "m")
    r = stability.adaptive_threshold(m, weights(spark, d), target=2000, floor=0.1)
    return spark.createDataFrame([(round(r["threshold"], 6), round(r["retained"], 6), r["total_pairs"])], "threshold double, retained double, total_pairs long")


def adaptive_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of the same sample, how many pairs to expect at and above 0.05, 0.1, .. 0.9."""
    m = Scratch(spark, "summary").save(binarise(snp(spark, d)), "m")
    return stability.threshold_summary(m, weights(spark, d), levels=LEVELS).select("threshold", F.round("retained", 6).alias("retained"), "expected_pairs")


def snp_distance(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("locus1"), F.col("locus2")
    dis = D.snp_distance(a, b)
    return clean_pairs(spark, d).select("locus1", "locus2", dis.alias("geno_dis"), D.ld_flag(dis).cast("int").alias("LD"))


def _genes(spark: SparkSession, d: str) -> DataFrame:
    return gene_table(spark, d, clean_pairs(spark, d).select(F.explode(F.array("locus1", "locus2")).alias("locus")))


def gene_places(spark: SparkSession, d: str) -> DataFrame:
    return _genes(spark, d)


def gene_distance(spark: SparkSession, d: str) -> DataFrame:
    return D.gene_distance(clean_pairs(spark, d).select("locus1", "locus2"), _genes(spark, d)).select("locus1", "locus2", "geno_dis")


def linear_circular_distance(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("locus1"), F.col("locus2")
    return clean_pairs(spark, d).select("locus1", "locus2", D.linear_distance(a, b).alias("linear"), D.linear_distance(a, b, 5_165_770).alias("circular"))


def chromosome_class_gwes(spark: SparkSession, d: str) -> DataFrame:
    return clean_pairs(spark, d).select("locus1", "locus2", D.gwes_class(F.col("locus1"), F.col("locus2")).alias("chrom"))


def gwes_iqr_threshold(spark: SparkSession, d: str) -> DataFrame:
    far = gwes.beyond_ld(gwes.annotate(clean_pairs(spark, d)))
    return spark.createDataFrame([(k, round(gwes.iqr_threshold(far, k), 6)) for k in (1, 2, 3)], "k int, threshold double")


def gwes_filter(spark: SparkSession, d: str) -> DataFrame:
    """With genes at their places."""
    s = Scratch(spark, "gwes")
    kept, _, _ = gwes.run_gwes(s.save(clean_pairs(spark, d), "pairs"), 1, places=s.save(_genes(spark, d), "genes"))
    return kept.select("locus1", "locus2", F.round("v", 6).alias("v"), "geno_dis", "chrom", F.col("LD").cast("int").alias("LD"))


def gwes_bases_only(spark: SparkSession, d: str) -> DataFrame:
    """Without a gene table: a pair with a gene has no distance and is dropped."""
    kept, _, _ = gwes.run_gwes(Scratch(spark, "gwesb").save(clean_pairs(spark, d), "pairs"), 1)
    return kept.select("locus1", "locus2", F.round("v", 6).alias("v"), "geno_dis", F.col("LD").cast("int").alias("LD"))


def gwes_by_chromosome(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a positive distance by the chromosome of comparisons, genes at their places."""
    out = gwes.by_chromosome(clean_pairs(spark, d), places=_genes(spark, d))
    return out.select("locus1", "locus2", F.round("v", 6).alias("v"), "geno_dis", "chrom")


def gene_pair_chromosome(spark: SparkSession, d: str) -> DataFrame:
    return gwes.gene_pair_chromosome(clean_pairs(spark, d).select("locus1", "locus2"), _genes(spark, d))


def gwes_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Outliers of the given matrix's pairs that last over 100 resamples of its samples."""
    s = Scratch(spark, "gwesboot")
    m = s.save(snp(spark, d), "snp")
    x, w, genes = s.save(binarise(m), "x"), weights(spark, d), s.save(gene_table(spark, d, m), "genes")
    _, tried, _ = stability.all_pair_gwes_bootstrap(x, w, 0.1, w.count(), places=genes)
    return tried.select("locus1", "locus2", F.round("v", 6).alias("v"), "geno_dis", "bootstrap_pass_count", F.round("bootstrap_v_mean", 6).alias("mean"), "stable")


def gwes_single_chr(spark: SparkSession, d: str) -> DataFrame:
    a = Scratch(spark, "gwes1").save(clean_pairs(spark, d), "pairs")
    kept, _ = gwes.run_gwes_single(a, 5_165_770, 1, 5000)
    return kept.select("locus1", "locus2", F.round("v", 6).alias("v"), "geno_dis")


def gwes_kde_threshold(spark: SparkSession, d: str) -> DataFrame:
    far = gwes.beyond_ld(gwes.annotate(clean_pairs(spark, d)))
    return spark.createDataFrame([(round(gwes.kde_peak(far), 6), round(gwes.kde_threshold(far, 0.1), 6))], "peak double, threshold double")


def plot_classes(spark: SparkSession, d: str) -> DataFrame:
    a = gwes.annotate(clean_pairs(spark, d))
    c = D.plot_class(F.col("locus1"), F.col("locus2"), F.col("v"), F.col("geno_dis"), 0.4, 5000)
    return a.groupBy(c.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("v"), 6).alias("most"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """final_pairs as the whole data's table, df_merged's subgroup scores as the other."""
    one = clean_pairs(spark, d)
    a, b = F.col("locus1"), F.col("locus2")
    m = table(spark, d, "df_merged").filter(F.col("v_h").between(0, 1) & ~F.isnan("v_h") & a.isNotNull() & b.isNotNull())
    two = m.groupBy(F.greatest(a, b).cast("string").alias("locus1"), F.least(a, b).cast("string").alias("locus2")).agg(F.max("v_h").alias("v"), F.max("geno_dis").alias("geno_dis"))
    return one.withColumn("geno_dis", D.snp_distance(a, b)), two


def merge_pairs_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return compare.merge_pairs(*_sides(spark, d)).select("locus1", "locus2", F.round("v1", 6).alias("v1"), F.round("v2", 6).alias("v2"), "geno_dis")


def first_per_pair(spark: SparkSession, d: str) -> DataFrame:
    """Where each unordered pair of df_merged occurs first, by background and piece."""
    m = table(spark, d, "df_merged").filter(F.col("locus1").isNotNull() & F.col("locus2").isNotNull() & F.col("background").isNotNull() & F.col("batch_no").isNotNull())
    return compare.first_per_pair(P.normalised(m.select("locus1", "locus2", "background", "batch_no")), ["background", "batch_no"])


def loci_labels(spark: SparkSession, d: str) -> DataFrame:
    return compare.loci_labels(clean_pairs(spark, d))


def missing_pairs(spark: SparkSession, d: str) -> DataFrame:
    one, two = _sides(spark, d)
    return compare.missing_pairs(two, one)


def _first_background(spark: SparkSession, d: str, m: DataFrame) -> int:
    return shard(table(spark, d, "backgrounds")).join(m.select("locus"), "locus", "left_semi").orderBy("ordinal").first().locus


def complete_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The given matrix against the samples in which its first background has the major state."""
    m = Scratch(spark, "complete").save(snp(spark, d), "snp")
    return _completed(spark, m, weights(spark, d), _first_background(spark, d, m))


def complete_comparison_all(spark: SparkSession, d: str) -> DataFrame:
    """The events of all users against those samples in which the first user has the major state."""
    e, n = event_matrix(spark, d)
    m = Scratch(spark, "complete").save(e, "events")
    return _completed(spark, m, uniform(spark, n), m.agg(F.min("locus")).first()[0])


def _completed(spark: SparkSession, m: DataFrame, w: DataFrame, background: int) -> DataFrame:
    s = Scratch(spark, "complete")
    full, high = s.save(binarise(m), "full"), s.save(binarise(split_by_background(m, background, 1)), "high")
    row = w.agg(F.array_sort(F.collect_list(F.struct("sample_pos", "weight")))["weight"].alias("w"))  # a weight per sample
    kept = row.crossJoin(background_mask(m, background)).select(F.posexplode(keep_samples(F.col("w"), F.col("mask"), 1)).alias("sample_pos", "weight"))
    wh = s.save(kept, "weights")
    return compare.scored_comparison(full, w, high, wh, 0.2, 0.25, digits=6)


def _collapsed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows and the pattern map of the given allele matrix with its weights."""
    s = Scratch(spark, "restore")
    x = s.save(binarise(snp(spark, d)).select("locus", "row_pos", "x"), "x")
    return x, s.save(patterns.collapse(marginals(x, weights(spark, d))), "map")


def restore_between(spark: SparkSession, d: str) -> DataFrame:
    """Without a guard: the pairs are restored where they are scored and never stored."""
    return _rounded(patterns.restored_pairs(*_collapsed(spark, d), weights(spark, d), 0.1))


def restore_within(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(patterns.restore_within(_collapsed(spark, d)[1], 0.1))


def pair_bootstrap_stability(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the given matrix over 100 replicates, the default."""
    return _resampled(spark, snp(spark, d), weights(spark, d), 0.2, 0.15)


def pair_bootstrap_all(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the events of all users."""
    e, n = event_matrix(spark, d)
    return _resampled(spark, e, uniform(spark, n), 0.2, 0.2)


def _resampled(spark: SparkSession, m: DataFrame, w: DataFrame, candidates: float, threshold: float) -> DataFrame:
    s = Scratch(spark, "boot")
    b = stability.all_pair_bootstrap(s.save(binarise(m), "x"), w, candidates, threshold, w.count(), digits=6)
    return b.select("locus1", "locus2", "bootstrap_pass_count", "bootstrap_valid_count", F.col("bootstrap_v_mean").alias("mean"), F.col("bootstrap_v_std").alias("std"), "stable")


QUERIES = {q.__name__: q for q in (epistasis_pairs, epistasis_all, complete_comparison_all, pair_bootstrap_all, weighted_pairs, block_kernel_pairs, selected_pairs, score_survival, adaptive_threshold, adaptive_summary, snp_distance, gene_places, gene_distance, linear_circular_distance, chromosome_class_gwes, gwes_iqr_threshold, gwes_filter, gwes_bases_only, gwes_by_chromosome, gene_pair_chromosome, gwes_bootstrap, first_per_pair, loci_labels, gwes_single_chr, gwes_kde_threshold, plot_classes, merge_pairs_full_outer, missing_pairs, complete_comparison, restore_between, restore_within, pair_bootstrap_stability)}

_GE = f"{EVENTS}, {binary_sql('ge', 'gx')}"
_SNPB = f"{CALLS}, {binary_sql('snp', 'sb')}"
_GB = f"{VECTORS}, {STEPS}"


def _selected_sql(want: str, binary: str, weights: str, name: str) -> str:
    """CTE name(locus1, locus2, v) for pairs of want, 0 where the reference has one state."""
    return f"""{name}_t AS (SELECT sum(weight)::DOUBLE AS total FROM {weights}),
  {name}_m AS (SELECT locus, sum(x * weight)::DOUBLE AS dp, list(x::DOUBLE ORDER BY sample_pos) AS xs, list((x * weight)::DOUBLE ORDER BY sample_pos) AS xw FROM {binary} JOIN {weights} USING (sample_pos) GROUP BY locus),
  {name}_p AS (SELECT w.locus1, w.locus2, list_dot_product(a.xw, b.xs) AS n11, a.dp AS dp_i, b.dp AS dp_j, total FROM {want} w JOIN {name}_m a ON a.locus = w.locus1 JOIN {name}_m b ON b.locus = w.locus2 CROSS JOIN {name}_t),
  {name} AS (SELECT locus1, locus2, coalesce(v, 0) AS v FROM ({score_sql(name + '_p')}))"""


_WANT = "want AS (SELECT a.vec_id::BIGINT AS locus1, b.vec_id::BIGINT AS locus2 FROM embeddings a JOIN embeddings b ON b.vec_id - a.vec_id BETWEEN 1 AND 3)"
_ANN = f"{PAIRS}, an AS (SELECT locus1, locus2, v, {distance_sql()} AS geno_dis, {gwes_class_sql()} AS chrom FROM fp), far AS (SELECT * FROM an WHERE (chrom = 'chr1' AND geno_dis > 5000) OR (chrom = 'chr2' AND geno_dis > 17500))"
_TH = "th AS (SELECT quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS t FROM far)"
_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_LIN = "abs(locus1 - locus2)"
_CIRC = f"CASE WHEN {_LIN} > 5165770 / 2 THEN 5165770 - {_LIN} ELSE {_LIN} END"
_SIDES = f"""{PAIRS}, s1 AS (SELECT *, nullif({distance_sql()}, -1) AS d FROM fp),
  s2 AS (SELECT least(locus1, locus2) AS locus1, greatest(locus1, locus2) AS locus2, max(v_h) AS v, nullif(max(geno_dis), -1) AS d FROM df_merged
    WHERE v_h BETWEEN 0 AND 1 AND NOT isnan(v_h) AND locus1 IS NOT NULL AND locus2 IS NOT NULL GROUP BY ALL)"""
_GENES = f"{PAIRS}, {genes_sql('SELECT locus1 AS x FROM fp UNION ALL SELECT locus2 FROM fp')}"
_MAP = f"""{_SNPB}, pt AS (SELECT locus, string_agg(x::VARCHAR, '' ORDER BY sample_pos) AS bits FROM sb GROUP BY locus), pm AS (SELECT locus, bits, min(locus) OVER (PARTITION BY bits) AS rep FROM pt)"""
_SAMPLED = f"""{_SNPB}, k AS (SELECT locus, row_number() OVER (ORDER BY locus) - 1 AS at FROM (SELECT DISTINCT locus FROM sb)), n AS (SELECT count(*) AS n FROM k),
        dr AS (SELECT i AS id, {_DRAW.format("'a:' || i || ':0'")} % n AS p, {_DRAW.format("'a:' || i || ':1'")} % n AS q FROM range(75064) t(i) CROSS JOIN n),
        once AS (SELECT least(p, q) AS p, greatest(p, q) AS q, min(id) AS id FROM dr WHERE p <> q GROUP BY 1, 2 ORDER BY id LIMIT 50000),
        want AS (SELECT a.locus AS locus1, b.locus AS locus2 FROM once JOIN k a ON a.at = p JOIN k b ON b.at = q), {_selected_sql('want', 'sb', 'weights', 'se')}"""


def _completed_sql(snp: str, binary: str, weights: str, background: str) -> str:
    """The comparison of a matrix with the samples in which a background has its major state."""
    return f"""bm AS (SELECT sample_pos FROM {binary} WHERE locus = ({background}) AND x = 1), ga AS (SELECT s.* FROM {snp} s JOIN bm USING (sample_pos)), {binary_sql('ga', 'hx')},
        hw AS (SELECT w.* FROM {weights} w JOIN bm USING (sample_pos)), {all_pairs_sql(binary, weights)}, {all_pairs_sql('hx', 'hw', '2')},
        want AS (SELECT locus1, locus2 FROM sc WHERE v >= 0.2 UNION SELECT locus1, locus2 FROM sc2 WHERE v >= 0.25), {_selected_sql('want', binary, weights, 'sf')}, {_selected_sql('want', 'hx', 'hw', 'sh')}
        SELECT locus1, locus2, round(sf.v, 6) AS v_f, round(sh.v, 6) AS v_h, round(sh.v - sf.v, 6) AS diff FROM sf JOIN sh USING (locus1, locus2)"""


def _replicates_sql(binary: str, weights: str) -> str:
    """CTE rv(locus1, locus2, r, v): scores of the pairs of c in 100 resamples of the samples."""
    return f"""ns AS (SELECT count(*) AS ns FROM {weights}), bag AS (SELECT r, {_DRAW.format("'s:' || r || ':' || i")} % ns AS sample_pos, count(*) AS m FROM ns, range(100) a(r), range(ns) b(i) GROUP BY ALL),
        bw AS (SELECT r, sample_pos, m * weight AS m, sum(m * weight) OVER (PARTITION BY r) AS total FROM bag JOIN {weights} USING (sample_pos)),
        j AS (SELECT c.locus1, c.locus2, r, sum(a.x * b.x * m)::DOUBLE AS n11, sum(a.x * m)::DOUBLE AS dp_i, sum(b.x * m)::DOUBLE AS dp_j, any_value(total)::DOUBLE AS total
          FROM c JOIN {binary} a ON a.locus = c.locus1 JOIN {binary} b ON b.locus = c.locus2 AND b.sample_pos = a.sample_pos JOIN bw ON bw.sample_pos = a.sample_pos GROUP BY ALL),
        rv AS (SELECT locus1, locus2, coalesce(v, 0) AS v FROM ({score_sql('j')}))"""


def _resampled_sql(binary: str, weights: str, candidates: float, threshold: float) -> str:
    return f"""{all_pairs_sql(binary, weights)}, c AS (SELECT locus1, locus2 FROM sc WHERE v >= {candidates}), {_replicates_sql(binary, weights)}
        SELECT locus1, locus2, count(*) FILTER (v >= {threshold}) AS bootstrap_pass_count, count(*) AS bootstrap_valid_count, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
          count(*) FILTER (v >= {threshold}) / 100 >= 0.8 AS stable FROM rv GROUP BY ALL"""


ORACLES = {
    "epistasis_pairs": f"WITH {_SNPB}, {all_pairs_sql('sb', 'weights')} SELECT locus1, locus2, round(v, 6) AS v FROM sc WHERE v >= {GE_T}",
    "epistasis_all": f"WITH {_GE}, {all_pairs_sql('gx', 'uw')} SELECT locus1, locus2, round(v, 6) AS v FROM sc WHERE v >= {GE_T}",
    "weighted_pairs": f"WITH {_GB}, {all_pairs_sql('gb', 'sw')} SELECT locus1, locus2, round(v, 6) AS v FROM sc WHERE v >= {GB_T}",
    "block_kernel_pairs": f"WITH {_GB}, {all_pairs_sql('gb', 'sw')} SELECT locus1, locus2, round(v, 6) AS v FROM sc WHERE v >= {GB_T}",
    "selected_pairs": f"WITH {_GB}, {_WANT}, {_selected_sql('want', 'gb', 'sw', 'se')} SELECT locus1, locus2, round(v, 6) AS v FROM se",
    "score_survival": f"""WITH {_GB}, {_WANT}, {_selected_sql('want', 'gb', 'sw', 'se')}, c AS (SELECT round(v, 6) AS v, count(*) AS c FROM se GROUP BY 1)
        SELECT v, (sum(c) OVER (ORDER BY v DESC))::BIGINT AS n, round(sum(c) OVER (ORDER BY v DESC) / sum(c) OVER (), 6) AS survival FROM c""",
    "adaptive_threshold": f"""WITH {_SAMPLED}, sv AS (SELECT v, count(*) OVER (ORDER BY v DESC RANGE UNBOUNDED PRECEDING) / count(*) OVER () AS s FROM se),
        t AS (SELECT greatest(min(v) FILTER (s <= least(1, 2000 * 0.6 / (n * (n - 1) / 2))), 0.1) AS t FROM sv CROSS JOIN n)
        SELECT round(any_value(t), 6) AS threshold, round(avg((v >= t)::INT), 6) AS retained, any_value(n * (n - 1) // 2) AS total_pairs FROM se CROSS JOIN t CROSS JOIN n""",
    "adaptive_summary": f"""WITH {_SAMPLED} SELECT l.t::DOUBLE AS threshold, round(avg((v >= l.t)::INT), 6) AS retained, ceil(any_value(n * (n - 1) // 2) * avg((v >= l.t)::INT))::BIGINT AS expected_pairs
        FROM se CROSS JOIN n CROSS JOIN (VALUES {', '.join(f'({t})' for t in LEVELS)}) l(t) GROUP BY l.t""",
    "snp_distance": f"WITH {PAIRS}, a AS (SELECT locus1, locus2, {distance_sql()} AS geno_dis FROM fp) SELECT *, (geno_dis >= 0 AND geno_dis < 3000)::INT AS \"LD\" FROM a",
    "gene_places": f"WITH {_GENES} SELECT * FROM pl",
    "gene_distance": f"WITH {_GENES} SELECT locus1, locus2, geno_dis FROM ({annotated_sql('fp')})",
    "linear_circular_distance": f"WITH {PAIRS} SELECT locus1, locus2, {_LIN} AS linear, {_CIRC} AS circular FROM fp",
    "chromosome_class_gwes": f"WITH {PAIRS} SELECT locus1, locus2, {gwes_class_sql()} AS chrom FROM fp",
    "gwes_iqr_threshold": f"WITH {_ANN} SELECT k::INT AS k, round(quantile_cont(v, 0.75) + 1.5 * k * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)), 6) AS threshold FROM far CROSS JOIN range(1, 4) t(k) GROUP BY k",
    "gwes_filter": f"""WITH {_GENES}, an AS ({annotated_sql('fp')}), far AS (SELECT * FROM an WHERE (chrom = 'chr1' AND geno_dis > 5000) OR (chrom = 'chr2' AND geno_dis > 17500)), {_TH}
        SELECT locus1, locus2, round(v, 6) AS v, geno_dis, chrom, (geno_dis >= 0 AND geno_dis < 3000)::INT AS "LD" FROM an CROSS JOIN th
        WHERE v > t AND ((chrom = 'chr1' AND geno_dis > 5000) OR (chrom = 'chr2' AND geno_dis > 17500) OR geno_dis = -1)""",
    "gwes_by_chromosome": f"WITH {_GENES}, an AS (SELECT * EXCLUDE (chrom) FROM ({annotated_sql('fp')})), hc AS (SELECT *, {HIGH_CLASS} AS chrom FROM an) SELECT locus1, locus2, round(v, 6) AS v, geno_dis, chrom FROM hc WHERE chrom IS NOT NULL",
    "gene_pair_chromosome": f"""WITH {_GENES} SELECT locus1, locus2, CASE WHEN (x.mid <= 3288558) = (y.mid <= 3288558) THEN CASE WHEN x.mid <= 3288558 THEN 'chr1' ELSE 'chr2' END END AS gene_chrom
        FROM fp LEFT JOIN pl x ON x.locus_id = locus1 LEFT JOIN pl y ON y.locus_id = locus2 WHERE locus1 > 5165770 AND locus2 > 5165770""",
    "gwes_bootstrap": f"""WITH {_SNPB}, {genes_sql('SELECT DISTINCT locus AS x FROM snp')}, {all_pairs_sql('sb', 'weights')}, sk AS (SELECT * FROM sc WHERE v >= 0.1), an AS ({annotated_sql('sk')}),
        th AS (SELECT quantile_cont(v, 0.75) + 3 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS t FROM an WHERE (chrom = 'chr1' AND geno_dis > 5000) OR (chrom = 'chr2' AND geno_dis > 17500)),
        c AS (SELECT an.*, t FROM an CROSS JOIN th WHERE v > t AND ((chrom = 'chr1' AND geno_dis > 5000) OR (chrom = 'chr2' AND geno_dis > 17500) OR geno_dis = -1)), {_replicates_sql('sb', 'weights')}
        SELECT locus1, locus2, round(any_value(c.v), 6) AS v, any_value(geno_dis) AS geno_dis, count(*) FILTER (rv.v >= t) AS bootstrap_pass_count, round(avg(rv.v), 6) AS mean, count(*) FILTER (rv.v >= t) / 100 >= 0.8 AS stable
        FROM rv JOIN c USING (locus1, locus2) GROUP BY ALL""",
    "first_per_pair": """SELECT least(locus1, locus2) AS locus1, greatest(locus1, locus2) AS locus2, min({'b': background, 'n': batch_no}).b AS background, min({'b': background, 'n': batch_no}).n AS batch_no FROM df_merged
        WHERE locus1 IS NOT NULL AND locus2 IS NOT NULL AND background IS NOT NULL AND batch_no IS NOT NULL GROUP BY 1, 2""",
    "loci_labels": f"WITH {PAIRS} SELECT DISTINCT x::VARCHAR AS label FROM (SELECT locus1 AS x FROM fp UNION ALL SELECT locus2 FROM fp)",
    "gwes_bases_only": f"""WITH {_ANN}, {_TH} SELECT locus1, locus2, round(v, 6) AS v, geno_dis, (geno_dis >= 0 AND geno_dis < 3000)::INT AS "LD" FROM an CROSS JOIN th
        WHERE v > t AND ((chrom = 'chr1' AND geno_dis > 5000) OR (chrom = 'chr2' AND geno_dis > 17500) OR geno_dis = -1)""",
    "gwes_single_chr": f"""WITH {PAIRS}, far AS (SELECT locus1, locus2, v, {_CIRC} AS geno_dis FROM fp WHERE {_CIRC} > 5000), {_TH}
        SELECT locus1, locus2, round(v, 6) AS v, geno_dis FROM far CROSS JOIN th WHERE v >= t""",
    "gwes_kde_threshold": f"""WITH {_ANN}, st AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * count(*) ** (-0.2) AS h FROM far),
        h AS (SELECT i, any_value(lo + i * (hi - lo) / 511) AS place, sum(exp(-0.5 * ((lo + i * ((hi - lo) / 511) - v) / h) ** 2)) AS y FROM far CROSS JOIN st CROSS JOIN range(512) t(i) GROUP BY i)
        SELECT round(arg_max(place, y), 6) AS peak, round(arg_max(place, y) + 0.1, 6) AS threshold FROM h""",
    "plot_classes": f"""WITH {_ANN} SELECT CASE WHEN geno_dis BETWEEN 0 AND 5000 THEN 'proximal' WHEN v > 0.4 THEN
        CASE (locus1 > 5165770)::INT + (locus2 > 5165770)::INT WHEN 0 THEN 'snp_snp' WHEN 1 THEN 'snp_gene' ELSE 'gene_gene' END ELSE 'common' END AS kind, count(*) AS n, round(max(v), 6) AS most FROM an GROUP BY 1""",
    "merge_pairs_full_outer": f"""WITH {_SIDES} SELECT locus1, locus2, round(coalesce(s1.v, -1), 6) AS v1, round(coalesce(s2.v, -1), 6) AS v2, coalesce(greatest(s1.d, s2.d), -1) AS geno_dis
        FROM s1 FULL JOIN s2 USING (locus1, locus2)""",
    "missing_pairs": f"WITH {_SIDES} SELECT locus1, locus2 FROM s1 ANTI JOIN s2 USING (locus1, locus2)",
    "complete_comparison": f"""WITH {_SNPB}, {_completed_sql('snp', 'sb', 'weights', 'SELECT arg_min(locus, ordinal) FROM backgrounds WHERE locus IN (SELECT locus FROM sb)')}""",
    "complete_comparison_all": f"WITH {_GE}, {_completed_sql('ge', 'gx', 'uw', 'SELECT min(locus) FROM ge')}",
    "restore_between": f"""WITH {_MAP}, {all_pairs_sql('sb', 'weights')} SELECT least(a.locus, b.locus) AS locus1, greatest(a.locus, b.locus) AS locus2, round(v, 6) AS v
        FROM sc JOIN pm a ON a.rep = locus1 JOIN pm b ON b.rep = locus2 WHERE v >= 0.1 AND locus1 IN (SELECT rep FROM pm) AND locus2 IN (SELECT rep FROM pm)""",
    "restore_within": f"""WITH {_MAP}, f AS (SELECT locus, sum(x * weight) / sum(weight) AS p FROM sb JOIN weights USING (sample_pos) GROUP BY locus)
        SELECT a.locus AS locus1, b.locus AS locus2, round(sqrt(-(p * log2(p) + (1 - p) * log2(1 - p))), 6) AS v FROM pm a JOIN pm b ON a.bits = b.bits AND a.locus < b.locus JOIN f ON f.locus = a.rep
        WHERE p > 1e-12 AND p < 1 - 1e-12 AND sqrt(-(p * log2(p) + (1 - p) * log2(1 - p))) >= 0.1""",
    "pair_bootstrap_stability": f"WITH {_SNPB}, {_resampled_sql('sb', 'weights', 0.2, 0.15)}",
    "pair_bootstrap_all": f"WITH {_GE}, {_resampled_sql('gx', 'uw', 0.2, 0.2)}",
}
