"""Queries of encodings, filters, weights and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociloom.functions import encode as E
from lociloom.operators import patterns
from lociloom.operators import weights as wt
from lociloom.operators.matrix import binarise, marginals, minor_filter
from lociloom.operators.subgroups import subgroup_majors
from lociloom.plans.batch import shard
from lociloom.queries.fixtures import CALLS, EVENTS, binary_sql, event_matrix, snp, weights
from lociloom.queries.tables import table
from lociloom.scratch import Scratch

LINK, EVENT_LINK = 0.87, 0.30  # samples are linked above this share of equal alleles


def allele_encode(spark: SparkSession, d: str) -> DataFrame:
    return snp(spark, d).select("locus", F.posexplode(E.encode_alleles(F.col("alleles"))).alias("sample_pos", "code"))


def major_allele_binary(spark: SparkSession, d: str) -> DataFrame:
    m = snp(spark, d).select("locus", E.major_allele(F.col("alleles")).alias("major"), "alleles")
    return m.select("locus", "major", E.ones(F.transform("alleles", lambda a: (a == F.col("major")).cast("tinyint"))).alias("n_major"))


def maf_mac_filter(spark: SparkSession, d: str) -> DataFrame:
    return minor_filter(binarise(snp(spark, d)), 0.02, 5).select("locus", E.ones(F.col("x")).alias("ones"))


def weighted_marginals(spark: SparkSession, d: str) -> DataFrame:
    m = marginals(binarise(snp(spark, d)), weights(spark, d))
    return m.select("locus", F.round("dp", 6).alias("dp"), F.round(F.col("total") - F.col("dp"), 6).alias("dq"))


def sample_similarity(spark: SparkSession, d: str) -> DataFrame:
    return wt.similarity(snp(spark, d)).select("s1", "s2", "same", F.round("sim", 6).alias("sim"))


def _clusters(spark: SparkSession, m: DataFrame, n: int, link: float) -> DataFrame:
    s = Scratch(spark, "scc")
    sim = s.save(wt.similarity(m), "similarity")
    return wt.scc(sim, spark.range(n).select(F.col("id").cast("int").alias("sample_pos")), link, s)


def _snp_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, snp(spark, d), weights(spark, d).count(), LINK)


def scc_components(spark: SparkSession, d: str) -> DataFrame:
    return _snp_clusters(spark, d).select("sample", "cluster")


def scc_weights(spark: SparkSession, d: str) -> DataFrame:
    return wt.cluster_weights(_snp_clusters(spark, d)).select("sample_pos", F.round("weight", 6).alias("weight"))


def scc_components_all(spark: SparkSession, d: str) -> DataFrame:
    """Of the events of all users."""
    return _clusters(spark, *event_matrix(spark, d), EVENT_LINK).select("sample", "cluster")


def scc_weights_all(spark: SparkSession, d: str) -> DataFrame:
    return wt.cluster_weights(_clusters(spark, *event_matrix(spark, d), EVENT_LINK)).select("sample_pos", F.round("weight", 6).alias("weight"))


def hcc_weights(spark: SparkSession, d: str) -> DataFrame:
    return wt.cluster_weights(wt.hcc(wt.similarity(snp(spark, d)), weights(spark, d).count(), 0.75))


def ess_screen(spark: SparkSession, d: str) -> DataFrame:
    """Raw and weighted effective sizes of both states of every background that the matrix has."""
    b = table(spark, d, "backgrounds").select("locus").distinct()
    rows = binarise(snp(spark, d)).join(b, "locus").select("locus", F.posexplode("x").alias("sample_pos", "state"))
    sizes = wt.effective_size(rows.join(weights(spark, d), "sample_pos"), "locus", "state")
    return wt.screen(sizes, wt.ess_minima(weights(spark, d).count(), "hybrid")).select("locus", "state", "n", F.round("ess", 6).alias("ess"), "level")


def background_split(spark: SparkSession, d: str) -> DataFrame:
    """How many samples of each background have its major allele: the sizes of the two subgroups."""
    b = shard(table(spark, d, "backgrounds"))
    m = binarise(snp(spark, d))
    return m.join(b, "locus").select("locus", E.ones(F.col("x")).cast("bigint").alias("n1"), (F.size("x") - E.ones(F.col("x"))).cast("bigint").alias("n0"))


def subgroup_alleles(spark: SparkSession, d: str) -> DataFrame:
    """Major allele of every locus among the samples of each background's both states; a state without samples has no rows."""
    return subgroup_majors(Scratch(spark, "splits").save(snp(spark, d), "snp"), shard(table(spark, d, "backgrounds")))


def shard_backgrounds(spark: SparkSession, d: str) -> DataFrame:
    return shard(table(spark, d, "backgrounds"), 2, 1).select("ordinal", "locus")


def pattern_collapse(spark: SparkSession, d: str) -> DataFrame:
    m = patterns.with_group_number(patterns.collapse(binarise(snp(spark, d)).select("locus", "row_pos", "x")))
    return m.select("locus", F.col("row_position"), "pattern_group", "representative", "pattern_size")


def within_pattern_entropy(spark: SparkSession, d: str) -> DataFrame:
    m = patterns.collapse(marginals(binarise(snp(spark, d)).select("locus", "row_pos", "x"), weights(spark, d)))
    return m.filter("locus = representative").select("representative", F.round("within_pattern_v", 6).alias("within_pattern_v"))


QUERIES = {q.__name__: q for q in (allele_encode, major_allele_binary, maf_mac_filter, weighted_marginals, sample_similarity, scc_components, scc_weights, hcc_weights, ess_screen, background_split, subgroup_alleles, shard_backgrounds, pattern_collapse, within_pattern_entropy, scc_components_all, scc_weights_all)}

_SNPB = f"{CALLS}, {binary_sql('snp', 'sb')}"


def _sim(source: str, weights: str, link: float) -> str:
    """CTEs up to cl(sample, cluster), the components of samples linked by sim."""
    return f"""sim AS (SELECT a.sample_pos AS s1, b.sample_pos AS s2, count(*) / (SELECT count(DISTINCT locus) FROM {source}) AS sim FROM {source} a JOIN {source} b USING (locus, allele) WHERE a.sample_pos < b.sample_pos GROUP BY ALL),
  e AS (SELECT s1 AS a, s2 AS b FROM sim WHERE sim > {link} UNION ALL SELECT s2, s1 FROM sim WHERE sim > {link}),
  r AS (SELECT sample_pos AS s, sample_pos AS c FROM {weights} UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.s),
  cl AS (SELECT s::INT AS sample, min(c)::INT AS cluster FROM r GROUP BY s)"""


_ORDERED = "o AS (SELECT locus, row_number() OVER (ORDER BY min(ordinal)) - 1 AS ordinal FROM backgrounds WHERE locus IS NOT NULL GROUP BY locus)"
_BITS = f"{_SNPB}, pt AS (SELECT locus, string_agg(x::VARCHAR, '' ORDER BY sample_pos) AS bits FROM sb GROUP BY locus)"

ORACLES = {
    "allele_encode": f"WITH {CALLS} SELECT locus, sample_pos, instr('ATCG-', allele) - 1 AS code FROM snp",
    "major_allele_binary": f"WITH {_SNPB} SELECT locus, major, n_major FROM sb_major",
    "maf_mac_filter": f"""WITH {_SNPB}, c AS (SELECT locus, sum(x) AS ones, count(*) AS n FROM sb GROUP BY locus)
        SELECT locus, ones FROM c WHERE least(ones, n - ones) / n >= 0.02 AND least(ones, n - ones) >= 5""",
    "weighted_marginals": f"WITH {_SNPB} SELECT locus, round(sum(x * weight), 6) AS dp, round(sum((1 - x) * weight), 6) AS dq FROM sb JOIN weights USING (sample_pos) GROUP BY locus",
    "sample_similarity": f"""WITH {CALLS} SELECT a.sample_pos AS s1, b.sample_pos AS s2, count(*) AS same, round(count(*) / (SELECT count(DISTINCT locus) FROM snp), 6) AS sim
        FROM snp a JOIN snp b ON a.locus = b.locus AND a.allele = b.allele AND a.sample_pos < b.sample_pos GROUP BY ALL""",
    "scc_components": f"WITH RECURSIVE {CALLS}, {_sim('snp', 'weights', LINK)} SELECT sample, cluster FROM cl",
    "scc_weights": f"WITH RECURSIVE {CALLS}, {_sim('snp', 'weights', LINK)} SELECT sample AS sample_pos, round(1.0 / count(*) OVER (PARTITION BY cluster), 6) AS weight FROM cl",
    "scc_components_all": f"WITH RECURSIVE {EVENTS}, {_sim('ge', 'uw', EVENT_LINK)} SELECT sample, cluster FROM cl",
    "scc_weights_all": f"WITH RECURSIVE {EVENTS}, {_sim('ge', 'uw', EVENT_LINK)} SELECT sample AS sample_pos, round(1.0 / count(*) OVER (PARTITION BY cluster), 6) AS weight FROM cl",
    "ess_screen": f"""WITH {_SNPB}, z AS (SELECT locus, x AS state, count(*) AS n, sum(weight) ** 2 / sum(weight ** 2) AS ess FROM sb JOIN weights USING (sample_pos)
        WHERE locus IN (SELECT locus FROM backgrounds) GROUP BY ALL)
        SELECT locus, state, n, round(ess, 6) AS ess, CASE WHEN ess >= 40 THEN 'formal' WHEN ess >= 25 THEN 'exploratory' ELSE 'skip' END AS level FROM z""",
    "background_split": f"WITH {_SNPB} SELECT locus, sum(x)::BIGINT AS n1, sum(1 - x)::BIGINT AS n0 FROM sb WHERE locus IN (SELECT locus FROM backgrounds) GROUP BY locus",
    "subgroup_alleles": f"""WITH {_SNPB}, k AS (SELECT locus AS background, sample_pos, x AS state FROM sb WHERE locus IN (SELECT locus FROM backgrounds)),
        c AS (SELECT background, state, s.locus, allele, count(*) AS c, min(s.sample_pos) AS p FROM snp s JOIN k USING (sample_pos) GROUP BY ALL)
        SELECT background, state, locus, allele AS major, (sum(c) OVER (PARTITION BY background, state, locus))::INT AS n FROM c QUALIFY row_number() OVER (PARTITION BY background, state, locus ORDER BY c DESC, p) = 1""",
    "shard_backgrounds": f"WITH {_ORDERED} SELECT ordinal, locus FROM o WHERE ordinal % 2 = 1",
    "pattern_collapse": f"""WITH {_BITS} SELECT locus, locus AS row_position, dense_rank() OVER (ORDER BY bits) - 1 AS pattern_group,
        min(locus) OVER (PARTITION BY bits) AS representative, count(*) OVER (PARTITION BY bits) AS pattern_size FROM pt""",
    "within_pattern_entropy": f"""WITH {_BITS}, f AS (SELECT locus, sum(x * weight) / sum(weight) AS p FROM sb JOIN weights USING (sample_pos) GROUP BY locus),
        r AS (SELECT min(locus) AS representative FROM pt GROUP BY bits)
        SELECT representative, round(CASE WHEN p > 1e-12 AND p < 1 - 1e-12 THEN sqrt(-(p * log2(p) + (1 - p) * log2(1 - p))) ELSE 0 END, 6) AS within_pattern_v FROM r JOIN f ON f.locus = representative""",
}
