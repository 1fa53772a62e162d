"""Matrices, pairs and comparisons that Spark derives from the given tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lociloom.functions.distance import gene_places, highorder_class, snp_distance
from lociloom.functions.encode import ALLELES
from lociloom.queries.tables import table
from lociloom.sources.readers import long_matrix

KINDS = {"view": "A", "click": "T", "purchase": "C", "signup": "G"}


def event_matrix(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Users as loci and all their events as samples, gaps up to the longest user; and the number of samples."""
    e = table(spark, d, "events")
    width = e.groupBy("user_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).cast("int")).first()[0]
    kinds, letters = zip(*KINDS.items())  # a byte for the event's kind is shuffled, its letter looked up behind the shuffle
    code = F.coalesce(F.create_map(*[F.lit(x) for i, kind in enumerate(kinds) for x in (kind, i)])[F.col("event_type")], F.lit(len(kinds))).cast("tinyint")
    k = F.row_number().over(W.partitionBy("locus").orderBy("ts", "event_id"))
    rows = e.select(F.col("user_id").cast("bigint").alias("locus"), "ts", "event_id", code.alias("code")).select("locus", k.alias("k"), "code")
    codes = F.array_sort(F.collect_list(F.struct("k", "code")))["code"]
    alleles = F.transform("codes", lambda c: F.array(*[F.lit(x) for x in (*letters, "-")])[c])
    gaps = F.array_repeat(F.lit("-"), F.lit(width) - F.size("codes"))
    return rows.groupBy("locus").agg(codes.alias("codes")).select("locus", F.col("locus").alias("row_pos"), F.concat(alleles, gaps).alias("alleles")), width


def uniform(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("sample_pos"), F.lit(1.0).alias("weight"))


def vector_matrix(spark: SparkSession, d: str, dims: int = 64) -> DataFrame:
    """Vectors as loci, signs of their components as binary samples."""
    x = F.transform(F.slice("embedding", 1, dims), lambda v: (v > 0).cast("tinyint"))
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("locus"), F.col("vec_id").cast("bigint").alias("row_pos"), x.alias("x"))


def step_weights(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("sample_pos"), (1 / (1 + F.col("id") % 3)).alias("weight"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "snp_matrix").select("locus", "sample_pos", F.upper("allele").alias("allele"))
    known = table(spark, d, "weights").select("sample_pos").distinct()
    return m.filter(F.col("locus").isNotNull() & F.col("allele").isin(*ALLELES)).join(known, "sample_pos", "left_semi")


def snp(spark: SparkSession, d: str) -> DataFrame:
    """The given allele matrix as arrays over all samples; a missing call is a gap."""
    return long_matrix(calls(spark, d), table(spark, d, "weights"))


def weights(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "weights").select("sample_pos", "weight")


def gene_table(spark: SparkSession, d: str, loci: DataFrame) -> DataFrame:
    """Places of the gene ids among loci(locus), from a formula over part: two strands, both chromosomes, contigs only, and unknown ids."""
    part = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("k"))
    m = part.agg(F.max("k")).first()[0]
    ids = loci.select(F.col("locus").alias("locus_id")).filter("locus_id >= 5165770").distinct()
    genes = ids.select("locus_id", F.concat(F.lit("g"), F.pmod("locus_id", F.lit(m + 40)) + 1).alias("g"))
    start, size = F.pmod(F.col("k") * 7919, F.lit(1_800_000)) + 1, F.pmod(F.col("k") * 31, F.lit(900)) + 100
    forward = F.col("k") % 2 == 0
    iv = part.filter("k % 10 < 8").select(F.concat(F.lit("g"), "k").alias("qacc"), F.when(forward, start).otherwise(start + size).cast("int").alias("sstart"), F.when(forward, start + size).otherwise(start).cast("int").alias("send"), F.when(F.col("k") % 3 == 0, "NC_004605").otherwise("NC_004603").alias("sacc"))
    ct = part.filter("k % 10 = 8").select(F.concat(F.lit("g"), "k").alias("qacc"), F.concat(F.lit("contig"), F.col("k") % 4).alias("sacc"))
    return gene_places(genes, iv, ct)


def clean_pairs(spark: SparkSession, d: str) -> DataFrame:
    """One row per unordered pair of loci above 0 with a score in 0..1, the largest."""
    p = table(spark, d, "final_pairs").select("locus1", "locus2", "v")
    ok = p.filter((F.col("locus1") > 0) & (F.col("locus2") > 0) & (F.col("locus1") != F.col("locus2")) & ~F.isnan("v") & F.col("v").between(0, 1))
    return ok.groupBy(F.least("locus1", "locus2").alias("locus1"), F.greatest("locus1", "locus2").alias("locus2")).agg(F.max(F.col("v").cast("double")).alias("v"))


def comparison(spark: SparkSession, d: str) -> DataFrame:
    """(background, locus1, locus2, v_f, v_h, diff, geno_dis, chrom, g) of valid rows, each pair once; g is background and chromosome."""
    m = table(spark, d, "df_merged")
    fin = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    ok = m.filter(fin("v_f") & fin("v_h") & fin("diff") & F.col("v_f").between(0, 1) & F.col("v_h").between(0, 1) & F.col("locus1").isNotNull() & F.col("locus2").isNotNull())
    once = ok.groupBy("background", F.least("locus1", "locus2").alias("locus1"), F.greatest("locus1", "locus2").alias("locus2")).agg(F.min(F.struct("v_f", "v_h", "diff")).alias("x"))
    rows = once.select("background", "locus1", "locus2", "x.*").withColumn("geno_dis", snp_distance(F.col("locus1"), F.col("locus2")))
    chrom = highorder_class(F.col("locus1"), F.col("locus2"), F.col("geno_dis"))
    return rows.withColumn("chrom", chrom).withColumn("g", F.concat_ws(":", F.col("background").cast("string"), "chrom"))


# --- the same in SQL
CALLS = """calls AS (SELECT locus, sample_pos, min(upper(allele)) AS allele FROM snp_matrix WHERE locus IS NOT NULL AND upper(allele) IN ('A', 'T', 'C', 'G', '-')
    AND sample_pos IN (SELECT sample_pos FROM weights) GROUP BY ALL),
  snp AS (SELECT l.locus, w.sample_pos, coalesce(c.allele, '-') AS allele FROM (SELECT DISTINCT locus FROM calls) l CROSS JOIN weights w
    LEFT JOIN calls c ON c.locus = l.locus AND c.sample_pos = w.sample_pos)"""
EVENTS = """ge0 AS (SELECT user_id::BIGINT AS locus, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
    CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'T' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'G' ELSE '-' END AS allele FROM events),
  uw AS (SELECT i::INT AS sample_pos, 1.0::DOUBLE AS weight FROM range((SELECT max(k) FROM ge0)) t(i)),
  ge AS (SELECT l.locus, w.sample_pos, coalesce(g.allele, '-') AS allele FROM (SELECT DISTINCT locus FROM ge0) l CROSS JOIN uw w LEFT JOIN ge0 g ON g.locus = l.locus AND g.k = w.sample_pos + 1)"""


def binary_sql(source: str, name: str) -> str:
    """CTEs: the major allele of each locus and the 0/1 matrix."""
    return f"""{name}_major AS (SELECT locus, allele AS major, c AS n_major FROM (SELECT locus, allele, count(*) AS c, min(sample_pos) AS f FROM {source} GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY locus ORDER BY c DESC, f) = 1),
  {name} AS (SELECT s.locus, s.sample_pos, (s.allele = m.major)::INT AS x FROM {source} s JOIN {name}_major m USING (locus))"""


VECTORS = "gb AS (SELECT vec_id::BIGINT AS locus, i - 1 AS sample_pos, (embedding[i] > 0)::INT AS x FROM embeddings, range(1, 65) t(i))"
STEPS = "sw AS (SELECT i::INT AS sample_pos, 1.0::DOUBLE / (1 + i % 3) AS weight FROM range(64) t(i))"
PAIRS = """fp AS (SELECT least(locus1, locus2) AS locus1, greatest(locus1, locus2) AS locus2, max(v::DOUBLE) AS v FROM final_pairs
    WHERE locus1 > 0 AND locus2 > 0 AND locus1 <> locus2 AND NOT isnan(v) AND v BETWEEN 0 AND 1 GROUP BY ALL)"""


def distance_sql(a: str = "locus1", b: str = "locus2") -> str:
    def circle(length: int) -> str:
        return f"CASE WHEN abs({a} - {b}) > {length // 2} THEN {length} - abs({a} - {b}) ELSE abs({a} - {b}) END"

    return f"""(CASE WHEN {a} = {b} THEN 0 WHEN {a} > 5165770 OR {b} > 5165770 THEN -2 WHEN {a} <= 3288558 AND {b} <= 3288558 THEN {circle(3288558)}
        WHEN {a} > 3288558 AND {b} > 3288558 THEN {circle(1877212)} ELSE -1 END)::BIGINT"""


def gwes_class_sql(middle: str = "NULL") -> str:
    """The chromosome of a pair; of two genes that of the first one's middle."""
    return f"""(CASE WHEN locus1 > 5165770 AND locus2 > 5165770 THEN CASE WHEN {middle} < 3288558 THEN 'chr1' WHEN {middle} > 3288558 THEN 'chr2' END
    WHEN (locus1 < 3288558 AND (locus2 < 3288558 OR locus2 > 5165770)) OR (locus1 > 5165770 AND locus2 < 3288558) THEN 'chr1'
    WHEN locus1 > 3288558 AND locus2 > 3288558 AND (locus1 < 5165770 OR locus2 < 5165770) THEN 'chr2' END)"""


def genes_sql(loci: str) -> str:
    """CTEs up to pl, the places of the gene ids in a query of loci(x)."""
    return f"""mk AS (SELECT max(p_partkey)::BIGINT AS m FROM part), ids AS (SELECT DISTINCT x AS locus_id FROM ({loci}) WHERE x >= 5165770),
  gn AS (SELECT locus_id, locus_id % (m + 40) + 1 AS k FROM ids CROSS JOIN mk),
  iv AS (SELECT p_partkey::BIGINT AS k, (p_partkey::BIGINT * 7919) % 1800000 + 1 AS st, (p_partkey::BIGINT * 31) % 900 + 100 AS sz FROM part),
  pl AS (SELECT g.locus_id, CASE WHEN k % 10 < 8 THEN (2 * st + sz) // 2 + sh END AS mid, CASE WHEN k % 10 < 8 THEN CASE WHEN k % 2 = 0 THEN st ELSE st + sz END + sh END AS start,
      CASE WHEN k % 10 < 8 THEN CASE WHEN k % 2 = 0 THEN st + sz ELSE st END + sh END AS "end", CASE WHEN k % 10 = 8 THEN 'contig' || (k % 4)::VARCHAR END AS contig
    FROM (SELECT gn.locus_id, iv.k, st, sz, CASE WHEN iv.k % 3 = 0 THEN 3288558 ELSE 0 END AS sh FROM gn LEFT JOIN iv USING (k)) g)"""


def _on_genome(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 5165770 OR {b} > 5165770 THEN -1 ELSE {distance_sql(a, b)} END"


def annotated_sql(pairs: str, extra: str = "v") -> str:
    """SELECT of pairs with geno_dis and chrom, genes looked up in pl."""
    o = _on_genome
    return f"""SELECT locus1, locus2, {extra}, {gwes_class_sql('m1')} AS chrom, (CASE WHEN locus1 < 5165770 AND locus2 < 5165770 THEN {distance_sql()}
          WHEN locus1 < 5165770 AND locus2 >= 5165770 AND s2 IS NOT NULL THEN CASE WHEN locus1 BETWEEN least(s2, e2) AND greatest(s2, e2) THEN 0 ELSE least({o('locus1', 's2')}, {o('locus1', 'e2')}) END
          WHEN locus1 >= 5165770 AND locus2 < 5165770 AND s1 IS NOT NULL THEN CASE WHEN locus2 BETWEEN least(s1, e1) AND greatest(s1, e1) THEN 0 ELSE least({o('locus2', 'm1')}, {o('locus2', 's1')}, {o('locus2', 'e1')}) END
          WHEN locus1 >= 5165770 AND locus2 >= 5165770 AND s1 IS NOT NULL AND s2 IS NOT NULL THEN
            CASE WHEN (m1 <= 3288558) <> (m2 <= 3288558) THEN -1 WHEN least(s1, e1) <= greatest(s2, e2) AND least(s2, e2) <= greatest(s1, e1) THEN 0
              WHEN (m1, s1, e1) <= (m2, s2, e2) THEN least({o('e1', 's2')}, {o('s1', 'e2')}) ELSE least({o('e2', 's1')}, {o('s2', 'e1')}) END
          WHEN locus1 >= 5165770 AND locus2 >= 5165770 AND c1 = c2 THEN 0 ELSE -1 END)::BIGINT AS geno_dis
        FROM (SELECT p.*, x.mid AS m1, x.start AS s1, x."end" AS e1, x.contig AS c1, y.mid AS m2, y.start AS s2, y."end" AS e2, y.contig AS c2
          FROM {pairs} p LEFT JOIN pl x ON x.locus_id = p.locus1 LEFT JOIN pl y ON y.locus_id = p.locus2)"""


HIGH_CLASS = """(CASE WHEN geno_dis > 0 THEN CASE WHEN locus1 < 3288558 OR locus2 < 3288558 THEN 'chr1'
    WHEN locus1 > 3288558 AND locus2 > 3288558 AND (locus1 < 5165770 OR locus2 < 5165770) THEN 'chr2' END END)"""
COMPARISON = f"""m0 AS (SELECT background, least(locus1, locus2) AS locus1, greatest(locus1, locus2) AS locus2, min({{'v_f': v_f, 'v_h': v_h, 'diff': diff}}) AS x FROM df_merged
    WHERE isfinite(v_f) AND isfinite(v_h) AND isfinite(diff) AND v_f BETWEEN 0 AND 1 AND v_h BETWEEN 0 AND 1 AND locus1 IS NOT NULL AND locus2 IS NOT NULL GROUP BY ALL),
  m1 AS (SELECT background, locus1, locus2, x.v_f AS v_f, x.v_h AS v_h, x.diff AS diff, {distance_sql()} AS geno_dis FROM m0),
  cmp AS (SELECT *, {HIGH_CLASS} AS chrom, concat_ws(':', background::VARCHAR, {HIGH_CLASS}) AS g FROM m1)"""


def score_sql(source: str) -> str:
    """SELECT locus1, locus2, v from columns locus1, locus2, n11, dp_i, dp_j, total."""
    return f"""SELECT locus1, locus2, CASE WHEN dp_i > 0 AND dp_i < total THEN
        sqrt(greatest(s * (p1 * log2(p1 / m1) + p0 * log2(p0 / m0)) + (1 - s) * (q1 * log2(q1 / m1) + q0 * log2(q0 / m0)), 0)) END AS v
      FROM (SELECT *, s * p1 + (1 - s) * q1 AS m1, s * p0 + (1 - s) * q0 AS m0 FROM (
        SELECT *, dp_i / total AS s, p + 1e-27 AS p1, 1 - p + 1e-27 AS p0, q + 1e-27 AS q1, 1 - q + 1e-27 AS q0 FROM (
        SELECT *, least(greatest(n11 / dp_i, 1e-9), 1 - 1e-9) AS p, least(greatest((dp_j - n11) / (total - dp_i), 1e-9), 1 - 1e-9) AS q FROM {source})))"""


def all_pairs_sql(binary: str, weights: str, t: str = "") -> str:
    """CTE sc(locus1, locus2, v) of all pairs of loci with two states; loci in numeric order. `t` is added to the CTEs' names."""
    return f"""tw{t} AS (SELECT sum(weight)::DOUBLE AS total FROM {weights}),
  mg{t} AS (SELECT b.locus, sum(b.x * w.weight)::DOUBLE AS dp FROM {binary} b JOIN {weights} w USING (sample_pos) GROUP BY ALL),
  jt{t} AS (SELECT a.locus AS l1, b.locus AS l2, sum(w.weight)::DOUBLE AS n11 FROM {binary} a JOIN {binary} b ON a.sample_pos = b.sample_pos AND a.locus < b.locus AND a.x = 1 AND b.x = 1
    JOIN {weights} w ON w.sample_pos = a.sample_pos GROUP BY ALL),
  pr{t} AS (SELECT i.locus AS locus1, j.locus AS locus2, coalesce(n11, 0) AS n11, i.dp AS dp_i, j.dp AS dp_j, total FROM mg{t} i JOIN mg{t} j ON i.locus < j.locus CROSS JOIN tw{t}
    LEFT JOIN jt{t} ON l1 = i.locus AND l2 = j.locus WHERE i.dp > 0 AND i.dp < total AND j.dp > 0 AND j.dp < total),
  sc{t} AS ({score_sql('pr' + t)})"""
