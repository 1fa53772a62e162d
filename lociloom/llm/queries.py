"""Queries of the training-data operators over the given tables, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociloom.llm import frequency, quantiles, reservoir, residue
from lociloom.llm.components import groups_of_all
from lociloom.llm.mixing import Mix
from lociloom.llm.tokens import encode
from lociloom.queries.tables import table
from lociloom.scratch import Scratch

SAMPLE_SIZE = 100_000
PROBS = (0.1, 0.5, 0.9)
WIDTH = 2**-10  # of the cells of stored summaries
ALLELES = ("A", "T", "C", "G", "-")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return groups_of_all(table(spark, d, "final_pairs"), Scratch(spark, "p1"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Rows of snp_matrix that are calls: a locus, a known sample and an allele."""
    m = table(spark, d, "snp_matrix").select("locus", "sample_pos", F.upper("allele").alias("allele"))
    known = table(spark, d, "weights").select("sample_pos").distinct()
    return m.filter(F.col("locus").isNotNull() & F.col("allele").isin(*ALLELES)).join(known, "sample_pos", "left_semi")


def p2_frequency(spark: SparkSession, d: str) -> DataFrame:
    counts = frequency.prefix_counts(_calls(spark, d), "sample_pos", ["locus"], Scratch(spark, "p2"))
    samples = table(spark, d, "weights").select("sample_pos").distinct().count()
    marks = frequency.mark(F.col("n_records"), F.lit(samples))
    return counts.select("locus", F.col("n_occurrences").alias("n_calls"), F.col("n_records").alias("n_samples"), marks.alias("mark"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_frequency(spark, d).filter(F.col("mark").isNotNull()).select("locus", "mark")


def p2_allele_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """How often each run of up to three alleles of a locus's neighbouring called samples occurs, and at how many loci."""
    one = _calls(spark, d).groupBy("locus", "sample_pos").agg(F.min("allele").alias("allele"))
    ordered = one.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("sample_pos", "allele"))).alias("a"))  # at most one entry a sample
    s = ordered.select("locus", F.col("a.allele").alias("a")).select("locus", "a", F.posexplode("a").alias("i", "t1"))
    s = s.select("locus", "t1", F.get("a", F.col("i") + 1).alias("t2"), F.get("a", F.col("i") + 2).alias("t3"))
    return frequency.prefix_counts(s, "locus", ["t1", "t2", "t3"], Scratch(spark, "p2n"))


def _finite_differences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "df_merged").filter(F.col("diff").isNotNull() & ~F.isnan("diff") & (F.abs("diff") < F.lit(float("inf"))))
    return rows.select("background", "locus1", "locus2", "diff", "batch_no", "loaded_at")


def p3_reservoir_sample(spark: SparkSession, d: str) -> DataFrame:
    """All pieces wait: their counts are drawn in order, the surviving rows chosen in one pass."""
    return reservoir.sample_batches(_finite_differences(spark, d), "batch_no", SAMPLE_SIZE, Scratch(spark, "p3"), seed=11).drop("loaded_at")


def p3_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Pieces arrive one after another, each a folder; the sample after every piece is kept in the shared folder."""
    s = Scratch(spark, "p3a")
    rows = _finite_differences(spark, d)
    folder = f"{s.root}/pieces"
    rows.withColumn("piece", F.col("batch_no")).write.partitionBy("piece").parquet(folder)
    pieces = spark.read.schema(rows.withColumn("piece", F.col("batch_no")).schema).parquet(folder)
    r = reservoir.Reservoir(SAMPLE_SIZE, s, seed=11)
    r.update(rows.limit(0))
    for (piece,) in rows.select("batch_no").distinct().orderBy("batch_no").collect():  # a row per piece
        r.update(pieces.filter(F.col("piece").eqNullSafe(F.lit(piece))).drop("piece"))
    return r.result().drop("loaded_at")


def _measured(spark: SparkSession, d: str, s: Scratch) -> DataFrame:
    """Valid rows of df_merged, each pair once per background, with the first piece it came in."""
    m = table(spark, d, "df_merged").select("background", "locus1", "locus2", "v_f", "v_h", "diff", "batch_no")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    ok = m.filter(finite("v_f") & finite("v_h") & finite("diff") & F.col("v_f").between(0, 1) & F.col("v_h").between(0, 1))
    # F.least skips nulls, so a pair with one null locus stays distinct by its count of nulls
    nulls = F.col("locus1").isNull().cast("int") + F.col("locus2").isNull().cast("int")
    once = ok.groupBy("background", F.least("locus1", "locus2").alias("a"), F.greatest("locus1", "locus2").alias("b"), nulls.alias("nulls")).agg(F.min(F.struct("v_f", "v_h", "diff")).alias("x"), F.min("batch_no").alias("batch_no"))
    return s.save(once.select("background", "x.v_f", "x.v_h", "x.diff", "batch_no"), "pairs")


MEASURES = ("diff", "v_h", "v_f")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of diff, v_h and v_f per background over valid rows, each pair once per background."""
    s = Scratch(spark, "p4")
    out = quantiles.percentiles([_measured(spark, d, s)], "background", MEASURES, PROBS, s)
    return out.select(F.col("group_key").alias("background"), "measure", "n", *[F.round(f"p{i}", 9).alias(f"p{int(p * 100)}") for i, p in enumerate(PROBS)])


def p4_batch_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The same within WIDTH from a summary of each piece (batch_no): summaries are stored by piece, then combined without the rows."""
    s = Scratch(spark, "p4b")
    rows = _measured(spark, d, s)
    tall = quantiles.summary(rows.withColumn("piece", F.struct("batch_no", "background")), "piece", MEASURES, WIDTH)
    stored = s.save(tall.select(F.col("g.batch_no").alias("batch_no"), F.col("g.background").alias("g"), "measure", "cell", "n", "least", "most"), "summaries")
    out = quantiles.bounds(quantiles.merge(stored), PROBS)
    ends = [F.round(f"p{i}_{e}", 9).alias(f"p{int(p * 100)}_{e}") for i, p in enumerate(PROBS) for e in ("low", "high")]
    return out.select(F.col("group_key").alias("background"), "measure", "n", *ends)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("measure")
    hit = ((m == "diff") & (F.abs("p50") >= 0.15)) | ((m == "v_h") & (F.col("p90") >= 0.70)) | ((m == "v_f") & (F.col("p10") <= 0.05))
    return p4_percentiles(spark, d).filter(hit).select("background", "measure")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "text", ["doc_id"])


def _mix(spark: SparkSession, d: str) -> Mix:
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), Scratch(spark, "p7"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).documents()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.with_residue(table(spark, d, "documents").select("doc_id", "text")).select("doc_id")


QUERIES = {q.__name__: q for q in (p1_found, p2_found, p2_frequency, p2_allele_ngrams, p3_reservoir_sample, p3_arrivals, p4_found, p4_percentiles, p4_batch_bounds, p6_ids, p7_mix, p7_shares, p8_found)}

_CALLS = """calls AS (SELECT locus, sample_pos, upper(allele) AS allele FROM snp_matrix
    WHERE locus IS NOT NULL AND upper(allele) IN ('A', 'T', 'C', 'G', '-') AND sample_pos IN (SELECT sample_pos FROM weights))"""
_FREQ = f"""WITH {_CALLS}, f AS (SELECT locus, count(*) AS n_calls, count(DISTINCT sample_pos) AS n_samples FROM calls GROUP BY locus),
    m AS (SELECT *, CASE WHEN n_samples < 5 THEN 'rare' WHEN n_samples > 0.95 * (SELECT count(DISTINCT sample_pos) FROM weights) THEN 'common' END AS mark FROM f)"""
_ONCE = """WITH once AS (SELECT background, least(locus1, locus2) AS a, greatest(locus1, locus2) AS b, (locus1 IS NULL)::INT + (locus2 IS NULL)::INT AS nulls,
    min({'v_f': v_f, 'v_h': v_h, 'diff': diff}) AS x FROM df_merged
    WHERE isfinite(v_f) AND isfinite(v_h) AND isfinite(diff) AND v_f BETWEEN 0 AND 1 AND v_h BETWEEN 0 AND 1 GROUP BY ALL),
    tall AS (SELECT background, 'diff' AS measure, x.diff AS v FROM once UNION ALL SELECT background, 'v_h', x.v_h FROM once UNION ALL SELECT background, 'v_f', x.v_f FROM once),
    q AS (SELECT background, measure, count(*) AS n, round(quantile_cont(v, 0.1), 9) AS p10, round(quantile_cont(v, 0.5), 9) AS p50, round(quantile_cont(v, 0.9), 9) AS p90 FROM tall GROUP BY ALL)"""

_CELLS = f"""{_ONCE}, z AS (SELECT background, measure, v, min(v) OVER w AS least_, max(v) OVER w AS most_ FROM tall WINDOW w AS (PARTITION BY background, measure, floor(v / {WIDTH})))"""
_ENDS = ", ".join(f"round(quantile_cont({e}_, {p}), 9) AS p{int(p * 100)}_{n}" for p in PROBS for e, n in (("least", "low"), ("most", "high")))

ORACLES = {
    "p1_found": """
        WITH RECURSIVE l AS (SELECT DISTINCT locus1 AS a, locus2 AS b FROM final_pairs
                   WHERE locus1 > 0 AND locus2 > 0 AND NOT isnan(v) AND v >= 0.3::FLOAT AND v <= 1::FLOAT AND locus1 <> locus2),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        loci AS (SELECT DISTINCT x AS locus FROM (SELECT locus1 AS x FROM final_pairs UNION ALL SELECT locus2 FROM final_pairs) WHERE x > 0),
        r(locus, g) USING KEY (locus) AS (
            SELECT locus, locus FROM loci
            UNION SELECT e.b, min(r.g) FROM r JOIN e ON e.a = r.locus JOIN recurring.r AS s ON s.locus = e.b WHERE r.g < s.g GROUP BY e.b)
        SELECT locus, g AS group_id FROM r""",
    "p2_found": f"{_FREQ} SELECT locus, mark FROM m WHERE mark IS NOT NULL",
    "p2_frequency": f"{_FREQ} SELECT locus, n_calls, n_samples, mark FROM m",
    "p2_allele_ngrams": f"""
        WITH {_CALLS}, one AS (SELECT locus, sample_pos, min(allele) AS t FROM calls GROUP BY ALL),
        s AS (SELECT locus, t AS t1, lead(t, 1) OVER w AS t2, lead(t, 2) OVER w AS t3 FROM one WINDOW w AS (PARTITION BY locus ORDER BY sample_pos)),
        g AS (SELECT locus, t1, NULL AS t2, NULL AS t3, 1 AS n_terms FROM s UNION ALL SELECT locus, t1, t2, NULL, 2 FROM s WHERE t2 IS NOT NULL
              UNION ALL SELECT locus, t1, t2, t3, 3 FROM s WHERE t3 IS NOT NULL)
        SELECT t1, t2, t3, n_terms, count(*) AS n_occurrences, count(DISTINCT locus) AS n_records FROM g GROUP BY ALL""",
    "p4_percentiles": f"{_ONCE} SELECT * FROM q",
    "p4_batch_bounds": f"{_CELLS} SELECT background, measure, count(*) AS n, {_ENDS} FROM z GROUP BY ALL",
    "p4_found": f"""{_ONCE} SELECT background, measure FROM q
        WHERE (measure = 'diff' AND abs(p50) >= 0.15) OR (measure = 'v_h' AND p90 >= 0.70) OR (measure = 'v_f' AND p10 <= 0.05)""",
}
