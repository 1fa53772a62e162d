"""Queries over pattern_map, where four representatives hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociloom.operators.keyed import keyed_percentiles, keyed_profile
from lociloom.queries.tables import table
from lociloom.scratch import Scratch

KEYS = ("run_id", "representative")


def _profile(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "pattern_map").filter(F.col("representative").isNotNull())
    return keyed_profile(known, KEYS, ("locus", "pattern_size"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs and representatives of which a row states a size other than the true number of loci: any such size moves the least or the largest."""
    n = F.col("locus_distinct")
    return _profile(spark, d).filter((F.col("pattern_size_min") != n) | (F.col("pattern_size_max") != n)).select(*KEYS)


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d).select(
        *KEYS, "n_rows", F.col("locus_distinct").alias("n_loci"), F.col("pattern_size_rows").alias("n_stated"), F.col("pattern_size_distinct").alias("n_sizes"),
        F.col("pattern_size_mode").alias("usual_size"), (F.coalesce(F.col("pattern_size_mode") == F.col("locus_distinct"), F.lit(False))).alias("usual_size_true"),
    )


def p5_position_percentiles(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "pattern_map").filter(F.col("representative").isNotNull())
    out = keyed_percentiles(known, KEYS, "row_position", (0.1, 0.5, 0.9), Scratch(spark, "p5"))
    return out.select(*KEYS, "prob", "n", F.round("percentile", 6).alias("percentile"))


QUERIES = {"p5_found": p5_found, "p5_profile": p5_profile, "p5_position_percentiles": p5_position_percentiles}

ORACLES = {
    "p5_found": """
        WITH t AS (SELECT run_id, representative, count(DISTINCT locus) AS n FROM pattern_map WHERE representative IS NOT NULL GROUP BY ALL)
        SELECT DISTINCT p.run_id, p.representative FROM pattern_map p JOIN t
        ON p.run_id IS NOT DISTINCT FROM t.run_id AND p.representative = t.representative
        WHERE p.pattern_size IS NOT NULL AND p.pattern_size <> t.n""",
    "p5_profile": """
        WITH k AS (SELECT * FROM pattern_map WHERE representative IS NOT NULL),
        s AS (SELECT run_id, representative, pattern_size, count(*) AS c FROM k WHERE pattern_size IS NOT NULL GROUP BY ALL),
        m AS (SELECT run_id, representative, pattern_size AS usual_size FROM s
              QUALIFY row_number() OVER (PARTITION BY run_id, representative ORDER BY c DESC, pattern_size) = 1)
        SELECT k.run_id, k.representative, count(*) AS n_rows, count(DISTINCT locus) AS n_loci, count(pattern_size) AS n_stated,
               count(DISTINCT pattern_size) AS n_sizes, any_value(m.usual_size) AS usual_size,
               coalesce(any_value(m.usual_size) = count(DISTINCT locus), false) AS usual_size_true
        FROM k LEFT JOIN m ON k.run_id IS NOT DISTINCT FROM m.run_id AND k.representative = m.representative
        GROUP BY k.run_id, k.representative""",
    "p5_position_percentiles": """
        WITH g AS (SELECT run_id, representative, count(row_position) AS n, quantile_cont(row_position::DOUBLE, [0.1, 0.5, 0.9]) AS q
                   FROM pattern_map WHERE representative IS NOT NULL AND row_position IS NOT NULL GROUP BY ALL)
        SELECT run_id, representative, p.prob::DOUBLE AS prob, n, round(q[p.i], 6) AS percentile
        FROM g CROSS JOIN (VALUES (1, 0.1), (2, 0.5), (3, 0.9)) AS p(i, prob)""",
}
