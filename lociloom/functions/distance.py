"""Distances on two circular chromosomes and the classes of pairs by chromosome; whole-stage expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociloom.config import GenomeConfig


def circular(a: Column, b: Column, length: int) -> Column:
    d = F.abs(a - b)
    return F.when(d > length // 2, length - d).otherwise(d)


def snp_distance(a: Column, b: Column, g: GenomeConfig = GenomeConfig()) -> Column:
    """Bases between two loci; 0 for the same, -1 across chromosomes, -2 with an id above the genome."""
    return (
        F.when(a == b, 0)
        .when((a > g.total) | (b > g.total), -2)
        .when((a <= g.chr1_len) & (b <= g.chr1_len), circular(a, b, g.chr1_len))
        .when((a > g.chr1_len) & (b > g.chr1_len), circular(a, b, g.chr2_len))
        .otherwise(-1)
        .cast("bigint")
    )


def on_genome(a: Column, b: Column, g: GenomeConfig = GenomeConfig()) -> Column:
    """As snp_distance, with -1 for anything off the genome."""
    return F.when((a > g.total) | (b > g.total), F.lit(-1)).otherwise(snp_distance(a, b, g)).cast("bigint")


def linear_distance(a: Column, b: Column, length: int = 0) -> Column:
    """One chromosome: difference, the shorter way round if a length is given."""
    d = F.abs(a - b)
    return (F.when(d > F.lit(length) / 2, length - d).otherwise(d) if length > 0 else d).cast("bigint")


def ld_flag(distance: Column, ld: int = 3000) -> Column:
    return F.when((distance >= 0) & (distance < ld), 1).otherwise(0).cast("tinyint")


# fixed value: accession of the second chromosome in the gene tables
CHR2_NAME = "NC_004605"


def gene_places(genes: DataFrame, intervals: DataFrame, contigs: DataFrame, g: GenomeConfig = GenomeConfig(), chr2_name: str = CHR2_NAME) -> DataFrame:
    """(locus_id, mid, start, end, contig) from genes(locus_id, g), intervals(qacc, sstart, send, sacc) and contigs(qacc, sacc).

    Positions on chromosome 2 are shifted; a gene only in contigs has just a contig; one in neither has nulls.
    """
    shift = F.when(F.col("i.sacc") == chr2_name, g.chr1_len).otherwise(0)
    mid = F.floor((F.col("i.sstart") + F.col("i.send")) / 2)
    j = genes.alias("n").join(intervals.alias("i"), F.col("n.g") == F.col("i.qacc"), "left").join(contigs.alias("c"), F.col("n.g") == F.col("c.qacc"), "left")
    return j.select(
        "n.locus_id", (mid + shift).cast("bigint").alias("mid"), (F.col("i.sstart") + shift).cast("bigint").alias("start"), (F.col("i.send") + shift).cast("bigint").alias("end"),
        F.when(F.col("i.qacc").isNull(), F.col("c.sacc")).alias("contig"),
    )


def gene_distance(pairs: DataFrame, places: DataFrame, g: GenomeConfig = GenomeConfig(), middle: str | None = None) -> DataFrame:
    """pairs(locus1, locus2, ...) with geno_dis, where ids from the genome's total on are genes looked up in places.

    `middle` names a column for the middle of the first locus's gene.

    Between two bases as snp_distance. A base inside a gene has 0; else it is the least distance to the gene's start and end, and, if the
    gene comes first, to its middle as well. Two genes: -1 across chromosomes, 0 if they overlap, else the shorter gap; 0 on the same contig.
    """
    one = places.select(F.col("locus_id").alias("l1"), *[F.col(c).alias(f"{c}_1") for c in ("mid", "start", "end", "contig")])
    two = places.select(F.col("locus_id").alias("l2"), *[F.col(c).alias(f"{c}_2") for c in ("mid", "start", "end", "contig")])
    j = pairs.join(one, F.col("locus1") == F.col("l1"), "left").join(two, F.col("locus2") == F.col("l2"), "left")
    a, b = F.col("locus1"), F.col("locus2")
    ga, gb = a >= g.total, b >= g.total
    c = F.col
    near = lambda *xs: F.least(*xs)
    dis = lambda x, y: on_genome(x, y, g)
    known1, known2 = c("start_1").isNotNull(), c("start_2").isNotNull()
    lo1, hi1, lo2, hi2 = F.least("start_1", "end_1"), F.greatest("start_1", "end_1"), F.least("start_2", "end_2"), F.greatest("start_2", "end_2")
    inside = lambda x, lo, hi: (x >= lo) & (x <= hi)
    first_1 = F.struct("mid_1", "start_1", "end_1") <= F.struct(c("mid_2").alias("mid_1"), c("start_2").alias("start_1"), c("end_2").alias("end_1"))
    gap = F.when(first_1, near(dis(c("end_1"), c("start_2")), dis(c("start_1"), c("end_2")))).otherwise(near(dis(c("end_2"), c("start_1")), dis(c("start_2"), c("end_1"))))
    both = (
        F.when((c("mid_1") <= g.chr1_len) != (c("mid_2") <= g.chr1_len), -1)
        .when((lo1 <= hi2) & (lo2 <= hi1), 0)
        .otherwise(gap)
    )
    out = (
        F.when(~ga & ~gb, snp_distance(a, b, g))
        .when(~ga & gb & known2, F.when(inside(a, lo2, hi2), 0).otherwise(near(dis(a, c("start_2")), dis(a, c("end_2")))))
        .when(ga & ~gb & known1, F.when(inside(b, lo1, hi1), 0).otherwise(near(dis(b, c("mid_1")), dis(b, c("start_1")), dis(b, c("end_1")))))
        .when(ga & gb & known1 & known2, both)
        .when(ga & gb & (c("contig_1") == c("contig_2")), 0)
        .otherwise(-1)
    )
    return j.select(*pairs.columns, out.cast("bigint").alias("geno_dis"), *([c("mid_1").alias(middle)] if middle else []))


def gwes_class(a: Column, b: Column, g: GenomeConfig = GenomeConfig(), mid1: Column | None = None) -> Column:
    """chr1 or chr2 by the rule of the outlier threshold; a position of exactly the chromosome's length belongs to neither."""
    gene_a, gene_b = a > g.total, b > g.total
    both = F.when(mid1 < g.chr1_len, "chr1").when(mid1 > g.chr1_len, "chr2") if mid1 is not None else F.lit(None)
    low_a, low_b = a < g.chr1_len, b < g.chr1_len
    return (
        F.when(gene_a & gene_b, both)
        .when((low_a & low_b) | (low_a & gene_b) | (gene_a & low_b), "chr1")
        .when((a > g.chr1_len) & (b > g.chr1_len) & ((a < g.total) | (b < g.total)), "chr2")
    )


def highorder_class(a: Column, b: Column, distance: Column, g: GenomeConfig = GenomeConfig()) -> Column:
    """The rule of subgroup comparisons: only pairs with a positive distance; either end decides."""
    return F.when(distance > 0, F.when((a < g.chr1_len) | (b < g.chr1_len), "chr1").when((a > g.chr1_len) & (b > g.chr1_len) & ((a < g.total) | (b < g.total)), "chr2"))


def plot_class(a: Column, b: Column, v: Column, distance: Column, threshold: Column | float, ld: int, g: GenomeConfig = GenomeConfig()) -> Column:
    """Which group of a plot a pair belongs to."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    genes = (a > g.total).cast("int") + (b > g.total).cast("int")
    strong = F.when(genes == 0, "snp_snp").when(genes == 1, "snp_gene").otherwise("gene_gene")
    return F.when((distance >= 0) & (distance <= ld), "proximal").when(v > t, strong).otherwise("common")


# --- the same on arrays, for pairs in tiles
NONE = -(2**63)


def with_places(rows: DataFrame, places: DataFrame | None) -> DataFrame:
    """rows(locus, ...) with `place`: middle, start, end and a hash of the contig, NONE for what is unknown; null without places."""
    if places is None:
        return rows.withColumn("place", F.lit(None).cast("array<bigint>"))
    known = F.array(*[F.coalesce(F.col(c), F.lit(NONE)) for c in ("mid", "start", "end")], F.when(F.col("contig").isNotNull(), F.xxhash64("contig")).otherwise(F.lit(NONE)))
    p = places.select(F.col("locus_id").alias("__l"), known.alias("place"))
    return rows.join(p, F.col("locus") == F.col("__l"), "left").drop("__l").withColumn("place", F.coalesce("place", F.array(*[F.lit(NONE)] * 4)))


def snp_distances(a: np.ndarray, b: np.ndarray, g: GenomeConfig = GenomeConfig(), off: int = -2) -> np.ndarray:
    """snp_distance(), or on_genome() with -1 for `off`."""
    d = np.abs(a - b)
    circle = lambda length: np.where(d > length // 2, length - d, d)
    low_a, low_b = a <= g.chr1_len, b <= g.chr1_len
    out = np.where(low_a & low_b, circle(g.chr1_len), np.where(low_a | low_b, -1, circle(g.chr2_len)))
    out = np.where((a > g.total) | (b > g.total), off, out)
    return np.where((a == b) & ((off == -2) | (a <= g.total)), 0, out)


def pair_distances(a: np.ndarray, b: np.ndarray, near_a: np.ndarray | None, near_b: np.ndarray | None, g: GenomeConfig = GenomeConfig()) -> np.ndarray:
    """geno_dis of loci a and b, in this order, with rows of with_places() or without: as snp_distance() or gene_distance()."""
    out = snp_distances(a, b, g)
    if near_a is None or near_b is None or not len(far := np.flatnonzero((a >= g.total) | (b >= g.total))):
        return out
    a, b = a[far], b[far]
    dis = lambda x, y: snp_distances(x, y, g, -1)
    ga, gb = a >= g.total, b >= g.total
    (m1, s1, e1, c1), (m2, s2, e2, c2) = near_a[far].T, near_b[far].T
    known1, known2 = s1 != NONE, s2 != NONE
    lo1, hi1, lo2, hi2 = np.minimum(s1, e1), np.maximum(s1, e1), np.minimum(s2, e2), np.maximum(s2, e2)
    first = (m1 < m2) | ((m1 == m2) & ((s1 < s2) | ((s1 == s2) & (e1 <= e2))))
    gap = np.where(first, np.minimum(dis(e1, s2), dis(s1, e2)), np.minimum(dis(e2, s1), dis(s2, e1)))
    both = np.where((m1 <= g.chr1_len) != (m2 <= g.chr1_len), -1, np.where((lo1 <= hi2) & (lo2 <= hi1), 0, gap))
    base_gene = np.where((a >= lo2) & (a <= hi2), 0, np.minimum(dis(a, s2), dis(a, e2)))
    gene_base = np.where((b >= lo1) & (b <= hi1), 0, np.minimum(np.minimum(dis(b, m1), dis(b, s1)), dis(b, e1)))
    out[far] = np.select([~ga & gb & known2, ga & ~gb & known1, ga & gb & known1 & known2, ga & gb & (c1 == c2) & (c1 != NONE)], [base_gene, gene_base, both, 0], -1)
    return out


def gwes_classes(a: np.ndarray, b: np.ndarray, middle: np.ndarray | None, g: GenomeConfig = GenomeConfig()) -> np.ndarray:
    """gwes_class() as 0 or 1, -1 for none; `middle` is that of the first locus's gene."""
    gene_a, gene_b, low_a, low_b = a > g.total, b > g.total, a < g.chr1_len, b < g.chr1_len
    both = -1 if middle is None else np.where(middle == NONE, -1, np.where(middle < g.chr1_len, 0, np.where(middle > g.chr1_len, 1, -1)))
    two = (a > g.chr1_len) & (b > g.chr1_len) & ((a < g.total) | (b < g.total))
    return np.where(gene_a & gene_b, both, np.where((low_a & (low_b | gene_b)) | (gene_a & low_b), 0, np.where(two, 1, -1))).astype(np.int8)


def highorder_classes(a: np.ndarray, b: np.ndarray, d: np.ndarray, g: GenomeConfig = GenomeConfig()) -> np.ndarray:
    """highorder_class() as 0 or 1, -1 for none."""
    one = (a < g.chr1_len) | (b < g.chr1_len)
    two = (a > g.chr1_len) & (b > g.chr1_len) & ((a < g.total) | (b < g.total))
    return np.where(d > 0, np.where(one, 0, np.where(two, 1, -1)), -1).astype(np.int8)
