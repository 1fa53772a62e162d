"""Outlier thresholds of pair scores beyond linkage distance, and the filters that use them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociloom.config import GenomeConfig
from lociloom.functions.distance import gene_distance, gwes_class, gwes_classes, highorder_class, ld_flag, linear_distance, pair_distances, snp_distance, with_places
from lociloom.operators.pairs import Block, all_pairs
from lociloom.operators.ranks import interpolated, order_statistics, quantiles
from lociloom.scratch import Scratch

GRID = 512


def annotate(pairs: DataFrame, g: GenomeConfig = GenomeConfig(), places: DataFrame | None = None) -> DataFrame:
    """Adds geno_dis, LD and chrom, the chromosome of the outlier threshold, to (locus1, locus2, v, ...).

    With places of genes, pairs with a gene are looked up there, and two genes belong to the chromosome of the first one. Without, an id above
    the genome gives -2. Pairs of two bases, usually most, are not joined.
    """
    a, b = F.col("locus1"), F.col("locus2")
    bases = pairs if places is None else pairs.filter((a < g.total) & (b < g.total))
    out = bases.withColumn("geno_dis", snp_distance(a, b, g)).withColumn("chrom", gwes_class(a, b, g))
    if places is not None:
        near = gene_distance(pairs.filter((a >= g.total) | (b >= g.total)), places, g, middle="__mid")
        out = out.unionByName(near.withColumn("chrom", gwes_class(a, b, g, F.col("__mid"))).drop("__mid"))
    return out.withColumn("LD", ld_flag(F.col("geno_dis")))


def beyond_ld(pairs: DataFrame, ld_chr1: int = 5000, ld_chr2: int = 17500) -> DataFrame:
    """Annotated pairs beyond linkage on one chromosome."""
    return pairs.filter(((F.col("chrom") == "chr1") & (F.col("geno_dis") > ld_chr1)) | ((F.col("chrom") == "chr2") & (F.col("geno_dis") > ld_chr2)))


def quartiles(df: DataFrame, column: str = "v") -> tuple[float, float] | None:
    """Exact first and third quartile, or None without values."""
    q = quantiles(df, column, (0.25, 0.75))
    return None if q is None else (q[0], q[1])


def iqr_threshold(values: DataFrame, k: float = 1, column: str = "v") -> float:
    """q3 + 1.5 int(k) IQR; k below 1 is the threshold itself; 0 without values."""
    if k < 1:
        return float(k)
    q = quartiles(values, column)
    return 0.0 if q is None else q[1] + 1.5 * int(k) * (q[1] - q[0])


def kde_peak(values: DataFrame, column: str = "v", bandwidth: str | float = "scott", grid: int = GRID) -> float | None:
    """Where the Gaussian density of the values is largest on an even grid of `grid` points; None below two values or without spread.

    Every task adds up the density of its own values on the grid, and `grid` numbers per task are summed.
    """
    x = F.col(column).cast("double")
    r = values.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd")).first()
    if r.n < 2 or not r.sd:
        return None
    factor = {"scott": r.n ** (-0.2), "silverman": (r.n * 0.75) ** (-0.2)}.get(bandwidth, bandwidth)
    h, lo, step = float(factor) * r.sd, r.lo, (r.hi - r.lo) / (grid - 1)

    def heights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, total = lo + np.arange(grid)[:, None] * step, np.zeros(grid)
        for pdf in batches:
            v, c = np.unique(pdf.x.to_numpy(), return_counts=True)
            for k in range(0, len(v), 2048):
                total += np.exp(-0.5 * ((points - v[k : k + 2048]) / h) ** 2) @ c[k : k + 2048]
        yield pd.DataFrame({"i": np.arange(grid), "height": total})

    parts = values.select(x.alias("x")).filter("x is not null").mapInPandas(heights, "i int, height double")
    i = parts.groupBy("i").agg(F.sum("height").alias("height")).agg(F.max_by("i", F.struct("height", -F.col("i"))).alias("i")).first().i
    return lo + i * step


def kde_threshold(values: DataFrame, margin: float, column: str = "v", bandwidth: str | float = "scott", fallback_k: int = 3) -> float:
    peak = kde_peak(values, column, bandwidth)
    return iqr_threshold(values, fallback_k, column) if peak is None else peak + margin


def final_filter(pairs: DataFrame, threshold: float, ld_chr1: int = 5000, ld_chr2: int = 17500, cross: bool = True) -> DataFrame:
    """Annotated pairs above the threshold (strictly) beyond linkage on one chromosome or, with cross, between chromosomes; -2 is dropped."""
    c, d = F.col("chrom"), F.col("geno_dis")
    far = ((c == "chr1") & (d > ld_chr1)) | ((c == "chr2") & (d > ld_chr2))
    return pairs.filter((F.coalesce(far, F.lit(False)) | ((d == -1) & F.lit(cross))) & (F.col("v") > threshold))


def run_gwes(pairs: DataFrame, k: float = 1, ld_chr1: int = 5000, ld_chr2: int = 17500, margin: float | None = None, g: GenomeConfig = GenomeConfig(), places: DataFrame | None = None) -> tuple[DataFrame, DataFrame, float]:
    """(filtered, annotated, threshold) of scored pairs on two chromosomes, with genes at the given places."""
    a = Scratch(pairs.sparkSession, "gwes").save(annotate(standard_columns(pairs), g, places), "annotated")  # read by every pass
    t = iqr_threshold(beyond_ld(a, ld_chr1, ld_chr2), k) if margin is None else kde_threshold(a.filter("geno_dis >= 0"), margin)
    return final_filter(a, t, ld_chr1, ld_chr2), a, t


FOUND = "kind int, locus1 long, locus2 long, v double, geno_dis long, chrom string"
#: Even ranges of 0..1 in which scores are counted, parts of tiles for a first estimate, and how far a quartile's rank may lie from it.
CELLS, TRIED, REACH = 4096, 256, 0.01


def all_pair_outliers(binary: DataFrame, weights: DataFrame, least: float, k: int, ld_chr1: int = 5000, ld_chr2: int = 17500, g: GenomeConfig = GenomeConfig(), places: DataFrame | None = None, tile: int = 1024) -> tuple[DataFrame, float]:
    """(filtered, threshold) of run_gwes() of all pairs that score at least `least`, straight from the rows: of the pairs only the filtered ones are stored.

    Scores beyond linkage are first counted by ranges, from some parts of the tiles where these are many. Then all pairs are scored: their numbers below and
    above the quartiles' ranges are counted, and only scores in those ranges and pairs above the least threshold that they allow are written. If
    a quartile lies outside, which the counts tell, everything is counted first.
    """
    scratch = Scratch(binary.sparkSession, "outliers")
    rows = scratch.save(with_places(binary.select("locus", "row_pos", "x"), places), "rows")
    n = rows.count()
    every, genes = max(1, (n // tile) ** 2 // 2 // TRIED), places is not None

    def annotated(a: Block, b: Block, i: slice, j: slice, r: np.ndarray, c: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        x, y = a.locus[i][r], b.locus[j][c]
        one, two = np.where(first, x, y), np.where(first, y, x)
        near = (None, None)
        if genes:
            p, q = np.array(a.extra[i]).reshape(-1, 4)[r], np.array(b.extra[j]).reshape(-1, 4)[c]
            near = np.where(first[:, None], p, q), np.where(first[:, None], q, p)
        d = pair_distances(one, two, *near, g)
        chrom = gwes_classes(one, two, None if near[0] is None else near[0][:, 0], g)
        return one, two, d, chrom, ((chrom == 0) & (d > ld_chr1)) | ((chrom == 1) & (d > ld_chr2))

    def count(a: Block, b: Block, i: slice, j: slice, r: np.ndarray, c: np.ndarray, first: np.ndarray, v: np.ndarray) -> Iterator[pd.DataFrame]:
        cells, n = np.unique((v[annotated(a, b, i, j, r, c, first)[-1]] * CELLS).astype(np.int32), return_counts=True)
        yield pd.DataFrame({"cell": cells, "n": n})

    def spans(share: int) -> list[tuple[int, int]]:
        """Ranges of cells, both ends included, about the quartiles."""
        counted = all_pairs(rows, weights, least, tile, extra="place", emit=count, schema="cell int, n long", every=share)
        by = sorted((x.cell, x.n) for x in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect())  # at most CELLS rows
        if not by:
            return []
        cell, upto = np.array([b[0] for b in by]), np.cumsum([b[1] for b in by])
        reach = REACH if share > 1 else 0
        at = lambda rank: int(cell[min(np.searchsorted(upto, rank, side="right"), len(cell) - 1)])
        m = int(upto[-1]) - 1
        return [(at(math.floor(m * max(0, q - reach))), at(math.ceil(m * min(1, q + reach)))) for q in (0.25, 0.75)]

    for share in dict.fromkeys((every, 1)):
        two = spans(share)
        if not two and share > 1:
            continue
        low = two[1][0] / CELLS + 1.5 * int(k) * (two[1][0] / CELLS - (two[0][1] + 1) / CELLS) if two else 0.0  # no threshold is below it
        ends = [two[0]] if two and two[0] == two[1] else [(two[0][0], two[1][1])] if two and two[0][1] >= two[1][0] else two

        def find(a: Block, b: Block, i: slice, j: slice, r: np.ndarray, c: np.ndarray, first: np.ndarray, v: np.ndarray) -> Iterator[pd.DataFrame]:
            one, two, d, chrom, far = annotated(a, b, i, j, r, c, first)
            zone = np.searchsorted(np.array([e for lo, hi in ends for e in (lo, hi + 1)]), (v * CELLS).astype(np.int32), side="right")
            yield pd.DataFrame({"kind": 0, "locus1": np.arange(2 * len(ends) + 1), "locus2": np.bincount(zone[far], minlength=2 * len(ends) + 1), "v": np.nan, "geno_dis": 0, "chrom": ""})
            near = far & (zone % 2 == 1)
            yield pd.DataFrame({"kind": zone[near], "locus1": 0, "locus2": 0, "v": v[near], "geno_dis": 0, "chrom": ""})
            top = (far | (d == -1)) & (v > low)
            yield pd.DataFrame({"kind": -1, "locus1": np.minimum(one, two)[top], "locus2": np.maximum(one, two)[top], "v": v[top], "geno_dis": d[top], "chrom": np.array(["chr1", "chr2", None], dtype=object)[chrom[top]]})

        found = scratch.save(all_pairs(rows, weights, least, tile, extra="place", emit=find, schema=FOUND), "found")
        zones = {x.zone: x.n for x in found.filter("kind = 0").groupBy(F.col("locus1").alias("zone")).agg(F.sum("locus2").alias("n")).collect()}
        total = sum(zones.values())
        t = _threshold(found, zones, total, len(ends), k) if total else 0.0
        if t is not None:
            break
        scratch.drop(found)
    kept = found.filter((F.col("kind") == -1) & (F.col("v") > t)).drop("kind")
    return kept.withColumn("LD", ld_flag(F.col("geno_dis"))), t


def _threshold(found: DataFrame, zones: dict[int, int], total: int, ends: int, k: int) -> float | None:
    """q3 + 1.5 k IQR from the written scores of the odd zones, None if a quartile is not among them."""
    ranks, known = {f((total - 1) * p) for p in (0.25, 0.75) for f in (math.floor, math.ceil)}, {}
    below = 0
    for zone in range(2 * ends + 1):
        n = zones.get(zone, 0)
        mine = {r - below for r in ranks if below <= r < below + n}
        if mine and zone % 2 == 0:
            return None
        if mine:
            x = found.filter(F.col("kind") == zone).select(F.col("v").alias("x"))
            r = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
            known |= {below + i: v for i, v in order_statistics(x, mine, r.lo, r.hi).items()}
        below += n
    q1, q3 = interpolated(known, total, (0.25, 0.75))
    return q3 + 1.5 * int(k) * (q3 - q1)


def standard_columns(pairs: DataFrame) -> DataFrame:
    """(locus1, locus2, v): the named columns, else the first three."""
    if {"locus1", "locus2", "v"} <= set(pairs.columns):
        return pairs.select("locus1", "locus2", "v")
    if len(pairs.columns) < 3:
        raise ValueError("pairs need three columns: two loci and a score")
    return pairs.toDF(*[f"c{i}" for i in range(len(pairs.columns))]).selectExpr("try_cast(c0 as bigint) as locus1", "try_cast(c1 as bigint) as locus2", "cast(c2 as double) as v")


def run_gwes_single(pairs: DataFrame, length: int, k: float = 1, ld: int = 1) -> tuple[DataFrame, float]:
    """One chromosome: rows beyond linkage with v >= threshold, which excludes linked rows by LD = -1."""
    ld = max(ld, 1)
    a = pairs.select("locus1", "locus2", "v", linear_distance(F.col("locus1"), F.col("locus2"), length).alias("geno_dis"))
    a = a.withColumn("LD", F.when(F.col("geno_dis") <= ld, -1).otherwise(0).cast("tinyint"))
    far = a.filter("LD = 0")
    t = 0.0 if k < -1 else iqr_threshold(far, min(max(int(k), 1), 3)) if k >= 1 else float(k)
    return far.filter(F.col("v") >= t), t


def by_chromosome(pairs: DataFrame, g: GenomeConfig = GenomeConfig(), places: DataFrame | None = None) -> DataFrame:
    """Scored pairs with a positive distance and the chromosome of the comparison with subgroups; for the tables of both sides alike."""
    a = annotate(standard_columns(pairs), g, places).drop("chrom")
    return a.withColumn("chrom", highorder_class(F.col("locus1"), F.col("locus2"), F.col("geno_dis"), g)).filter("chrom is not null")


def gene_pair_chromosome(pairs: DataFrame, places: DataFrame, g: GenomeConfig = GenomeConfig()) -> DataFrame:
    """Pairs of two genes with the chromosome on which both have their middle, null where they differ or one has no place."""
    side = lambda n: places.select(F.col("locus_id").alias(f"__l{n}"), F.when(F.col("mid") <= g.chr1_len, "chr1").when(F.col("mid").isNotNull(), "chr2").alias(f"__c{n}"))
    j = pairs.filter((F.col("locus1") > g.total) & (F.col("locus2") > g.total)).join(side(1), F.col("locus1") == F.col("__l1"), "left").join(side(2), F.col("locus2") == F.col("__l2"), "left")
    return j.select(*pairs.columns, F.when(F.col("__c1") == F.col("__c2"), F.col("__c1")).alias("gene_chrom"))
