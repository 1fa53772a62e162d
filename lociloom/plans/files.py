"""From files to files: scored pairs of a matrix, and the whole-data analysis with its results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociloom.config import VpConfig
from lociloom.operators.matrix import binarise, check_unique, check_weights, minor_filter
from lociloom.operators.pairs import all_pairs
from lociloom.plans.vp import VpResult, restore_physical, run_vp, sample_positions
from lociloom.scratch import Scratch
from lociloom.sources.readers import header, read_genes, read_matrix, read_weights
from lociloom.sources.sinks import write_pairs
from lociloom.functions.distance import gene_places


def weights_of(spark: SparkSession, matrix_path: str, matrix: DataFrame, weights_path: str | None) -> DataFrame:
    """(sample_pos, weight) from a file, checked against the matrix's samples, or one for every sample."""
    samples = sample_positions(matrix, "alleles")
    if weights_path is None:
        return samples.select("sample_pos", F.lit(1.0).alias("weight"))
    w = read_weights(spark, weights_path, header(spark, matrix_path)).select("sample_pos", "weight")
    check_weights(samples, w)
    return w


def pairs_from_files(spark: SparkSession, matrix_path: str, weights_path: str | None = None, threshold: float = 0.3, target: str | None = None, kind: str = "parquet", cfg: VpConfig = VpConfig(), places: tuple[int, int] | None = None) -> DataFrame:
    """All pairs of a matrix file that reach the threshold, written to `target` if it is named; `places` limits the first locus's row."""
    scratch = Scratch(spark, "files")
    m = scratch.save(read_matrix(spark, matrix_path), "matrix")
    check_unique(m)
    x = scratch.save(minor_filter(binarise(m), cfg.maf, cfg.min_mac), "binary")
    out = all_pairs(x, weights_of(spark, matrix_path, m, weights_path), threshold, cfg.tile, cfg.clip_eps, places=places)
    if target is not None:
        write_pairs(out, target, kind)
    return out


def analysis_from_files(spark: SparkSession, matrix_path: str, folder: str, cfg: VpConfig = VpConfig(), weights_path: str | None = None, genes: tuple[str, str, str] | None = None) -> VpResult:
    """The whole-data analysis of a matrix file: final, annotated and restored pairs and the pattern map in `folder`."""
    scratch = Scratch(spark, "files")
    m = scratch.save(read_matrix(spark, matrix_path), "matrix")
    places = scratch.save(gene_places(*read_genes(spark, *genes), cfg.genome), "genes") if genes is not None else None
    r = run_vp(m, cfg, scratch, weights_of(spark, matrix_path, m, weights_path) if weights_path is not None else None, places=places)
    for name, df in (("final_pairs", r.pairs), ("annotated_pairs", r.annotated), ("restored_pairs", restore_physical(r, cfg, places=places))):
        write_pairs(df, f"{folder}/{name}")
    r.pattern_map.write.mode("overwrite").parquet(f"{folder}/pattern_map")
    return r
