"""Allele matrices: one row per locus, samples as an array in sample order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociloom.functions import encode as E


def with_row_position(df: DataFrame, name: str = "row_pos") -> DataFrame:
    """Dense positions in the order of the input's partitions, without gathering rows: counts per partition give offsets."""
    tagged = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    sizes = tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row per partition
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select(F.col("__part"), before.alias("__before")))
    return tagged.join(offsets, "__part").withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__n", "__before")


def to_long(matrix: DataFrame, values: str = "x") -> DataFrame:
    return matrix.select("locus", "row_pos", F.posexplode(values).alias("sample_pos", values))


def is_numeric(matrix: DataFrame, column: str = "alleles") -> bool:
    """Whether the matrix holds numbers instead of letters."""
    return not isinstance(matrix.schema[column].dataType.elementType, T.StringType)


def binarise(matrix: DataFrame, alleles: str = "alleles") -> DataFrame:
    """(locus, row_pos, x): 1 where the major allele stands.

    Letters must be one symbol each, of any alphabet. Numbers that are all 0 or 1 keep their own coding, in which 1 need not be major;
    other numbers are recoded by their major value.
    """
    a = F.col(alleles)
    if is_numeric(matrix, alleles):
        if matrix.filter(~E.is_binary(a)).isEmpty():
            return matrix.select("locus", "row_pos", a.cast("array<tinyint>").alias("x"))
        return matrix.select("locus", "row_pos", E.major_indicator(E.numeric_codes(a)).alias("x"))
    return matrix.select("locus", "row_pos", E.major_indicator(E.one_symbol_each(a)).alias("x"))


def minor_filter(binary: DataFrame, maf: float = 0.02, min_mac: int = 5, one_sided: bool = False) -> DataFrame:
    """Loci whose minor count is at least maf of the samples and min_mac; one_sided takes 1 as the major state."""
    def passes(n: Column, c: Column) -> Column:
        minor = (n - c) if one_sided else F.least(c, n - c)
        return (minor / n >= maf) & (minor >= min_mac)

    # exists() over one element binds the row and its count, which are used several times
    return binary.filter(F.exists(F.array("x"), lambda x: F.exists(F.array(E.ones(x)), lambda c: passes(F.size(x), c))))


def weight_row(weights: DataFrame) -> DataFrame:
    """(w, total): all samples' weights in one row, in sample order. Samples are columns of the matrix, so this is as long as a row of it."""
    ordered = F.array_sort(F.collect_list(F.struct("sample_pos", F.col("weight").cast("double").alias("weight"))))
    return weights.agg(ordered["weight"].alias("w"), F.sum(F.col("weight").cast("double")).alias("total"))


def check_unique(matrix: DataFrame) -> None:
    """An error if a locus has several rows."""
    twice = [r.locus for r in matrix.groupBy("locus").count().filter("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"loci that occur twice: {twice}")


def check_weights(samples: DataFrame, weights: DataFrame) -> None:
    """Every sample has one finite weight that isn't negative, and they don't add up to 0."""
    j = samples.select("sample_pos").join(weights, "sample_pos", "left")
    bad = F.col("weight").isNull() | F.isnan("weight") | (F.abs("weight") == float("inf")) | (F.col("weight") < 0)
    r = j.agg(F.count(F.when(bad, 1)).alias("bad"), F.sum("weight").alias("total")).first()
    if r.bad or not r.total or r.total <= 0:
        raise ValueError(f"{r.bad} samples without a usable weight, total {r.total}")


def marginals(binary: DataFrame, weights: DataFrame) -> DataFrame:
    """(locus, row_pos, x, w, total, dp): weight of the samples with 1."""
    return binary.crossJoin(F.broadcast(weight_row(weights))).withColumn("dp", E.weighted_ones(F.col("x"), F.col("w")))


def entropy_bound(rows: DataFrame, threshold: float, slack: float = 1e-6) -> DataFrame:
    """Loci that can reach the threshold at all: a score can't exceed the root of either locus's entropy."""
    from lociloom.functions.score import entropy

    return rows.filter(entropy(F.col("dp") / F.col("total")) >= threshold - slack)

