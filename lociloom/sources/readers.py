"""Readers of matrices, weights, pairs, gene tables and background lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociloom.operators.matrix import with_row_position
from lociloom.sources.sinks import exists


def header(spark: SparkSession, path: str) -> list[str]:
    """Sample names from the first line or from the schema; the data isn't read."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).columns[1:]
    return spark.read.text(path).first()[0].split("\t")[1:]


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(locus, row_pos, alleles) from a table with a locus column followed by a column per sample.

    Text is split into an array, so that the plan has three columns however many samples there are. Repeated loci or rows of other
    lengths are errors when read.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return with_row_position(df.select(F.col(f"`{df.columns[0]}`").cast("bigint").alias("locus"), F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns[1:]]).alias("alleles"))).select("locus", "row_pos", "alleles")
    first = spark.read.text(path).first()[0]
    n = len(first.split("\t"))
    cells = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.col("value") != F.lit(first)).select(F.when(F.size(cells) == n, cells).otherwise(F.raise_error(F.concat(F.lit("a row of another length: "), F.substring("value", 1, 40)))).alias("c"))
    return with_row_position(rows.select(F.col("c")[0].cast("bigint").alias("locus"), F.slice("c", 2, n - 1).alias("alleles"))).select("locus", "row_pos", "alleles")


def read_weights(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """(sample_pos, sample, weight) from a CSV: column wet, else the first after the name; by position if there are no names."""
    df = spark.read.csv(path, header=True)
    name, value = df.columns[0], "wet" if "wet" in df.columns else df.columns[min(1, len(df.columns) - 1)]
    rows = with_row_position(df.select(F.col(f"`{name}`").alias("sample"), F.col(f"`{value}`").cast("double").alias("weight")), "sample_pos")
    if samples is None or name == value:
        return rows.select(F.col("sample_pos").cast("int").alias("sample_pos"), "sample", "weight")
    order = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "sample_pos int, sample string")
    return order.join(rows.select("sample", "weight"), "sample", "left").select("sample_pos", "sample", "weight")


def long_matrix(calls: DataFrame, samples: DataFrame, missing: str = "-") -> DataFrame:
    """(locus, row_pos, alleles) from calls(locus, sample_pos, allele); a locus's array has an entry per known sample.

    Several calls of a sample count as the least; a sample without a call has `missing`. Arrays are as long as the list of samples.
    """
    n = samples.agg(F.max("sample_pos") + 1).first()[0]
    one = calls.groupBy("locus", "sample_pos").agg(F.min("allele").alias("allele"))
    e = one.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct(F.col("sample_pos").cast("int").alias("at"), "allele"))).alias("e"))
    gap = lambda k: F.array_repeat(F.lit(missing), k)
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("e", i - 1)["at"])
    parts = F.transform("e", lambda x, i: F.concat(gap(x["at"] - before(i) - 1), F.array(x["allele"])))
    tail = gap(F.lit(n - 1) - F.element_at("e", -1)["at"])
    return e.select("locus", F.col("locus").alias("row_pos"), F.concat(F.flatten(parts), tail).alias("alleles"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(locus1, locus2, v) from Parquet, else from a headerless TSV or from the Parquet of the same name with .parquet added, if it is there."""
    for known in (path, f"{path}.parquet"):
        if known.endswith(".parquet") and exists(spark, known):
            return spark.read.parquet(known).select("locus1", "locus2", "v")
    return spark.read.schema("locus1 long, locus2 long, v float").csv(path, sep="\t")


def read_genes(spark: SparkSession, ids: str, intervals: str, contigs: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """genes(locus_id, g), intervals(qacc, sstart, send, sacc), contigs(qacc, sacc)."""
    a = spark.read.schema("locus_id long, g string").csv(ids, sep=" ")
    b = spark.read.csv(intervals, header=True).select("qacc", F.col("sstart").cast("int"), F.col("send").cast("int"), "sacc")
    return a, b, spark.read.csv(contigs, header=True).select("qacc", "sacc")


def read_backgrounds(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """(ordinal, locus) from a TSV or CSV; the named column, else the first numeric one."""
    first = spark.read.text(path).first()[0]
    df = spark.read.csv(path, header=True, sep="\t" if "\t" in first else ";" if ";" in first else ",")
    if column is None:
        r = df.select([F.count(F.when(F.col(f"`{c}`").try_cast("bigint").isNull(), 1)).alias(c) for c in df.columns]).first().asDict()
        column = next((c for c in df.columns if r[c] == 0), None)
        if column is None:
            raise ValueError("no numeric column")
    return with_row_position(df.select(F.col(f"`{column}`").cast("bigint").alias("locus")), "ordinal").select("ordinal", "locus")
