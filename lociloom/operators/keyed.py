"""Per-key results without imbalance: values are compressed to (key, value, frequency) before anything is grouped by key.

The first grouping is by key *and* value, so the rows of a hot key spread over all tasks; what is left per key is at most its
distinct values, and the second grouping combines them map-side. No step gathers a key's rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lociloom.scratch import Scratch


def compress(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, field, value, freq): how often each value of each named column occurs per key.

    `value` is bigint (the columns must be integral), `field` the column's name. Null values are kept as a value of their own,
    null keys form a key. Only the named columns are read, so other columns may have any name.
    """
    slim = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(v).cast("bigint").alias(f"v{i}") for i, v in enumerate(values)])
    pairs = ", ".join(f"'{v}', v{i}" for i, v in enumerate(values))
    ks = [f"k{i}" for i in range(len(keys))]
    tall = slim.selectExpr(*ks, f"stack({len(values)}, {pairs}) as (field, value)")
    return tall.groupBy(*ks, "field", "value").agg(F.count(F.lit(1)).alias("freq")).select(*[F.col(k).alias(n) for k, n in zip(ks, keys)], "field", "value", "freq")


def keyed_profile(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key, for each value column c: c_rows (non-null), c_distinct, c_min, c_max and c_mode (most frequent, the smallest on a tie); n_rows.

    Empty input gives no row. Null values count in n_rows only. Keys may be null.
    """
    w = compress(df, keys, values)
    aggs: list[Column] = [F.sum(F.when(F.col("field") == values[0], F.col("freq"))).alias("n_rows")]
    for v in values:
        here = (F.col("field") == v) & F.col("value").isNotNull()
        aggs += [
            F.coalesce(F.sum(F.when(here, F.col("freq"))), F.lit(0)).alias(f"{v}_rows"),
            F.count(F.when(here, 1)).alias(f"{v}_distinct"),
            F.min(F.when(here, F.col("value"))).alias(f"{v}_min"),
            F.max(F.when(here, F.col("value"))).alias(f"{v}_max"),
            F.max_by("value", F.when(here, F.struct("freq", -F.col("value")))).alias(f"{v}_mode"),
        ]
    return w.groupBy(*keys).agg(*aggs)


def keyed_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], scratch: Scratch) -> DataFrame:
    """Exact linear percentiles per key from weighted values, also for keys that hold most rows: (keys, prob, n, percentile).

    The compressed values are range-partitioned by (keys, value), so that a hot key covers many partitions; each partition's
    weight gives an offset, and ranks are running sums inside a partition. Null values don't count; a key without values is absent.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    w = compress(df, keys, [value]).filter(F.col("value").isNotNull()).select(*[F.col(n).alias(k) for k, n in zip(ks, keys)], "value", "freq")
    ranged = scratch.save(w.repartitionByRange(*ks, "value").withColumn("part", F.spark_partition_id()), "ranged")
    per_part = ranged.groupBy(*ks, "part").agg(F.sum("freq").alias("weight"))
    before = W.partitionBy(*ks).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    js = [f"j{i}" for i in range(len(keys))]
    offsets = per_part.select(
        *[F.col(k).alias(j) for k, j in zip(ks, js)], F.col("part").alias("in_part"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("offset"), F.sum("weight").over(W.partitionBy(*ks)).alias("n"),
    )
    cond = F.col("part") == F.col("in_part")
    for k, j in zip(ks, js):
        cond = cond & F.col(k).eqNullSafe(F.col(j))
    joined = ranged.join(offsets, cond).drop("in_part", *js)
    upto = F.sum("freq").over(W.partitionBy(*ks, "part").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    ranks = joined.withColumn("hi", F.col("offset") + upto).withColumn("lo", F.col("hi") - F.col("freq"))
    aggs = []
    for i, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        for tag, r in (("f", F.floor(at)), ("c", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("lo") <= r) & (r < F.col("hi")), F.col("value"))).alias(f"{tag}{i}"))
    flat = ranks.groupBy(*ks, "n").agg(*aggs)
    rows = ", ".join(f"cast({float(p)!r} as double), cast(f{i} as double) + (cast(c{i} as double) - cast(f{i} as double)) * (((n - 1) * cast({float(p)!r} as double)) - floor((n - 1) * cast({float(p)!r} as double)))" for i, p in enumerate(probs))
    return flat.selectExpr(*[f"{k} as `{n}`" for k, n in zip(ks, keys)], "n", f"stack({len(probs)}, {rows}) as (prob, percentile)")
