"""Uniform choice of a given number of rows per key, exact and without gathering a key's rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lociloom.scratch import Scratch

BUCKET_ROWS = 20_000


def pick(df: DataFrame, wanted: DataFrame, keys: Sequence[str], quota: str, total: str, u: str, scratch: Scratch) -> DataFrame:
    """The `quota` rows with the least `u` (uniform in 0..1) of each key, of which `total` rows exist.

    `wanted` has each key's quota once. Only rows below a threshold that leaves quota + 8 sigma candidates are shuffled, and df is read once;
    should a key come short, it is picked from all its rows. Candidates are ranked in buckets of u of about BUCKET_ROWS rows, whose
    sizes add up to the rank.
    """
    q, n = F.col(quota), F.col(total)
    share = F.least(F.lit(1.0), (q + 8 * F.sqrt(q) + 64) / n)
    rows = df.filter(q > 0).withColumn("__thr", share)
    near, seen = scratch.save_counting(rows.filter(F.col(u) <= F.col("__thr")), "near", F.max(q).alias("most"))
    goals = wanted.filter(q > 0).select(*keys, q.alias("__q"))
    short = goals.join(near.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")), list(keys), "left").filter("coalesce(__c, 0) < __q").select(*keys)
    if not short.isEmpty():  # of probability below 1e-12, unless rows share their u
        every, seen = scratch.save_counting(rows.join(short, list(keys), "left_semi").withColumn("__thr", F.lit(1.0)).unionByName(near.join(short, list(keys), "left_anti")), "near", F.max(q).alias("most"))
        scratch.drop(near)
        near = every
    parts = F.ceil(q / BUCKET_ROWS)
    near = near.withColumn("__bucket", F.least(parts - 1, F.floor(F.col(u) / F.col("__thr") * parts)).cast("int"))
    place = F.row_number().over(W.partitionBy(*keys, "__bucket").orderBy(u))
    if (seen["most"] or 0) <= BUCKET_ROWS:
        return near.withColumn("__at", place).filter(F.col("__at") <= q).drop("__at", "__bucket", "__thr")
    sizes = near.filter(parts > 1).groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.withColumn("__before", F.sum("__size").over(W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))).drop("__size")
    ranked = near.withColumn("__at", place).join(before, [*keys, "__bucket"], "left")
    return ranked.filter(F.col("__at") + F.coalesce("__before", F.lit(0)) <= q).drop("__at", "__before", "__bucket", "__thr")
