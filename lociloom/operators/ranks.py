"""Dense positions and exact quantiles without gathering a group's rows in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lociloom.scratch import Scratch


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "at", total: str | None = None) -> DataFrame:
    """df with its dense position from 0 within the group, in the given order, and the group's size as `total`.

    Rows are range-partitioned by (group, order), so that a hot group or a hot first order column covers many partitions. Counts
    per partition give offsets, and ranks are counted inside a partition only. Null groups are groups; ties have any order.
    """
    scratch = Scratch(df.sparkSession, "ranks")
    ranged = scratch.save(df.repartitionByRange(*[F.col(c) for c in (*group, *order)]).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))  # a row per partition and group in it
    w = W.partitionBy(*group)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__p"), before.alias("__before"), F.sum("__n").over(w).alias("__total"))
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    at = F.col("__before") + F.row_number().over(W.partitionBy(*group, "__part").orderBy(*order)) - 1
    out = ranged.join(offsets, same).withColumn(name, at)
    return out.select(*df.columns, name, *([F.col("__total").alias(total)] if total else []))


def quantiles(df: DataFrame, column: str, probs: Sequence[float], cells: int = 1024) -> list[float] | None:
    """Exact linear quantiles of one column, or None without values. Null and NaN don't count; values must be finite.

    Intervals that hold the wanted ranks are cut into `cells` even parts, whose counts, least and largest values come to the driver, until a
    part has one value. Every pass is a map-side aggregation over df, which should be a written table.
    """
    x = F.col(column).cast("double")
    ok = df.select(x.alias("x")).filter(x.isNotNull() & ~F.isnan(x))
    r = ok.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not r.n:
        return None
    found = order_statistics(ok, {k for p in probs for k in (math.floor((r.n - 1) * p), math.ceil((r.n - 1) * p))}, r.lo, r.hi, cells)
    return interpolated(found, r.n, probs)


def interpolated(found: dict[int, float], n: int, probs: Sequence[float]) -> list[float]:
    """Linear quantiles of n values from those at the ranks next to them."""
    out = []
    for p in probs:
        at = (n - 1) * p
        f, c = found[math.floor(at)], found[math.ceil(at)]
        out.append(f + (c - f) * (at - math.floor(at)))
    return out


def order_statistics(ok: DataFrame, ranks: set[int], least: float, most: float, cells: int = 1024) -> dict[int, float]:
    """The values of x at the ranks, from 0, as quantiles() finds them."""
    found: dict[int, float] = {}
    open_ = {(least, most, 0): ranks}  # interval with the number of values below it -> ranks in it
    while open_:
        spans = list(open_)
        which = [F.when(F.col("x").between(lo, hi), F.struct(F.lit(i).alias("i"), (F.lit(0) if lo == hi else F.floor((F.col("x") - lo) / (hi - lo) * cells)).cast("int").alias("cell"))) for i, (lo, hi, _) in enumerate(spans)]
        counted = ok.select("x", F.coalesce(*which).alias("s")).filter("s is not null").groupBy("s.i", "s.cell").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        rows = sorted(counted.collect(), key=lambda c: (c.i, c.cell))  # at most cells + 1 rows of each interval
        following: dict = {}
        below = {i: s[2] for i, s in enumerate(spans)}
        for c in rows:
            start, below[c.i] = below[c.i], below[c.i] + c.c
            for k in [k for k in open_[spans[c.i]] if start <= k < start + c.c]:
                if c.lo == c.hi or k == start:
                    found[k] = c.lo
                elif k == start + c.c - 1:
                    found[k] = c.hi
                else:
                    following.setdefault((c.lo, c.hi, start), set()).add(k)
        open_ = following
    return found


def bounded_parts(members: DataFrame, key: str, rows_per_task: int = 50_000, hot_keys: int = 500) -> DataFrame:
    """(key, __parts) of keys with so many rows that a join should split them; at most hot_keys rows by counting, so it may be broadcast."""
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = members.count()
    return sizes.filter(F.col("__n") > max(rows_per_task, total // hot_keys)).select(key, F.ceil(F.col("__n") / rows_per_task).cast("int").alias("__parts"))


def salted(rows: DataFrame, key: str, hot: DataFrame, spread: Column | None, name: str = "__salt") -> DataFrame:
    """rows with a salt: by the hash `spread` for the side with many rows of a hot key, or, without it, a copy for every part of the key."""
    h = F.broadcast(hot.select(F.col(key).alias("__hot"), "__parts"))
    j = rows.join(h, F.col(key) == F.col("__hot"), "left").drop("__hot")
    parts = F.coalesce("__parts", F.lit(1))
    salt = F.explode(F.sequence(F.lit(0), parts - 1)) if spread is None else F.pmod(F.xxhash64(spread), parts).cast("int")
    return j.withColumn(name, salt).drop("__parts")
