"""Exact percentiles per group by bisection, and summaries with bounded error that combine.

For each (group, measure, probability) an interval of values is kept that holds the wanted rank. A pass halves every interval HALVINGS times
at once: the rows between neighbouring midpoints are counted, with the least and the largest of them, and the interval shrinks to the part with
the rank. Its ends are values of the data, so ties resolve exactly, and a wanted pair of ranks that a midpoint separates is resolved at once.
Only rows inside an interval that is still open go on to the next pass. All groups take the passes, whatever their size.

A group's rows are never together: parts are counted map-side, and intervals reach the rows by a join that is a broadcast for the few
groups with more than 1/HOT_PARTS of the rows, at most HOT_PARTS by counting, and a shuffle for the others.

Counts, minima and maxima of disjoint tables add up, so rows may come in any number of tables. Where old rows are gone, `summary`
keeps counts on a fixed grid of midpoints: summaries of days or partitions are combined by `merge`, and `bounds` encloses each percentile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lociloom.scratch import Scratch

HALVINGS = 4
HOT_PARTS = 500


def part_of(x: Column, lo: Column, hi: Column, halvings: int = HALVINGS) -> Column:
    """Which part of [lo, hi] x lies in; grows with x, and lo and hi lie in different parts.

    Parts are even between ends of one sign and order, geometric where the ends differ more (else narrowing would take long near 0), on both
    sides of 0 where it lies between them, and the infinities are parts of their own.
    """
    n, half, ends = 2**halvings, 2 ** (halvings - 1), float("inf")
    side = lambda share: F.least(F.floor(share * half), F.lit(half - 1))
    return (
        F.when((lo == -ends) | (hi == ends), F.when(x == -ends, -1).when(x == ends, 1).otherwise(0))
        .when((lo <= 0) & (hi >= 0), F.when(x < 0, -1 - side(x / lo)).when(x > 0, 1 + side(x / hi)).otherwise(0))
        .when((lo > 0) & (hi > 4 * lo), F.floor(n * ((F.ln(x) - F.ln(lo)) / (F.ln(hi) - F.ln(lo)))))
        .when((hi < 0) & (lo < 4 * hi), -F.floor(n * ((F.ln(-x) - F.ln(-hi)) / (F.ln(-lo) - F.ln(-hi)))))
        .otherwise(F.floor(n * ((x - lo) / (hi - lo))))
        .cast("int")
    )


def _narrow(counted: DataFrame) -> DataFrame:
    """The part with the wanted ranks of each (g, t), from (g, t, n, rf, rc, part, c, least, most); rf and rc are ranks inside the interval.

    done targets have the values f and c of both ranks. At most 2^HALVINGS + 1 rows of a (g, t) meet here.
    """
    upto = F.sum("c").over(W.partitionBy("g", "t").orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    at = counted.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))
    with_f = (F.col("before") <= F.col("rf")) & (F.col("rf") < F.col("upto"))
    with_c = (F.col("before") <= F.col("rc")) & (F.col("rc") < F.col("upto"))
    one = at.groupBy("g", "t", "n", "rf", "rc").agg(
        *[F.max(F.when(with_f, F.col(k))).alias(k) for k in ("part", "c", "before", "least", "most")], F.max(F.when(with_c, F.col("part"))).alias("part_c"), F.max(F.when(with_c, F.col("least"))).alias("least_c")
    )
    lo, hi, c = F.col("least"), F.col("most"), F.col("c")
    rf, rc = F.col("rf") - F.col("before"), F.col("rc") - F.col("before")
    apart = F.col("part") != F.col("part_c")
    low = F.when(apart, hi).when((lo == hi) | ((rf == 0) & ((rc == 0) | (c == 2))), lo).when(rf == c - 1, hi)
    high = F.when(apart, F.col("least_c")).when((lo == hi) | (rc == 0), lo).when((rc == c - 1) & ((rf == rc) | (c == 2)), hi)
    out = one.select("g", "t", "n", rf.alias("rf"), rc.alias("rc"), "part", F.col("c").alias("inside"), lo.alias("lo"), hi.alias("hi"), low.alias("f"), high.alias("c"))
    return out.withColumn("done", F.col("f").isNotNull() & F.col("c").isNotNull())


def _meet(rows: DataFrame, state: DataFrame, keys: Sequence[str], rows_of: str, most: int, total: int) -> DataFrame:
    """rows joined with state (unique on keys, which may be null); keys with many of the `total` rows from a broadcast of at most HOT_PARTS rows."""
    cut = max(total // HOT_PARTS, 10_000)
    named = state.withColumnsRenamed({k: f"s_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"s_{k}"))
    if most <= cut:
        return rows.join(named, same).drop(*[f"s_{k}" for k in keys])
    hot = F.broadcast(named.filter(F.col(rows_of) > cut))
    cold = rows.join(hot.select(*[f"s_{k}" for k in keys]), same, "left_anti").join(named.filter(F.col(rows_of) <= cut), same)
    return cold.unionByName(rows.join(hot, same)).drop(*[f"s_{k}" for k in keys])


def percentiles(tables: Sequence[DataFrame], group: str, measures: Sequence[str], probs: Sequence[float], scratch: Scratch, halvings: int = HALVINGS, passes: list | None = None) -> DataFrame:
    """(group_key, measure, n, p0, p1, ...): linear percentiles of each measure per group over all tables together.

    Null and NaN values don't count; infinite ones do and must not meet the interpolation. A group without a value of a measure has no
    row for it. A null group is a group. The tables must be disjoint parts of the data with the named columns; others may have any name.
    `passes`, if given, gets the number of open targets before each further pass.
    """
    k = len(probs)
    xs = [f"x{i}" for i in range(len(measures))]

    def slim(t: DataFrame) -> DataFrame:
        return t.select(F.col(f"`{group}`").alias("g"), *[F.nanvl(F.col(f"`{m}`").cast("double"), F.lit(None)).alias(x) for m, x in zip(measures, xs)])

    rows = slim(tables[0])
    for t in tables[1:]:
        rows = rows.unionByName(slim(t))
    ends = rows.agg(*[f(x).alias(f"{name}{x}") for x in xs for f, name in ((F.min, "lo"), (F.max, "hi"))]).first()
    first_part = {x: F.lit(0) if ends[f"lo{x}"] is None or ends[f"lo{x}"] == ends[f"hi{x}"] else part_of(F.col(x), F.lit(ends[f"lo{x}"]), F.lit(ends[f"hi{x}"]), halvings) for x in xs}

    def pass_over(counted: DataFrame) -> tuple[DataFrame, dict]:
        """The narrowed state, written, with its open targets, the rows inside them, the most rows of one, and sizes of whole groups."""
        open_ = ~F.col("done")
        counts = [F.count(F.when(open_, 1)).alias("open"), F.sum(F.when(open_, F.col("inside"))).alias("rows"), F.max(F.when(open_, F.col("inside"))).alias("most"), F.max("n").alias("most_n"), F.sum("n").alias("all_n")]
        state, seen = scratch.save_counting(_narrow(counted), "intervals", *counts)
        return state, {name: v or 0 for name, v in seen.items()}

    # the first pass starts from the ends of all values, so it needs no join
    stack = ", ".join(f"{i}, x{i}, part{i}" for i in range(len(xs)))
    tall = rows.select("g", *xs, *[p.alias(f"part{i}") for i, p in enumerate(first_part.values())]).selectExpr("g", f"stack({len(xs)}, {stack}) as (m, x, part)").filter("x is not null")
    counted = tall.groupBy("g", "m", "part").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
    counted = counted.withColumn("n", F.sum("c").over(W.partitionBy("g", "m"))).withColumn("j", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("p")) for j, p in enumerate(probs)])))
    rank = (F.col("n") - 1) * F.col("j.p")
    counted = counted.select("g", (F.col("m") * k + F.col("j.j")).alias("t"), "n", F.floor(rank).cast("bigint").alias("rf"), F.ceil(rank).cast("bigint").alias("rc"), "part", "c", "least", "most")
    state, seen = pass_over(counted)
    states, left = [state], None
    while seen["open"]:
        if passes is not None:
            passes.append(seen["open"])
        open_state = state.filter(~F.col("done"))
        if left is None:  # rows are still as wide as they came: one join per group
            ts = range(len(xs) * k)
            pick = lambda t, c: F.max(F.when(F.col("t") == t, F.col(c)))
            wide = open_state.groupBy("g").agg(F.max("n").alias("n"), *[pick(t, c).alias(f"{c}{t}") for t in ts for c in ("part", "lo", "hi")])
            joined = _meet(rows, wide, ["g"], "n", seen["most_n"], seen["all_n"] // k)
            at = ", ".join(f"{t}, x{t // k}, lo{t}, hi{t}, here{t}" for t in ts)
            here = [(F.col(f"part{t}") == first_part[f"x{t // k}"]).alias(f"here{t}") for t in ts]
            inside = joined.select("*", *here).selectExpr("g", f"stack({len(ts)}, {at}) as (t, x, lo, hi, here)").filter("x is not null and here")
        else:
            joined = _meet(left.withColumnRenamed("part", "was"), open_state.select("g", "t", "part", "inside", "lo", "hi"), ["g", "t"], "inside", seen["most"], seen["rows"])
            inside = joined.filter("was = part")
        new = scratch.save(inside.select("g", "t", "x", part_of(F.col("x"), F.col("lo"), F.col("hi"), halvings).alias("part")), "inside")
        if left is not None:
            scratch.drop(left)
        left = new
        counted = left.groupBy("g", "t", "part").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
        keys = open_state.select(F.col("g").alias("sg"), F.col("t").alias("st"), "n", "rf", "rc")
        counted = counted.join(keys, F.col("g").eqNullSafe(F.col("sg")) & (F.col("t") == F.col("st"))).drop("sg", "st")
        state, seen = pass_over(counted)
        states.append(state)
    if left is not None:
        scratch.drop(left)
    found = states[0]
    for more in states[1:]:
        found = found.unionByName(more)
    value = lambda j: F.max(F.when(F.col("t") % k == j, F.struct("f", "c"))).alias(f"v{j}")
    per = found.filter("done").groupBy("g", F.floor(F.col("t") / k).cast("int").alias("m"), "n").agg(*[value(j) for j in range(k)])
    names = F.array(*[F.lit(m) for m in measures])
    out = [(F.col(f"v{j}.f") + F.when(F.col(f"v{j}.f") == F.col(f"v{j}.c"), 0.0).otherwise((F.col(f"v{j}.c") - F.col(f"v{j}.f")) * ((F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))))).alias(f"p{j}") for j, p in enumerate(probs)]
    return per.select(F.col("g").alias("group_key"), names[F.col("m")].alias("measure"), "n", *out)


def summary(df: DataFrame, group: str, measures: Sequence[str], width: float) -> DataFrame:
    """(g, measure, cell, n, least, most): counts between midpoints that are multiples of `width`, the same for every table.

    Null, NaN and infinite values don't count. A null group is a group. Every row of `df` is read, and none is kept.
    """
    stack = ", ".join(f"'{m}', cast(`{m}` as double)" for m in measures)
    tall = df.selectExpr(f"`{group}` as g", f"stack({len(measures)}, {stack}) as (measure, x)").filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    return tall.groupBy("g", "measure", F.floor(F.col("x") / F.lit(float(width))).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))


def merge(summaries: DataFrame) -> DataFrame:
    """One summary of the union of several with the same width."""
    return summaries.groupBy("g", "measure", "cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def bounds(one: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(group_key, measure, n, p0_low, p0_high, ...): the linear percentile lies between both, which differ by at most the width."""
    w = W.partitionBy("g", "measure")
    at = one.withColumn("upto", F.sum("n").over(w.orderBy("cell").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
    aggs = []
    for j, p in enumerate(probs):
        rank = (F.col("all") - 1) * F.lit(float(p))
        for tag, r in (("f", F.floor(rank)), ("c", F.ceil(rank))):
            here = (F.col("before") <= r) & (r < F.col("upto"))
            aggs += [F.max(F.when(here, F.col(side))).alias(f"{side}_{tag}{j}") for side in ("least", "most")]
    flat = at.groupBy("g", "measure", "all").agg(*aggs)
    out = []
    for j, p in enumerate(probs):
        rank = (F.col("all") - 1) * F.lit(float(p))
        for side, name in (("least", "low"), ("most", "high")):
            f, c = F.col(f"{side}_f{j}"), F.col(f"{side}_c{j}")
            out.append((f + (c - f) * (rank - F.floor(rank))).alias(f"p{j}_{name}"))
    return flat.select(F.col("g").alias("group_key"), "measure", F.col("all").alias("n"), *out)
