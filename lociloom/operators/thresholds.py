"""Thresholds on score differences: fences, hash-resampled bootstraps, tails, bimodality and their combination.

Resampling is by a hash of (replicate, draw): which row a draw takes depends on nothing else, so results are the same on any cluster and
can be checked in SQL. Rows are numbered by (locus1, locus2, value) within a chromosome. A replicate takes at most `sample_size` draws.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lociloom.config import HighOrderConfig
from lociloom.operators.gwes import kde_peak, quartiles
from lociloom.operators.ranks import positions, quantiles
from lociloom.scratch import Scratch


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """(group, value columns, n, at): dense position from 0 within the group, and the group's size; written, so that its size is known to joins."""
    return Scratch(df.sparkSession, "numbered").save(positions(df, [group], order, "at", "n"))


def draw(replicate: Column, i: Column, salt: str = "") -> Column:
    """A 32-bit integer from md5 of 'salt:replicate:draw', the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), replicate.cast("string"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")


def resample(rows: DataFrame, group: str, value: str, replicates: int, sample_size: int, salt: str = "b") -> DataFrame:
    """(group, replicate, value): draws with replacement. rows needs at and n of numbered().

    Only the draws' addresses are made, replicates * min(n, sample_size) per group, spread over all tasks, and meet the rows by position in a
    shuffle. The values of a replicate, at most sample_size, come together for what is computed of it.
    """
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    sizes = rows.groupBy(group).agg(F.max("n").alias("n"))
    reps = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).select(F.col(group).alias("__g"), "replicate", F.col("n").alias("__n"))
    take = F.least(F.col("__n"), F.lit(sample_size)).cast("int")
    addressed = reps.repartition(tasks, "__g", "replicate").withColumn("i", F.explode(F.sequence(F.lit(0), take - 1)))
    draws = addressed.select("__g", "replicate", F.pmod(draw(F.col("replicate"), F.col("i"), salt), F.col("__n")).alias("__at"))
    # the hint keeps Spark from broadcasting the draws, whose number it can't estimate
    met = draws.join(rows.select(group, "at", value).hint("shuffle_hash"), F.col(group).eqNullSafe(F.col("__g")) & (F.col("at") == F.col("__at")))
    return met.select(F.col("__g").alias(group), "replicate", value).repartition(tasks, group, "replicate")


def fences(q1: Column, q3: Column, cfg: HighOrderConfig, anchored: bool = True) -> tuple[Column, Column]:
    """(upper, lower) from quartiles, anchored at 0, at least min_abs away from it."""
    iqr = q3 - q1
    up, lo = (F.greatest(q3, F.lit(0.0)), F.least(q1, F.lit(0.0))) if anchored else (q3, q1)
    return F.greatest(up + 1.5 * cfg.k_upper * iqr, F.lit(cfg.min_abs)), F.least(lo - 1.5 * cfg.k_lower * iqr, F.lit(-cfg.min_abs))


def plain_fences(df: DataFrame, column: str, k_upper: float, k_lower: float, min_abs: float = 0.15) -> tuple[float, float]:
    q = quartiles(df.filter(finite(column)), column)
    if q is None:
        return min_abs, -min_abs
    iqr = q[1] - q[0]
    return max(q[1] + 1.5 * k_upper * iqr, min_abs), min(q[0] - 1.5 * k_lower * iqr, -min_abs)


def bootstrap_fences(df: DataFrame, group: str, cfg: HighOrderConfig, column: str = "diff") -> DataFrame:
    """(group, replicate, upper, lower): IQR fences of each resample."""
    rows = numbered(df.filter(finite(column) & F.col(group).isNotNull()).select(group, "locus1", "locus2", column), group, ["locus1", "locus2", column])
    drawn = resample(rows, group, column, cfg.bootstrap, cfg.sample_size)
    q = drawn.groupBy(group, "replicate").agg(F.percentile(F.col(column), F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    up, lo = fences(F.col("q")[0], F.col("q")[1], cfg)
    return q.select(group, "replicate", up.alias("upper"), lo.alias("lower"))


def bootstrap_tails(df: DataFrame, group: str, cfg: HighOrderConfig, column: str = "diff") -> DataFrame:
    """(group, replicate, upper, lower): quantile of the resampled positive and of the resampled negative differences.

    A tail of fewer than min_tail rows gives null; a group with two such tails has no row.
    """
    def tail(rows: DataFrame, q: float, name: str, salt: str) -> DataFrame:
        n = numbered(rows.filter(F.col(group).isNotNull()).select(group, "locus1", "locus2", column), group, ["locus1", "locus2", column])
        drawn = resample(n.filter(F.col("n") >= cfg.min_tail), group, column, cfg.bootstrap, cfg.sample_size, salt)
        return drawn.groupBy(group, "replicate").agg(F.percentile(F.col(column), F.lit(q)).alias(name))

    ok = df.filter(finite(column))
    up, lo = tail(ok.filter(F.col(column) > 0), cfg.upper_q, "upper", "p"), tail(ok.filter(F.col(column) < 0), cfg.lower_q, "lower", "n")
    return up.join(lo, [group, "replicate"], "full")


def stable(boot: DataFrame, group: str, cfg: HighOrderConfig) -> DataFrame:
    """(group, upper, lower, uppers, lowers): the stable thresholds and the sorted replicates, one row per group."""
    return boot.groupBy(group).agg(
        F.percentile("upper", F.lit(cfg.min_stability)).alias("stable_upper"), F.percentile("lower", F.lit(round(1 - cfg.min_stability, 12))).alias("stable_lower"),
        F.percentile("upper", F.array(F.lit(0.025), F.lit(0.975))).alias("upper_ci"), F.percentile("lower", F.array(F.lit(0.025), F.lit(0.975))).alias("lower_ci"),
        F.array_sort(F.collect_list("upper")).alias("uppers"), F.array_sort(F.collect_list("lower")).alias("lowers"),
    )


def annotate_stability(df: DataFrame, thresholds: DataFrame, group: str, cfg: HighOrderConfig, inclusive: bool, column: str = "diff") -> DataFrame:
    """Adds upper_stability, lower_stability, stability and direction. thresholds has a row per group."""
    t = thresholds.select(F.col(group).alias("__g"), "stable_upper", "stable_lower", "uppers", "lowers")
    d = F.col(column)
    ok = finite(column)
    up = F.when(ok, F.size(F.filter("uppers", lambda x: x < d)) / F.size("uppers")).otherwise(0.0)
    lo = F.when(ok, F.size(F.filter("lowers", lambda x: x > d)) / F.size("lowers")).otherwise(0.0)
    j = df.join(t, F.col(group) == F.col("__g")).withColumns({"upper_stability": up, "lower_stability": lo}).withColumn("stability", F.greatest("upper_stability", "lower_stability"))
    s = F.lit(cfg.min_stability)
    if inclusive:
        strong, weak = d >= F.col("stable_upper"), d <= F.col("stable_lower")
    else:
        strong, weak = d > F.col("stable_upper"), d < F.col("stable_lower")
    way = F.when(ok & strong & (F.col("upper_stability") >= s), "strengthened").when(ok & weak & (F.col("lower_stability") >= s), "weakened").otherwise("not_selected")
    return j.withColumn("direction", way).drop("__g", "uppers", "lowers")


def histogram(df: DataFrame, group: str, column: str = "diff", bins: int = 128) -> DataFrame:
    """(group, bin, n): fixed-width bins over [min(-1, least), max(1, largest)], the last one closed; empty bins are 0."""
    ok = df.filter(finite(column) & F.col(group).isNotNull()).select(group, column)
    ends = ok.groupBy(group).agg(F.least(F.lit(-1.0), F.min(column)).alias("lo"), F.greatest(F.lit(1.0), F.max(column)).alias("hi"))
    e = ends.withColumnRenamed(group, "__g")
    b = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))).cast("int")
    counts = ok.join(e, F.col(group) == F.col("__g")).groupBy(group, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    return frame.join(counts, [group, "bin"], "left").select(group, "bin", centre.alias("centre"), F.coalesce("n", F.lit(0)).alias("n"))


def smoothed(hist: DataFrame, group: str, bins: int = 128, sigma: float = 2.0) -> DataFrame:
    """(group, bin, centre, n, height): Gaussian smoothing over 4 sigma with repeated edge bins."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    taps = F.array(*[F.struct(F.lit(k - radius).alias("k"), F.lit(w / sum(raw)).alias("w")) for k, w in enumerate(raw)])
    spread = hist.select(F.col(group), "bin", "centre", "n").withColumn("t", F.explode(taps))
    source = spread.select(group, "bin", "centre", "n", F.least(F.greatest(F.col("bin") + F.col("t.k"), F.lit(0)), F.lit(bins - 1)).alias("at"), F.col("t.w").alias("w"))
    other = hist.select(F.col(group).alias("__g"), F.col("bin").alias("__b"), F.col("n").alias("m"))
    return source.join(other, (F.col(group) == F.col("__g")) & (F.col("at") == F.col("__b"))).groupBy(group, "bin", "centre", "n").agg(F.sum(F.col("m") * F.col("w")).alias("height"))


def bimodality(df: DataFrame, group: str, column: str = "diff", bins: int = 128, min_mode: float = 0.15, min_fraction: float = 0.05, min_gap: float = 0.30, max_valley: float = 0.50) -> DataFrame:
    """One row per group with both modes, the valley between them and whether the six conditions of two signed modes hold. Uses all rows."""
    s = smoothed(histogram(df, group, column, bins), group, bins)
    side = lambda cond: F.max_by(F.struct("centre", "height", "bin"), F.when(cond, F.struct("height", -F.col("bin"))))
    modes = s.groupBy(group).agg(side(F.col("centre") < 0).alias("l"), side(F.col("centre") > 0).alias("r"))
    j = s.join(modes.withColumnRenamed(group, "__g"), F.col(group) == F.col("__g"))
    valley = j.filter(F.col("bin").between(F.col("l.bin"), F.col("r.bin"))).groupBy(group).agg(F.min("height").alias("valley"), F.first("l").alias("l"), F.first("r").alias("r"))
    sides = df.filter(finite(column)).groupBy(group).agg(F.avg((F.col(column) < 0).cast("double")).alias("negative"), F.avg((F.col(column) > 0).cast("double")).alias("positive"))
    peak = F.least("l.height", "r.height")
    out = valley.join(sides, group).select(
        group, F.col("l.centre").alias("left_mode"), F.col("r.centre").alias("right_mode"), "valley", F.when(peak > 0, F.col("valley") / peak).otherwise(float("inf")).alias("valley_ratio"), "negative", "positive"
    )
    both = (F.col("negative") >= min_fraction) & (F.col("positive") >= min_fraction) & (F.col("left_mode") <= -min_mode) & (F.col("right_mode") >= min_mode)
    return out.withColumn("bimodal", both & (F.col("right_mode") - F.col("left_mode") >= min_gap) & (F.col("valley_ratio") <= max_valley))


def combine(iqr: DataFrame, tails: DataFrame, ends: DataFrame, group: str) -> DataFrame:
    """Per group and tail the stricter of the IQR and the quantile threshold. An IQR fence out of reach stays, and its tail is empty.
    Without a quantile threshold, for the tail is short, the IQR one stays, marked short_tail.

    iqr and tails have stable_upper, stable_lower, uppers, lowers; ends has least and most. All have a row per group.
    """
    a = iqr.select(group, *[F.col(c).alias(f"i_{c}") for c in ("stable_upper", "stable_lower", "uppers", "lowers")])
    b = tails.select(group, *[F.col(c).alias(f"q_{c}") for c in ("stable_upper", "stable_lower", "uppers", "lowers")])
    j = a.join(b, group, "left").join(ends, group)
    ok_up = (F.col("i_stable_upper") <= F.col("most")) & (F.col("i_stable_upper") <= 1)
    ok_lo = (F.col("i_stable_lower") >= F.col("least")) & (F.col("i_stable_lower") >= -1)
    up_q, lo_q = ok_up & (F.col("q_stable_upper") > F.col("i_stable_upper")), ok_lo & (F.col("q_stable_lower") < F.col("i_stable_lower"))
    pick = lambda c, q: F.when(F.coalesce(q, F.lit(False)), F.col(f"q_{c}")).otherwise(F.col(f"i_{c}")).alias(c)
    name = lambda ok, q: F.when(~ok, "iqr_bootstrap_out_of_range_empty").when(q.isNull(), "iqr_bootstrap_short_tail").when(q, "quantile_bootstrap").otherwise("iqr_bootstrap")
    return j.select(group, pick("stable_upper", up_q), pick("stable_lower", lo_q), pick("uppers", up_q), pick("lowers", lo_q), name(ok_up, up_q).alias("upper_source"), name(ok_lo, lo_q).alias("lower_source"))


def require_tails(df: DataFrame, group: str, cfg: HighOrderConfig, column: str = "diff") -> None:
    """An error if a group, a chromosome, has fewer than min_tail positive or negative differences."""
    side = lambda c: F.count(F.when(finite(column) & c, 1))
    sizes = df.filter(F.col(group).isNotNull()).groupBy(group).agg(side(F.col(column) > 0).alias("up"), side(F.col(column) < 0).alias("lo"))
    if short := [tuple(r) for r in sizes.filter(F.least("up", "lo") < cfg.min_tail).collect()]:
        raise ValueError(f"a tail has fewer than {cfg.min_tail} pairs (group, positive, negative): {short}")


def extremes(df: DataFrame, group: str, column: str = "diff") -> DataFrame:
    return df.filter(finite(column) & F.col(group).isNotNull()).groupBy(group).agg(F.min(column).alias("least"), F.max(column).alias("most"), F.count(F.lit(1)).alias("n"))


@dataclass
class Selection:
    rows: DataFrame
    thresholds: DataFrame


def select_auto(df: DataFrame, group: str, cfg: HighOrderConfig) -> Selection:
    """Per chromosome the combined thresholds where the differences are bimodal, else the IQR bootstrap; by method iqr or quantile that one.

    A short tail where quantile thresholds are needed is an error.
    """
    if cfg.method == "quantile":
        require_tails(df, group, cfg)
        t = stable(bootstrap_tails(df, group, cfg), group, cfg).withColumn("threshold_method", F.lit("quantile_bootstrap"))
        return Selection(annotate_stability(df, t, group, cfg, inclusive=True), t)
    require_spread(df, group)
    iqr = stable(bootstrap_fences(df, group, cfg), group, cfg)
    ends = extremes(df, group)
    if few := [r[0] for r in ends.filter(F.col("n") < cfg.min_rows).select(group).collect()]:
        raise ValueError(f"fewer than {cfg.min_rows} finite differences: {few}")
    if cfg.method == "iqr":
        t = iqr.withColumn("threshold_method", F.lit("iqr_bootstrap"))
        return Selection(annotate_stability(df, t, group, cfg, inclusive=False), t)
    two = [r[0] for r in bimodality(df, group, bins=cfg.bins, min_mode=cfg.min_abs).filter("bimodal").select(group).collect()]  # a row per chromosome
    one = iqr.filter(~F.col(group).isin(two)) if two else iqr
    j = one.join(ends, group)
    out = (F.col("stable_upper") > F.least("most", F.lit(1.0))) | (F.col("stable_lower") < F.greatest("least", F.lit(-1.0)))
    cols = [group, "stable_upper", "stable_lower", "uppers", "lowers"]
    t1 = j.select(*cols, F.when(out, "iqr_bootstrap_out_of_range_empty").otherwise("iqr_bootstrap").alias("threshold_method"))
    rows = annotate_stability(df.filter(~F.col(group).isin(two)) if two else df, t1, group, cfg, inclusive=False)
    t = t1
    if two:
        require_tails(df.filter(F.col(group).isin(two)), group, cfg)
        both = combine(iqr.filter(F.col(group).isin(two)), stable(bootstrap_tails(df.filter(F.col(group).isin(two)), group, cfg), group, cfg), ends, group)
        t2 = both.select(*cols, F.lit("directional_combination").alias("threshold_method"))
        rows = rows.unionByName(annotate_stability(df.filter(F.col(group).isin(two)), t2, group, cfg, inclusive=True))
        t = t1.unionByName(t2)
    return Selection(rows, t)


def require_spread(df: DataFrame, group: str, column: str = "diff") -> None:
    """An error if the middle half of a group's differences, a chromosome's, is one value: its fences would mean nothing."""
    rows = df.filter(finite(column) & F.col(group).isNotNull()).select(group, column)
    at = positions(rows, [group], [column], "__at", "__n")
    inner = at.filter((F.col("__at") >= F.floor(0.25 * (F.col("__n") - 1))) & (F.col("__at") <= F.ceil(0.75 * (F.col("__n") - 1)))).groupBy(group).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    if flat := [r[0] for r in inner.filter("lo = hi").select(group).limit(10).collect()]:
        raise ValueError(f"no spread of the differences: {flat}")


def changes(df: DataFrame, outlier: str = "iqr", k: float = 2, margin: float = 0.1, fixed: tuple[float, float] | None = None) -> tuple[DataFrame, tuple[float, float]]:
    """(rows with diff and direction, (upper, lower)) from v_h and v_f: fixed thresholds, fences of k times 1.5 IQR, or around the density's peak.

    direction is strengthened above upper, weakened below lower, else null; a threshold that isn't finite selects nothing.
    """
    num = lambda c: F.expr(f"try_cast({c} as double)")
    rows = Scratch(df.sparkSession, "changes").save(df.withColumn("diff", num("v_h") - num("v_f")), "rows")
    up, lo = fixed if fixed is not None else kde_difference(rows, margin=margin) if outlier == "kde" else plain_fences(rows, "diff", k, k, 0.0)
    way = F.when(finite("diff") & F.lit(math.isfinite(up)) & (F.col("diff") > up), "strengthened").when(finite("diff") & F.lit(math.isfinite(lo)) & (F.col("diff") < lo), "weakened")
    return rows.withColumn("direction", way), (float(up), float(lo))


def kde_difference(df: DataFrame, column: str = "diff", margin: float = 0.15, two_sided: bool = False) -> tuple[float, float]:
    """(upper, lower) around density peaks: margin is 1.5 IQR kept within [margin, 0.55]; two_sided takes a peak on either side of the median."""
    def width(x: DataFrame) -> float:
        q = quartiles(x, column)
        return margin if q is None else min(max(1.5 * (q[1] - q[0]), margin), 0.55)

    ok = df.filter(finite(column))
    peak = kde_peak(ok, column, 0.3)
    if peak is None:
        q = quartiles(ok, column)
        both = (0.0, 0.0) if q is None else (q[1] + 4.5 * (q[1] - q[0]), q[0] - 4.5 * (q[1] - q[0]))
    else:
        both = (peak + width(ok), peak - width(ok))
    if not two_sided:
        return both
    cut = max(0.0, (quantiles(ok, column, [0.5]) or [0.0])[0])
    high, low = ok.filter(F.col(column) > cut), ok.filter(F.col(column) <= cut)
    up, lo = kde_peak(high, column, 0.3), kde_peak(low, column, 0.3)
    return (both[0] if up is None else up + width(high)), (both[1] if lo is None else lo - width(low))
