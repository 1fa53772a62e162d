"""Comparison of a subgroup with the whole data, selected in the tiles that score both sides: no pair is stored but those selected."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lociloom.config import HighOrderConfig
from lociloom.functions.distance import highorder_classes, pair_distances, with_places
from lociloom.functions.score import CLIP
from lociloom.operators.matrix import marginals
from lociloom.operators.pairs import Block, candidates, exact, on_tiles, packed_rows, sample_row, screen
from lociloom.operators.ranks import positions
from lociloom.plans.states import CHROMS, beyond, fences, hashes, level
from lociloom.plans.vp import Prepared
from lociloom.scratch import Scratch

CELLS = 2048


def selected_in_tiles(full: Prepared, high: Prepared, cfg: HighOrderConfig, scratch: Scratch, places: DataFrame | None = None, tile: int = 1024, clip: float = CLIP) -> tuple[DataFrame, DataFrame]:
    """(pairs with v_f and v_h, thresholds by chromosome) that compare() and its selection by the method iqr give, in three rounds over the tiles.

    Blocks are ranges of the ids, so that a part has some of a locus's pairs in their order. The first round counts them by locus and part, the
    second scores those loci of a part again of which a draw takes a pair, and the third passes on the pairs beyond the thresholds.
    """
    if cfg.method != "iqr":
        raise ValueError("only the method iqr")
    spark = scratch.spark
    side = lambda p, k: marginals(p.binary, p.weights).select("locus", F.col("x").alias(f"x{k}"), F.col("dp").alias(f"dp{k}"))
    mark = lambda p, k: p.representatives.select("locus", F.lit(1).alias(f"rep{k}"))
    used = mark(full, 0).join(mark(high, 1), "locus", "full").join(full.binary.select("locus", "row_pos"), "locus")
    ranked = positions(with_places(used, places).withColumnRenamed("row_pos", "__own"), [], ["locus"], "row_pos")
    own = F.array(F.coalesce("rep0", F.lit(0)).cast("bigint"), F.coalesce("rep1", F.lit(0)).cast("bigint"), F.col("__own"))
    rows = ranked.join(side(full, 0), "locus").join(side(high, 1), "locus").withColumn("more", F.concat(own, F.coalesce("place", F.array().cast("array<bigint>"))))
    packed, seen = scratch.save_counting(packed_rows(rows, ["x0", "x1"], ["dp0", "dp1"], "more"), "packed", F.count(F.lit(1)).alias("n"))
    weights, limits, genome, genes = [sample_row(full.weights), sample_row(high.weights)], (full.threshold, high.threshold), cfg.genome, places is not None

    def compared(a: Block, b: Block, i: slice, j: slice, diagonal: bool, only: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(row, column, v_f, v_h, chromosome, geno_dis, whether the whole data has it, whether the subgroup has it) of a part's pairs, in the order of their ids."""
        one, two = np.array(a.extra[i]), np.array(b.extra[j])
        may = np.zeros((len(one), len(two)), bool)
        for k, t in enumerate(limits):
            reps, others = one[:, k] == 1, two[:, k] == 1
            may |= screen(a, b, k, i, j, t) & reps[:, None] & others[None, :]
        if only is not None:
            may[~np.isin(np.arange(len(one)), only)] = False
        r, c, _ = candidates(a, b, i, j, may, diagonal)
        first = one[r, 2] < two[c, 2]
        v = [exact(a, b, k, i, j, r, c, first, clip) for k in (0, 1)]
        has = [(v[k] >= t) & (one[r, k] == 1) & (two[c, k] == 1) & a.two_states(k)[i][r] & b.two_states(k)[j][c] for k, t in enumerate(limits)]
        p, q = a.locus[i][r], b.locus[j][c]
        d = pair_distances(p, q, *((one[r, 3:], two[c, 3:]) if genes else (None, None)), genome)
        chrom = highorder_classes(p, q, d, genome)
        keep = has[0] | has[1]
        v = [np.nan_to_num(x, nan=0.0) for x in v]
        return tuple(x[keep] for x in (r, c, *v, chrom, d, *has))

    def round_(work: Callable[..., Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        return on_tiles(packed, seen["n"], weights, work, schema, scratch, tile, ranges=True)

    def count(a: Block, b: Block, i: slice, j: slice, diagonal: bool) -> Iterator[pd.DataFrame]:
        r, _, f, h, chrom, _, *has = compared(a, b, i, j, diagonal)
        size = a.locus[i].size
        for k in range(len(CHROMS)):
            mine = chrom == k
            n = np.bincount(r[mine], minlength=size)
            at = np.flatnonzero(n)
            yield pd.DataFrame({"kind": 0, "chrom": k, "rank": a.pos[i][at], "part": b.pos[j][0] // tile, "n": n[at]})
            cells, n = np.unique(np.floor((h - f)[mine] * CELLS).astype(np.int64), return_counts=True)
            yield pd.DataFrame({"kind": 1, "chrom": k, "rank": cells, "part": 0, "n": n})
        yield pd.DataFrame({"kind": 2, "chrom": [0, 1], "rank": 0, "part": 0, "n": [int(x.sum()) for x in has]})

    counts = scratch.save(round_(count, "kind int, chrom int, rank long, part long, n long"), "counts")
    either = {r.chrom: r.n for r in counts.filter("kind = 2").groupBy("chrom").agg(F.sum("n").alias("n")).collect()}
    if not either.get(0) or not either.get(1):
        raise ValueError("no pair reaches the score threshold")
    heads = counts.filter("kind = 0").groupBy("chrom", "rank").agg(F.sum("n").alias("n")).orderBy("chrom", "rank").toPandas()  # two numbers a locus
    by = {k: g for k, g in heads.groupby("chrom")}
    flat = [CHROMS[k] for k in by if not _spread(counts, k, round_, compared)]
    if flat:
        raise ValueError(f"no spread of the differences: {flat}")
    if few := [CHROMS[k] for k, g in by.items() if g.n.sum() < cfg.min_rows]:
        raise ValueError(f"fewer than {cfg.min_rows} finite differences: {few}")

    draws, wanted = {}, []
    for k, g in by.items():
        upto, total = g.n.cumsum().to_numpy(), int(g.n.sum())
        draws[k] = hashes("b", cfg.bootstrap, cfg.sample_size)[:, : min(total, cfg.sample_size)].astype(np.int64) % total
        at = np.unique(draws[k])
        row = np.searchsorted(upto, at, side="right")
        wanted.append(pd.DataFrame({"chrom": k, "rank": g["rank"].to_numpy()[row], "offset": at - upto[row] + g.n.to_numpy()[row], "at": at}))
    w = W.partitionBy("chrom", "rank").orderBy("part")
    parts = counts.filter("kind = 0").withColumn("upto", F.sum("n").over(w)).select("chrom", "rank", "part", "n", "upto")
    hit = spark.createDataFrame(pd.concat(wanted)).join(parts, ["chrom", "rank"]).filter((F.col("offset") < F.col("upto")) & (F.col("offset") >= F.col("upto") - F.col("n")))
    places_of = hit.select("chrom", "rank", "part", (F.col("offset") - F.col("upto") + F.col("n")).alias("offset"), "at").toPandas()  # at most a row a draw
    asked = spark.sparkContext.broadcast({key: g[["chrom", "rank", "offset", "at"]].to_numpy() for key, g in places_of.groupby([places_of["rank"] // tile, "part"])})

    def take(a: Block, b: Block, i: slice, j: slice, diagonal: bool) -> Iterator[pd.DataFrame]:
        mine = asked.value.get((int(a.pos[i][0] // tile), int(b.pos[j][0] // tile)))
        if mine is None:
            return
        r, _, f, h, chrom, *_ = compared(a, b, i, j, diagonal, mine[:, 1] - a.pos[i][0])
        key, diff = chrom.astype(np.int64) * tile + r, h - f
        order = np.argsort(key, kind="stable")  # by chromosome and locus, the other loci staying in order
        start = np.searchsorted(key[order], mine[:, 0] * tile + mine[:, 1] - a.pos[i][0])
        yield pd.DataFrame({"chrom": mine[:, 0], "at": mine[:, 3], "diff": diff[order[start + mine[:, 2]]]})

    taken = round_(take, "chrom int, at long, diff double").toPandas()  # likewise
    chosen = {}
    for k, g in taken.groupby("chrom"):
        g = g.sort_values("at")
        values = np.sort(g["diff"].to_numpy()[np.searchsorted(g["at"].to_numpy(), draws[k])], axis=1)
        q = np.stack([_quantile(values, p) for p in (0.25, 0.75)], axis=1)
        chosen[int(k)] = (*fences(q, cfg), False, level(*fences(q, cfg), cfg))

    def select(a: Block, b: Block, i: slice, j: slice, diagonal: bool) -> Iterator[pd.DataFrame]:
        r, c, f, h, chrom, *_ = compared(a, b, i, j, diagonal)
        keep = np.zeros(len(r), bool)
        for k, limit in chosen.items():
            mine = np.flatnonzero(chrom == k)
            keep[mine] = beyond((h - f)[mine], *limit, cfg)
        yield pd.DataFrame({"locus1": a.locus[i][r[keep]], "locus2": b.locus[j][c[keep]], "v_f": f[keep], "v_h": h[keep]})

    out = scratch.save(round_(select, "locus1 long, locus2 long, v_f double, v_h double"), "chosen")
    return out, spark.createDataFrame([(CHROMS[k], *map(float, c[3])) for k, c in chosen.items()], "chrom string, stable_upper double, stable_lower double")


def _quantile(sorted_: np.ndarray, p: float) -> np.ndarray:
    at = (sorted_.shape[1] - 1) * p
    lo, hi = math.floor(at), math.ceil(at)
    a, b = sorted_[:, lo], sorted_[:, hi]
    return np.where(a == b, a, (hi - at) * a + (at - lo) * b) if lo != hi else a


def _spread(counts: DataFrame, k: int, round_: Callable[..., DataFrame], compared: Callable[..., tuple]) -> bool:
    """Whether the middle half of a chromosome's differences has two values, by ranges, and by values where it lies in one range."""
    def ends(values: np.ndarray, n: np.ndarray) -> tuple:
        upto, total = np.cumsum(n), int(n.sum())
        return tuple(values[np.searchsorted(upto, f(p * (total - 1)), side="right")] for f, p in ((math.floor, 0.25), (math.ceil, 0.75)))

    cells = counts.filter((F.col("kind") == 1) & (F.col("chrom") == k)).groupBy("rank").agg(F.sum("n").alias("n")).orderBy("rank").toPandas()  # 2 * CELLS rows
    lo, hi = ends(cells["rank"].to_numpy(), cells.n.to_numpy())
    if lo != hi:
        return True

    def distinct(a: Block, b: Block, i: slice, j: slice, diagonal: bool) -> Iterator[pd.DataFrame]:
        _, _, f, h, chrom, *_ = compared(a, b, i, j, diagonal)
        values, n = np.unique((h - f)[chrom == k], return_counts=True)
        cell = np.floor(values * CELLS).astype(np.int64)
        yield pd.DataFrame({"x": values[cell == lo], "n": n[cell == lo]})

    here = round_(distinct, "x double, n long").groupBy("x").agg(F.sum("n").alias("n"))
    below, total = int(cells.n[cells["rank"] < lo].sum()), int(cells.n.sum())
    most = here.agg(F.max("n").alias("most"), F.max_by("x", "n").alias("x")).first()
    under = here.filter(F.col("x") < most.x).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + below
    return not (under <= math.floor(0.25 * (total - 1)) and math.ceil(0.75 * (total - 1)) < under + most.most)
