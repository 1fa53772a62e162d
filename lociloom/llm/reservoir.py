"""A uniform sample of fixed, possibly huge size from batches of unknown number and size.

When a batch of b rows arrives after n rows, the number of its rows in the new sample is hypergeometric: k draws from n old and b new
rows. The number is split over hash-partitioned slots; as many of the sample's rows are evicted uniformly, again split over slots, and
the batch's chosen rows take their place. All draws are exact at any size and need only row counts per batch and slot: the driver holds a count
per slot of each waiting batch, 8 bytes each.

`sample_batches` draws the counts of all batches that wait, in their order, and then goes back from the last one: the rows of a slot that
survive to the end are a uniform choice of those before, so a hypergeometric draw tells how many came with each batch. The surviving rows are
then chosen in one pass, and rows that a later batch evicts are never moved. `Reservoir` keeps the sample itself over calls of a stream.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociloom.llm.picking import pick
from lociloom.scratch import Scratch

NUMPY_LIMIT = 10**9  # rows up to which NumPy's generator draws
BROADCAST_CELLS = 200_000  # rows of (batch, slot) that are broadcast; more are joined by shuffle


def by_inversion(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among draws without replacement, by inversion: probabilities relative to the mode come from their exact ratios.

    They are summed over 12 standard deviations and 60 values to either side, beyond which less than 1e-18 lies.
    """
    n, low, high = good + bad, max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (n + 2), low), high)
    p = good / n
    width = int(12 * (draws * p * (1 - p) * (n - draws) / max(n - 1, 1)) ** 0.5) + 60
    up = np.arange(mode, min(high, mode + width), dtype=np.float64)
    down = np.arange(mode, max(low, mode - width), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (draws - up) / ((up + 1) * (up + 1 + (bad - draws))))
    below = np.cumprod(down * (down + (bad - draws)) / ((good - down + 1) * (draws - down + 1)))
    weights = np.concatenate([below[::-1], [1.0], above])
    total = np.cumsum(weights)
    return mode - len(below) + int(np.searchsorted(total, rng.random() * total[-1], side="right").clip(0, len(weights) - 1))


def hypergeometric(rng: np.random.Generator, good, bad, draws) -> np.ndarray:
    """Elementwise; NumPy's draws where its range allows, inversion beyond. Both are exact to rounding."""
    good, bad, draws = np.broadcast_arrays(*(np.asarray(x, dtype=np.int64) for x in (good, bad, draws)))
    small = good + bad < NUMPY_LIMIT
    out = np.zeros(good.shape, dtype=np.int64)
    out[small] = rng.hypergeometric(good[small], bad[small], draws[small])
    for i in zip(*np.nonzero(~small)):
        out[i] = by_inversion(rng, int(good[i]), int(bad[i]), int(draws[i]))
    return out


def split(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """How many of `draws` rows drawn without replacement come from each cell: the number is halved over a tree of the cells."""
    levels = [np.asarray(counts, dtype=np.int64)]
    while len(levels[-1]) > 1:
        c = levels[-1]
        c = np.append(c, 0) if len(c) % 2 else c
        levels[-1] = c
        levels.append(c[0::2] + c[1::2])
    got = np.array([draws], dtype=np.int64)
    for c in reversed(levels[:-1]):
        left = hypergeometric(rng, c[0::2], c[1::2], got[: len(c) // 2])
        got = np.stack([left, got[: len(c) // 2] - left], axis=1).reshape(-1)
    return got[: len(counts)]


@dataclass
class Draws:
    """Counts of the sample per slot; the rows themselves stay in Spark."""

    k: int
    slots: int
    seed: int = 0
    seen: int = 0
    size: np.ndarray | None = None

    def arrive(self, per_slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One batch with this many rows per slot: how many of the sample's rows stay, and how many of the batch's come in, per slot."""
        rng = np.random.default_rng([self.seed, self.seen % 2**32, self.seen >> 32])
        held = np.zeros(self.slots, dtype=np.int64) if self.size is None else self.size
        b = int(per_slot.sum())
        wanted = min(self.k, self.seen + b)
        new = b if self.seen + b <= self.k else int(hypergeometric(rng, [b], [self.seen], [wanted])[0])
        kept = held - split(rng, held, int(held.sum()) - (wanted - new))
        came = split(rng, per_slot, new)
        self.size, self.seen = kept + came, self.seen + b
        return kept, came


def survivors(batches: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Rows of each batch and slot in the sample after all batches (batches x slots row counts) have arrived in order."""
    draws = Draws(k, batches.shape[1], seed)
    steps = [draws.arrive(b) for b in batches]
    out = np.zeros_like(batches)
    left = draws.size if draws.size is not None else np.zeros(batches.shape[1], dtype=np.int64)
    rng = np.random.default_rng([seed, 1, 2, 3])
    for i in range(len(steps) - 1, -1, -1):
        kept, came = steps[i]
        out[i] = hypergeometric(rng, came, kept, left)
        left = left - out[i]
    return out


def _slot(df: DataFrame, slots: int) -> F.Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(slots)).cast("int")


def sample_batches(df: DataFrame, batch: str, k: int, scratch: Scratch, seed: int = 0, slots: int = 64) -> DataFrame:
    """k rows of df (all, if there are fewer), every row equally likely; batches arrive in the order of `batch`, null first.

    All columns are kept under their names; equal rows are rows of their own; an empty table gives an empty sample.
    """
    if k < 1 or slots < 1:
        raise ValueError("k and slots must be positive")
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{batch}`").cast("string").alias("b"), _slot(df, slots).alias("s"))
    per_slot = packed.groupBy("b", "s").agg(F.count(F.lit(1)).alias("n"), F.first(F.col(f"row.`{batch}`")).alias("at"))
    cells = per_slot.groupBy("b").agg(F.first("at").alias("at"), F.collect_list("s").alias("s"), F.collect_list("n").alias("n"))  # lists as long as there are slots
    cells = cells.orderBy(F.col("at").asc_nulls_first()).select("b", "s", "n").toPandas()
    counts = np.zeros((len(cells), slots), dtype=np.int64)
    for i, (s, n) in enumerate(zip(cells.s, cells.n)):
        counts[i, np.asarray(s, dtype=np.int64)] = n
    quota = survivors(counts, k, seed)
    i, s = np.nonzero(quota)
    plan = pd.DataFrame({"b": cells.b.to_numpy()[i], "s": s.astype(np.int32), "quota": quota[i, s], "total": counts[i, s]})
    key = F.coalesce(F.concat(F.lit("b"), "b"), F.lit(""))
    wanted = df.sparkSession.createDataFrame(plan, "b string, s int, quota long, total long").withColumn("b", key)
    sent = F.broadcast(wanted) if len(plan) <= BROADCAST_CELLS else wanted
    rows = packed.withColumn("b", key).withColumn("u", F.rand(seed)).join(sent, ["b", "s"])
    return pick(rows, wanted, ["b", "s"], "quota", "total", "u", scratch).select("row.*")


class Reservoir:
    """The same sample kept over calls, for instance from foreachBatch of a stream; the sample is a table in the shared folder."""

    def __init__(self, k: int, scratch: Scratch, seed: int = 0, slots: int = 64) -> None:
        self.draws, self.scratch, self.seed, self.sample, self.calls = Draws(k, slots, seed), scratch, seed, None, 0

    def update(self, df: DataFrame) -> None:
        """One arriving batch. Evicts from the sample and inserts from the batch; a batch without rows changes nothing."""
        slots = self.draws.slots
        packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _slot(df, slots).alias("s"))
        per = np.zeros(slots, dtype=np.int64)
        for r in packed.groupBy("s").count().collect():  # one row per slot
            per[r["s"]] = r["count"]
        if self.sample is not None and not per.any():
            return
        self.calls += 1
        before = self.draws.size if self.draws.size is not None else np.zeros(slots, dtype=np.int64)
        kept, came = self.draws.arrive(per)
        plan = [(new, s, int(q), int(n)) for new, quota, total in ((False, kept, before), (True, came, per)) for s, (q, n) in enumerate(zip(quota, total))]
        wanted = df.sparkSession.createDataFrame(plan, "new boolean, s int, quota long, total long")
        rows = packed.withColumn("new", F.lit(True))
        if self.sample is not None:
            rows = self.sample.withColumn("new", F.lit(False)).unionByName(rows)
        keyed = rows.withColumn("u", F.rand(self.seed + self.calls)).join(F.broadcast(wanted), ["new", "s"])  # two rows per slot
        step = Scratch(df.sparkSession, "step")
        new = self.scratch.save(pick(keyed, wanted, ["new", "s"], "quota", "total", "u", step).select("row", "s"), "sample")
        step.clear()
        if self.sample is not None:
            self.scratch.drop(self.sample)
        self.sample = new

    def result(self) -> DataFrame:
        """The sample's rows; update() must have been called."""
        return self.sample.select("row.*")
