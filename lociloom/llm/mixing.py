"""A mix of sources at target shares of all tokens, every document used at most a given number of times.

Documents are counted by source and exact token length. A source's budget is met by full passes over its documents; the rest is first
spread over the lengths in proportion, so that lengths keep their distribution, and what then remains, less than a window, is fitted
exactly by a bounded-knapsack dynamic program over the lengths that are left (where only longer documents are left, in units first). The planned number of documents of each length is chosen
by a seeded hash of the document's id.

Only the histogram of one source is in one task, at most a row per distinct length; documents are never gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociloom.llm.picking import pick
from lociloom.llm.tokens import VOCABULARY, encode
from lociloom.scratch import Scratch

WINDOW = 32_768  # tokens that the dynamic program fits


def subset(lengths: list[int], counts: list[int], target: int) -> tuple[list[int], int]:
    """How many of each length to take for the largest sum <= target, and that sum; counts are bounded, split into powers of two."""
    reach, mask = 1, (1 << (target + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # reachable sums before, which length, how many of it
    for i, (size, c) in enumerate(zip(lengths, counts)):
        c, k = min(c, target // size if size else 0), 1
        while c > 0 and not reach >> target & 1:
            m = min(k, c)
            steps.append((reach, i, m))
            reach |= (reach << (m * size)) & mask
            c, k = c - m, 2 * k
    best = at = reach.bit_length() - 1
    take = [0] * len(lengths)
    for before, i, m in reversed(steps):
        if not before >> at & 1:
            take[i] += m
            at -= m * lengths[i]
    return take, best


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, repeats: int, seed: int = 0) -> tuple[int, np.ndarray]:
    """(passes, extra): every document is used `passes` times and extra[i] documents of lengths[i] once more; the sum is <= budget."""
    total = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), dtype=np.int64)
    if total <= 0 or budget <= 0 or repeats <= 0:
        return 0, extra
    passes = min(budget // total, repeats)
    rest = budget - passes * total
    if passes == repeats or rest <= 0:
        return passes, extra
    extra = np.array([int(c) * rest // total for c in counts], dtype=np.int64)
    rest -= int((lengths * extra).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    while rest > WINDOW:  # the parts lost by rounding down, one document of each length at a time
        before = rest
        for i in order:
            if extra[i] < counts[i] and rest - lengths[i] >= WINDOW // 2:
                extra[i] += 1
                rest -= int(lengths[i])
        if rest == before:
            break
    while some := [int(i) for i in order if lengths[i] <= rest and extra[i] < counts[i]]:
        unit = -(-rest // WINDOW)  # 1 within the window; above it lengths are first rounded up to units, and the rest is fitted again
        take, _ = subset([-(-int(lengths[i]) // unit) for i in some], [int(counts[i] - extra[i]) for i in some], rest // unit)
        if not any(take):
            take[int(np.argmax(lengths[some]))] = 1
        extra[some] += np.array(take, dtype=np.int64)
        rest -= int((lengths[some] * np.array(take)).sum())
        if unit == 1:
            break
    return passes, extra


class Mix:
    """Documents with (source, text) against targets (source, target_share, max_repeats).

    Names are compared without case and outer spaces; documents with a null or unlisted source take no part. A target with a null or
    non-positive share or repeats counts as one without documents. Shares of sources without tokens go to the others in proportion: the
    budget is the largest total that all sources with tokens can meet. Documents without tokens are never used. No usable source gives
    no documents; the report then has zeros.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, scratch: Scratch, doc_id: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str = VOCABULARY, seed: int = 0) -> None:
        name = lambda c: F.lower(F.trim(F.col(c)))
        goals = targets.filter(F.col("source").isNotNull()).groupBy(name("source").alias("source")).agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
        slim = docs.select(F.col(doc_id).alias("doc_id"), name(source).alias("source"), F.col(text).alias("text")).join(goals.select("source"), "source", "left_semi")
        sized = scratch.save(encode(slim, "text", ["doc_id", "source"], vocabulary, count_only=True).withColumn("uid", F.monotonically_increasing_id()), "sized")
        hist = scratch.save(sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "lengths")
        have = hist.groupBy("source").agg(F.sum("n").alias("n_documents"), F.sum(F.col("n") * F.col("n_tokens")).alias("available_tokens"))
        state = goals.join(have, "source", "left").fillna(0, ["n_documents", "available_tokens"])
        usable = (F.col("available_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
        whole = state.filter(usable).agg(F.sum("target_share").alias("s"), F.min(F.col("available_tokens") * F.col("max_repeats") / F.col("target_share")).alias("t")).first()
        share = F.when(usable, F.col("target_share") / F.lit(whole.s or 1.0)).otherwise(0.0)
        budget = F.least(F.floor(share * F.lit((whole.t or 0.0) * (whole.s or 0.0)) + F.lit(1e-6)), F.col("available_tokens") * F.col("max_repeats"))
        self.state = scratch.save(state.withColumn("budget_tokens", F.when(usable, budget).otherwise(0).cast("bigint")), "budgets")
        work = hist.filter("n_tokens > 0").join(self.state.select("source", "budget_tokens", "max_repeats"), "source")

        def plan_source(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("n_tokens")
            passes, extra = fit(rows.n_tokens.to_numpy(np.int64), rows.n.to_numpy(np.int64), int(rows.budget_tokens.iloc[0]), int(rows.max_repeats.iloc[0]), seed)
            return pd.DataFrame({"source": rows.source, "n_tokens": rows.n_tokens, "n": rows.n, "passes": passes, "extra": extra})

        self.plan = scratch.save(work.groupBy("source").applyInPandas(plan_source, "source string, n_tokens long, n long, passes long, extra long"), "plan")
        self.sized, self.scratch, self.seed = sized, scratch, seed

    def documents(self) -> DataFrame:
        """(doc_id, source, n_tokens, copies) of each document in the mix."""
        rows = self.sized.join(self.plan.hint("merge"), ["source", "n_tokens"])  # a row per distinct length, which no bound limits
        bits = 2.0**53
        u = (F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.lit(int(bits))) + F.lit(0.5)) / F.lit(bits)
        chosen = pick(rows.withColumn("u", u), self.plan, ["source", "n_tokens"], "extra", "n", "u", self.scratch).select("uid", F.lit(1).alias("more"))
        copies = F.col("passes") + F.coalesce("more", F.lit(0))
        return rows.join(chosen, "uid", "left").withColumn("copies", copies.cast("int")).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")

    def report(self) -> DataFrame:
        """Per target source: what it has, its budget, what was used of it and the share reached."""
        used = self.plan.groupBy("source").agg(F.sum(F.col("n_tokens") * (F.col("n") * F.col("passes") + F.col("extra"))).alias("used_tokens"))
        total = self.plan.agg(F.coalesce(F.sum(F.col("n_tokens") * (F.col("n") * F.col("passes") + F.col("extra"))), F.lit(0))).first()[0]
        return self.state.join(used, "source", "left").fillna(0, ["used_tokens"]).withColumn("actual_share", F.col("used_tokens") / F.lit(float(max(total, 1))))
