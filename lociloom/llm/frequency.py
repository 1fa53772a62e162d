"""How often each value, or each n-gram of values, occurs and in how many records, by suffix sorting.

Every position of a record gives a suffix cut at `max_len` terms. Equal suffixes of one record are counted before the shuffle,
suffixes are routed by their first term and sorted in reverse lexicographic order, so that a suffix comes before its own prefixes.
One pass then keeps a stack with the counts and record sets of the prefixes that are still open; a prefix is complete when a suffix
without it arrives. The stack works on whole Arrow batches: per depth, runs of equal prefixes are summed at once, and only the
open run at the end of a batch is carried over.

A first term with more than ROWS_PER_TASK counted suffixes is split by record into as many parts as its count asks for, so that no task
has much more, however large a term is. A record's suffixes stay together, so counts and record counts of the parts add up, and the record set of an open prefix
is no larger than its part. Only terms above 1/HOT_TERMS of the suffixes are told apart from the others, at most HOT_TERMS by counting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociloom.scratch import Scratch

ROWS_PER_TASK = 2**18
HOT_TERMS = 20_000


class Records:
    """Distinct records of an open prefix. New ones wait until they outnumber the known ones, so that a record is sorted a few times only."""

    def __init__(self, first: np.ndarray) -> None:
        self.known, self.waiting, self.n = first, [], 0

    def add(self, more: np.ndarray) -> None:
        self.waiting.append(more)
        self.n += len(more)
        if self.n > len(self.known):
            self._settle()

    def _settle(self) -> None:
        self.known, self.waiting, self.n = np.unique(np.concatenate([self.known, *self.waiting])), [], 0

    def size(self) -> int:
        if self.waiting:
            self._settle()
        return len(self.known)


def _stack(batches: Iterator[pa.RecordBatch], depth: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    last: tuple | None = None  # terms and length of the last row so far
    open_n = [0] * (depth + 1)
    open_rec: list[Records | None] = [None] * (depth + 1)  # None: no prefix of this depth is open

    def close(d: int, out: list) -> None:
        if open_rec[d] is not None:
            out.append((d, [last[0][j] for j in range(d)], open_n[d], open_rec[d].size()))
            open_rec[d], open_n[d] = None, 0

    for b in batches:
        k = b.num_rows
        if not k:
            continue
        terms = [b.column(j).to_numpy(zero_copy_only=False) for j in range(depth)]
        size, rec, n = (b.column(depth + j).to_numpy(zero_copy_only=False) for j in range(3))
        single: list = []
        blocks: list[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]] = []
        same = np.ones(k, dtype=bool)
        for d in range(1, depth + 1):
            t = terms[d - 1]
            ok = size >= d
            eq = np.zeros(k, dtype=bool)
            eq[1:] = (t[1:] == t[:-1]) & ok[1:] & ok[:-1]
            eq[0] = bool(last is not None and last[1] >= d and ok[0] and last[0][d - 1] == t[0])
            same = same & eq
            at = np.flatnonzero(ok)
            if not len(at) or not same[at[0]] or at[0] > 0:
                close(d, single)
            if not len(at):
                continue
            starts = ~same[at]
            starts[0] = True
            seg = np.cumsum(starts) - 1
            first = np.flatnonzero(starts)
            count = np.add.reduceat(n[at], first)
            names, code = np.unique(rec[at], return_inverse=True)
            pairs = np.unique(seg.astype(np.int64) * len(names) + code)
            per = np.bincount(pairs // len(names), minlength=len(first)).astype(np.int64)
            of_run = lambda r: names[pairs[pairs // len(names) == r] % len(names)]  # noqa: B023, E731
            stays_open = at[-1] == k - 1
            done = len(first) - 1 if stays_open else len(first)
            goes_on = open_rec[d] is not None  # the first run began in a batch before
            if goes_on:
                open_rec[d].add(of_run(0))
                count[0] += open_n[d]
                open_n[d] = int(count[0])
                if done:
                    per[0] = open_rec[d].size()
                    open_rec[d], open_n[d] = None, 0
            if stays_open and not (goes_on and done == 0):
                open_rec[d], open_n[d] = Records(of_run(done)), int(count[done])
            blocks.append((d, [x[at][first][:done] for x in terms[:d]], count[:done], per[:done]))
        yield from _emit(blocks, single, depth, schema)
        last = ([x[k - 1] for x in terms], int(size[k - 1]))
    single = []
    for d in range(1, depth + 1):
        close(d, single)
    yield from _emit([], single, depth, schema)


def _emit(blocks: list, single: list, depth: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for d, terms, count, per in blocks:
        if len(count):
            cols = [pa.array(t, schema.field(j).type) for j, t in enumerate(terms)] + [pa.nulls(len(count), schema.field(j).type) for j in range(d, depth)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(count), d), pa.int32()), pa.array(count, pa.int64()), pa.array(per, pa.int64())], schema=schema)
    for d, terms, n, r in single:
        cols = [pa.array([t], schema.field(j).type) for j, t in enumerate(terms)] + [pa.nulls(1, schema.field(j).type) for j in range(d, depth)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([r], pa.int64())], schema=schema)


def prefix_counts(suffixes: DataFrame, record: str, terms: list[str], scratch: Scratch) -> DataFrame:
    """(terms..., n_terms, n_occurrences, n_records) of every prefix of the suffixes.

    `suffixes` has a row per position: the record (bigint or string) and the suffix's terms, null beyond its end. Terms are bigint or
    string. Rows without a first term or without a record are ignored. Repeated rows are further occurrences in the same record.
    """
    depth = len(terms)
    ts = [f"t{j}" for j in range(depth)]
    slim = suffixes.select(*[F.col(c).alias(t) for c, t in zip(terms, ts)], F.col(record).alias("rec")).filter(F.col("t0").isNotNull() & F.col("rec").isNotNull())
    counted, seen = scratch.save_counting(slim.groupBy(*ts, "rec").agg(F.count(F.lit(1)).alias("n")), "suffixes", F.count(F.lit(1)).alias("rows"))
    cut = max(ROWS_PER_TASK, seen["rows"] // HOT_TERMS)
    large, found = scratch.save_counting(counted.groupBy(F.col("t0").alias("hot")).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > cut), "hot", F.count(F.lit(1)).alias("n"))
    hot = found["n"] > 0
    salt = F.lit(0)
    tagged = counted
    if hot:
        parts_of = F.broadcast(large.select("hot", F.ceil(F.col("c") / ROWS_PER_TASK).alias("parts")))  # at most HOT_TERMS rows
        tagged = counted.join(parts_of, F.col("t0") == F.col("hot"), "left").drop("hot")
        salt = F.coalesce(F.pmod(F.xxhash64("rec"), F.col("parts")), F.lit(0))
    routed = tagged.withColumn("salt", salt.cast("int")).repartition("t0", "salt")
    ordered = routed.sortWithinPartitions("salt", *[F.col(t).desc_nulls_last() for t in ts])
    kinds = {f.name: f.dataType for f in counted.schema}
    zero = {t: F.lit("") if isinstance(kinds[t], T.StringType) else F.lit(0).cast(kinds[t]) for t in ts}
    length = sum((F.col(t).isNotNull().cast("int") for t in ts[1:]), F.lit(1))
    # a salt in the first place keeps parts of hot terms apart: the pass sees (salt, term) as its first term
    flat = ordered.select(*[F.coalesce(t, zero[t]).alias(t) for t in ts], length.cast("int").alias("size"), "rec", "n", "salt")
    out_schema = T.StructType([T.StructField(t, kinds[t]) for t in ts] + [T.StructField("n_terms", T.IntegerType()), T.StructField("n_occurrences", T.LongType()), T.StructField("n_records", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_arrow = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}
        schema = pa.schema([pa.field(t, to_arrow[kinds[t]]) for t in ts] + [pa.field("n_terms", pa.int32()), pa.field("n_occurrences", pa.int64()), pa.field("n_records", pa.int64())])
        yield from _by_salt(batches, depth, schema)

    parts = flat.mapInArrow(run, out_schema)
    if hot:
        parts = parts.groupBy(*ts, "n_terms").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))
    return parts.select(*[F.col(t).alias(c) for t, c in zip(ts, terms)], "n_terms", "n_occurrences", "n_records")


def _by_salt(batches: Iterator[pa.RecordBatch], depth: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Runs one stack per run of equal salts; rows are sorted by salt first."""
    pending: list[pa.RecordBatch] = []
    rest = iter(batches)

    def run_of(value: int) -> Iterator[pa.RecordBatch]:
        while True:
            if not pending:
                b = next(rest, None)
                if b is None:
                    return
                pending.append(b)
            b = pending.pop()
            if not b.num_rows:
                continue
            s = b.column(depth + 3).to_numpy(zero_copy_only=False)
            end = int(np.searchsorted(s, value, side="right"))
            if end:
                yield b.slice(0, end)
            if end < b.num_rows:
                pending.append(b.slice(end))
                return

    while True:
        if not pending:
            b = next(rest, None)
            if b is None:
                return
            if not b.num_rows:
                continue
            pending.append(b)
        yield from _stack(run_of(pending[-1].column(depth + 3)[0].as_py()), depth, schema)


def mark(records: F.Column, total: F.Column, rare_below: int = 5, common_above: float = 0.95) -> F.Column:
    """'rare' for fewer than rare_below records, 'common' for more than the given share of all records, else null."""
    return F.when(records < rare_below, "rare").when(records > total * F.lit(common_above), "common")
