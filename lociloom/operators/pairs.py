"""Scores of pairs of loci: all pairs in tiles, and selected pairs."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociloom.functions.encode import weighted_ones
from lociloom.functions.score import CLIP, pair_score, scores
from lociloom.operators.matrix import entropy_bound, marginals
from lociloom.scratch import Scratch

PAIRS = "locus1 long, locus2 long, v double"
#: Loci with less than this share of the weight in one state are not screened; pairs scored at once; most tasks of all tiles.
RARE, CHUNK, MOST_TASKS = 1e-4, 4096, 1024
#: Scores of whole counts are looked up for up to so many samples, in a table of 16 MB at most.
LOOKED_UP = 126
#: Rows of a part that are looked up at once, rows of a record batch.
STRIP, BATCH = 32, 65_536


def normalised(pairs: DataFrame) -> DataFrame:
    """Both loci as bigint with locus1 <= locus2, other columns kept."""
    a, b = F.col("locus1").cast("bigint"), F.col("locus2").cast("bigint")
    rest = [c for c in pairs.columns if c not in ("locus1", "locus2")]
    return pairs.select(F.least(a, b).alias("locus1"), F.greatest(a, b).alias("locus2"), *rest)


def packed_rows(binary: DataFrame, xs: Sequence[str] = ("x",), dps: Sequence[str] = ("dp",), extra: str | None = None) -> DataFrame:
    """(locus, row_pos, dp, bits, extra) from rows of marginals(): 0/1 samples as bits, an eighth of a byte each; several sets of samples stand behind each other."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [b"".join(np.packbits(np.asarray(v.values, dtype=np.uint8)).tobytes() for v in row) for row in zip(*(b.column(f"x{k}") for k in range(len(xs))))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("locus", "row_pos", "dp")), pa.array(bits, pa.binary()), b.column("extra")], names=["locus", "row_pos", "dp", "bits", "extra"])

    more = F.col(extra) if extra else F.lit(None).cast("int")
    kind = binary.schema[extra].dataType.simpleString() if extra else "int"
    rows = binary.select("locus", "row_pos", F.array(*[F.col(d).cast("double") for d in dps]).alias("dp"), more.alias("extra"), *[F.col(x).cast("array<tinyint>").alias(f"x{k}") for k, x in enumerate(xs)])
    return rows.mapInArrow(pack, f"locus long, row_pos long, dp array<double>, bits binary, extra {kind}")


class Block:
    """Rows of a tile: loci, positions, and for each side (a set of samples) the weight of ones, the bits, and the rows as unit vectors about their mean."""

    def __init__(self, row: pd.Series, sides: list[np.ndarray]) -> None:
        self.locus, self.pos, self.extra = np.frombuffer(row.locus, np.int64), np.frombuffer(row.row_pos, np.int64), pickle.loads(row.extra)
        self.dp = np.frombuffer(row.dp, np.float64).reshape(len(sides), -1)
        ends = np.cumsum([-(-len(w) // 8) for w in sides])
        self.bits = [np.ascontiguousarray(b) for b in np.split(np.frombuffer(row.bits, np.uint8).reshape(len(self.locus), -1), ends[:-1], axis=1)]
        self.w = sides
        self.unit, self.least, self.entropy, self._words = [], [], [], {}
        for k, w in enumerate(sides):
            total = w.sum()
            share = self.dp[k] / total
            two = (share > 1e-12) & (share < 1 - 1e-12)
            spread = np.sqrt(np.where(two, total * share * (1 - share), np.inf))
            self.unit.append(((self.x(k) - share[:, None]) * (np.sqrt(w) / spread[:, None])).astype(np.float32))
            self.least.append(np.minimum(share, 1 - share))
            p = np.where(two, share, 0.5)
            self.entropy.append(np.where(two, np.sqrt(-(p * np.log2(p) + (1 - p) * np.log2(1 - p))), 0.0))

    def x(self, side: int, part: slice | np.ndarray = slice(None), kind: type = np.float64) -> np.ndarray:
        return np.unpackbits(self.bits[side][part], axis=1)[:, : len(self.w[side])].astype(kind)

    def words(self, side: int) -> np.ndarray:
        """The rows' bits in words of 64, a row of the result for each word."""
        if side not in self._words:
            b = self.bits[side]
            self._words[side] = np.ascontiguousarray(np.pad(b, ((0, 0), (0, -b.shape[1] % 8))).view(np.uint64).T)
        return self._words[side]

    def two_states(self, side: int) -> np.ndarray:
        return (self.dp[side] > 0) & (self.dp[side] < self.w[side].sum())


def screen(a: Block, b: Block, side: int, i: slice, j: slice, threshold: float) -> np.ndarray:
    """Mask of pairs that may reach the threshold, by one product in single precision.

    The score's square is the states' mutual information, at most log2(1 + r^2) with their correlation r and at most either locus's entropy. Loci
    of hardly any weight in one state, for which the score's clip matters, and thresholds near 0 are screened by entropy only.
    """
    one, two = a.entropy[side][i] >= threshold - 1e-6, b.entropy[side][j] >= threshold - 1e-6
    if threshold < 0.02:
        keep = np.ones((len(one), len(two)), bool)
    else:
        r = a.unit[side][i] @ b.unit[side][j].T
        keep = np.abs(r, out=r) >= math.sqrt(2 ** (threshold * threshold) - 1) * 0.99 - 1e-4
        rare_one, rare_two = a.least[side][i] < RARE, b.least[side][j] < RARE
        if (rare_one & one).any() or (rare_two & two).any():
            keep |= rare_one[:, None] | rare_two[None, :]
    if not (one.all() and two.all()):
        keep &= one[:, None] & two[None, :]
    return keep


def exact(a: Block, b: Block, side: int, i: slice, j: slice, r: np.ndarray, c: np.ndarray, first: np.ndarray, clip: float) -> np.ndarray:
    """Scores of the pairs (r, c) of the part, in double precision; the reference is the locus that comes first. NaN where it has one state."""
    w = a.w[side]
    if (w == w[0]).all():
        x, y = a.words(side)[:, i], b.words(side)[:, j]
        joint = lambda k: w[0] * sum(np.bitwise_count(s[r[k]] & t[c[k]]).astype(np.int64) for s, t in zip(x, y))
    else:  # a table of the weight of every value of a byte of samples
        ones = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
        of = (np.pad(w, (0, -len(w) % 8)).reshape(-1, 8) @ ones.T).reshape(-1)
        x, y = a.bits[side][i], b.bits[side][j]
        at = np.arange(x.shape[1]) * 256
        joint = lambda k: of[(x[r[k]] & y[c[k]]) + at].sum(axis=1)
    di, dj, total = a.dp[side][i], b.dp[side][j], float(w.sum())
    out = np.empty(len(r))
    for k in range(0, len(r), CHUNK):  # a chunk stays in the cache
        k = slice(k, k + CHUNK)
        d1, d2 = di[r[k]], dj[c[k]]
        out[k] = scores(joint(k), np.where(first[k], d1, d2), np.where(first[k], d2, d1), total, clip)
    return out


def on_tiles(packed: DataFrame, n: int, weights: list[np.ndarray], work: Callable[[Block, Block, slice, slice, bool], Iterator[pd.DataFrame]], schema: str, scratch: Scratch, tile: int = 1024, places: tuple[int, int] | None = None, ranges: bool = False, least: int = 32, arrow: bool = False) -> DataFrame:
    """Rows of `schema` that `work` yields for parts of `tile` x `tile` rows, so that every pair of rows stands in one part.

    packed(locus, row_pos, dp, bits, extra) has a marginal and bits for each array of weights. Rows are cut into blocks of
    `tile` rows, of up to eight times as many where that leaves `least` blocks, each gathered to one row of bytes (by ranges of dense positions with `ranges`), and a block is sent to every tile
    (bi <= bj) it takes part in: with n loci the shuffle is n * n / block times samples / 8 bytes. What a part gives is passed on before the
    next one is begun. With `ranges`, row positions are dense from 0 and blocks are ranges of them. With `arrow`, `work` yields record batches.
    """
    start, end = places or (0, 2**62)
    block = tile * min(8, max(1, n // tile // least))
    blocks = max(1, -(-n // block))

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_pos")
        mine = pdf.row_pos.between(start, end - 1).any()
        dp = np.stack(pdf.dp.to_numpy())
        row = {"b": [key[0]], "mine": [bool(mine)], "locus": [pdf.locus.to_numpy().tobytes()], "row_pos": [pdf.row_pos.to_numpy().tobytes()]}
        return pd.DataFrame(row | {"dp": [dp.T.tobytes()], "bits": [b"".join(pdf.bits)], "extra": [pickle.dumps(list(pdf.extra))]})

    of = F.floor(F.col("row_pos") / block) if ranges else F.pmod(F.xxhash64("row_pos"), F.lit(blocks))
    by_block = packed.withColumn("b", of.cast("int")).groupBy("b")
    gathered = scratch.save(by_block.applyInPandas(gather, "b int, mine boolean, locus binary, row_pos binary, dp binary, bits binary, extra binary"), "blocks")
    # a tile is keyed by its block pair; a diagonal tile gets its block once
    keys = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(F.col("b"), o).cast("int").alias("bi"), F.greatest(F.col("b"), o).cast("int").alias("bj")))
    sent = gathered.withColumn("t", F.explode(keys)).select("t.bi", "t.bj", *gathered.columns)

    def run(key: tuple, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bi, bj = key
        rows = [r for pdf in pdfs for r in pdf.itertuples()]
        by = {r.b: r for r in rows}
        if bi not in by or bj not in by or not any(r.mine for r in rows):
            return
        a = Block(by[bi], weights)
        b = a if bi == bj else Block(by[bj], weights)
        for i in range(0, len(a.locus), tile):
            for j in range(i if bi == bj else 0, len(b.locus), tile):
                yield from work(a, b, slice(i, i + tile), slice(j, j + tile), bi == bj and i == j)

    def run_arrow(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(tuple(k.as_py() for k in key), (b.to_pandas() for b in batches))

    # a fixed number of tasks, which is not merged by bytes: a tile takes long and is small
    tiles = sent.repartition(min(blocks * (blocks + 1) // 2, MOST_TASKS), "bi", "bj").groupBy("bi", "bj")
    return tiles.applyInArrow(run_arrow, schema) if arrow else tiles.applyInPandas(run, schema)


@lru_cache(maxsize=2)
def _table(n: int) -> np.ndarray:
    """Scores of every joint count and both counts of ones among n samples, 0 where the reference has one state."""
    k = np.arange(n + 1, dtype=np.float64)
    return np.nan_to_num(np.stack([scores(np.full((1, 1), j), k[:, None], k[None, :], float(n)) for j in k]).reshape(-1), nan=0.0)


def looks_up(w: np.ndarray, clip: float) -> bool:
    """Whether scores under these weights stand in a table of whole counts."""
    return clip == CLIP and 0 < len(w) <= LOOKED_UP and bool((w == 1).all())


def looked_up(a: Block, b: Block, side: int, i: slice, j: slice, first: np.ndarray) -> np.ndarray:
    """exact() of all pairs of the part, by one product in single precision, which is exact for counts; 0 where the reference has one state."""
    n = len(a.w[side])
    m = np.float32(n + 1)
    x, y = a.x(side, i, np.float32) * (m * m), np.ascontiguousarray(b.x(side, j, np.float32).T)
    di, dj = a.dp[side][i].astype(np.float32)[:, None], b.dp[side][j].astype(np.float32)[None, :]
    out, table = np.empty((len(x), y.shape[1])), _table(n)
    for k in range(0, len(x), STRIP):  # a strip stays in the cache
        k = slice(k, k + STRIP)
        at = x[k] @ y
        at += np.where(first[k], di[k] * m + dj, di[k] + dj * m)
        np.take(table, at.astype(np.int32).astype(np.int64), out=out[k], mode="clip")
    return out


def rounded(v: np.ndarray, digits: int | None) -> np.ndarray:
    return v if digits is None else np.rint(v * 10.0**digits) / 10.0**digits + 0.0


def record_batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for k in range(0, n, BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + BATCH]) for c in columns.values()], names=list(columns))


def candidates(a: Block, b: Block, i: slice, j: slice, keep: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, c, first): pairs of the mask once each, and whether the row's locus comes first."""
    r, c = np.divmod(np.flatnonzero(keep), keep.shape[1])
    p, q = a.pos[i][r], b.pos[j][c]
    once = p < q if diagonal else p != q
    r, c = r[once], c[once]
    return r, c, p[once] < q[once]


def sample_row(weights: DataFrame) -> np.ndarray:
    w = weights.select("sample_pos", F.col("weight").cast("double").alias("weight")).orderBy("sample_pos").toPandas().weight.to_numpy()  # a weight per sample
    return w.astype(np.float64)


def all_pairs(
    binary: DataFrame, weights: DataFrame, threshold: float = 0.3, tile: int = 1024, clip: float = CLIP, prune: bool = True, places: tuple[int, int] | None = None,
    extra: str | None = None, emit: Callable[..., Iterator[pd.DataFrame]] | None = None, schema: str = PAIRS, every: int = 1, arrow: bool = False,
) -> DataFrame:
    """All pairs with v >= threshold, by matrix products on square tiles.

    Rows are packed and written once. No task holds more than two blocks of on_tiles. Loci whose entropy is too low for the
    threshold are dropped first, and only pairs that may reach it are scored. `places` = (start, end) keeps the pairs
    whose first locus has a row position in it, end excluded; blocks without such a row meet no tile of their own.

    `emit(a, b, i, j, r, c, first, v)` may turn the pairs of a part into other rows of `schema` where they are scored, so that the pairs are never
    stored, as record batches with `arrow`; `extra` names a column of `binary` that its blocks bring along, a value per row. With `every`, only about every so many parts are
    scored, for an estimate.
    """
    scratch = Scratch(binary.sparkSession, "tiles")
    rows = marginals(binary, weights)
    if prune and threshold > 0:
        rows = entropy_bound(rows, threshold)
    rows = rows.filter((F.col("dp") > 0) & (F.col("dp") < F.col("total")))
    packed, seen = scratch.save_counting(packed_rows(rows, ["x"], ["dp"], extra), "packed", F.count(F.lit(1)).alias("n"))
    w = sample_row(weights)
    start, end = places or (0, 2**62)
    whole = looks_up(w, clip)

    def score(a: Block, b: Block, i: slice, j: slice, diagonal: bool) -> Iterator[pd.DataFrame]:
        if every > 1 and int(a.pos[i.start] * 40_503 + b.pos[j.start] * 2_654_435) // 64 % every:
            return
        may = screen(a, b, 0, i, j, threshold)
        scored = None
        if whole and np.count_nonzero(may) * 8 > may.size:  # of many pairs all are looked up
            scored = looked_up(a, b, 0, i, j, a.pos[i][:, None] < b.pos[j][None, :])
            may &= scored >= threshold
        r, c, first = candidates(a, b, i, j, may, diagonal)
        if places is not None:
            at = np.minimum(a.pos[i][r], b.pos[j][c])
            mine = (at >= start) & (at < end)
            r, c, first = r[mine], c[mine], first[mine]
        v = exact(a, b, 0, i, j, r, c, first, clip) if scored is None else scored[r, c]
        keep = v >= threshold
        r, c, first, v = r[keep], c[keep], first[keep], v[keep]
        if emit is not None:
            yield from emit(a, b, i, j, r, c, first, v)
        else:
            one, two = a.locus[i][r], b.locus[j][c]
            yield pd.DataFrame({"locus1": np.where(first, one, two), "locus2": np.where(first, two, one), "v": v})

    return on_tiles(packed, seen["n"], [w], score, schema, scratch, tile, places, arrow=arrow)


def selected_pairs(pairs: DataFrame, binary: DataFrame, weights: DataFrame, strict: bool = True) -> DataFrame:
    """(locus1, locus2, v) of distinct requested pairs, by two equi-joins; 0 where the reference locus has one state.

    The pair is scored in the order of row positions. strict: a locus that the matrix lacks is an error, else the pair is left out.
    """
    want = normalised(pairs.select("locus1", "locus2")).distinct()
    m = marginals(binary, weights).select("locus", "row_pos", "x", "w", "dp", "total")
    if strict:
        asked = want.select(F.explode(F.array("locus1", "locus2")).alias("locus")).distinct()
        missing = [r.locus for r in asked.join(m.select("locus"), "locus", "left_anti").limit(10).collect()]
        if missing:
            raise ValueError(f"loci that the matrix lacks: {missing}")
    a = m.select(*[F.col(c).alias(f"{c}_a") for c in m.columns])
    b = m.select(*[F.col(c).alias(f"{c}_b") for c in ("locus", "row_pos", "x", "dp")])
    j = want.join(a, F.col("locus1") == F.col("locus_a")).join(b, F.col("locus2") == F.col("locus_b"))
    n11 = weighted_ones(F.zip_with("x_a", "x_b", lambda x, y: x * y), F.col("w_a"))
    first = F.col("row_pos_a") < F.col("row_pos_b")
    j = j.withColumn("n11", n11)  # as a column, since the score uses it many times
    v = pair_score(F.col("n11"), F.when(first, F.col("dp_a")).otherwise(F.col("dp_b")), F.when(first, F.col("dp_b")).otherwise(F.col("dp_a")), F.col("total_a"))
    return j.select("locus1", "locus2", F.coalesce(v, F.lit(0.0)).alias("v"))


def resolve_loci(df: DataFrame, column: str, matrix: DataFrame) -> DataFrame:
    """Labels such as 12, '12' or 'chr1_12' as loci of the matrix; others are dropped."""
    label = F.col(column).cast("string")
    found = F.coalesce(F.expr(f"try_cast(cast(`{column}` as string) as bigint)"), F.expr(f"try_cast(element_at(split(cast(`{column}` as string), '_'), -1) as bigint)"))
    return df.withColumn("locus", found).filter(label.isNotNull()).join(matrix.select("locus").distinct(), "locus", "left_semi")
