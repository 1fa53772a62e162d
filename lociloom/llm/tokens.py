"""Token ids of whole texts by a public byte-level BPE.

Short texts are encoded where they are read. A long text is halved until its pieces are short, the pieces are encoded in parallel by
all tasks, and the pieces' ids are joined pairwise, as a tree: a window around each join is encoded again, and it grows until it starts and
ends at points where the text is split in any context and its outermost ids are those of either side. In a run without such a point
(one long word) the window consists of byte pieces, and it fits when its first id and the id before it, and its last id and the id after it,
encode to themselves as a pair; ids of which all neighbours do are the ids of the whole run.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF_CHARS = 16_384
# fixed value: the pattern that splits text before the merges of byte_bpe_50k
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Between these characters the pattern splits, whatever stands around them.
SPLIT = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])")
ONE_RUN = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")
_LOADED: dict[str, "Bpe"] = {}


class Bpe:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.code = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()}

    @classmethod
    def load(cls, path: str) -> "Bpe":
        """One per Python worker, from the path or, where an executor lacks it, from the file that the driver sent."""
        if path not in _LOADED:
            _LOADED[path] = cls(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
        return _LOADED[path]

    def encode(self, text: str) -> list[int]:
        return self.code.encode_ordinary(text)

    def spell(self, ids: Sequence[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def _pair_holds(self, a: int, b: int) -> bool:
        return self.code._encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]

    def _split_left(self, ids: list[int], w: int) -> int | None:
        """Index of the first id after a split point among the last w ids, or None."""
        part = ids[-w:]
        raw = self.spell(part)
        skip = next((k for k in range(min(4, len(raw))) if raw[k] & 0xC0 != 0x80), 0)
        text = raw[skip:].decode("utf-8", "ignore")
        at = next((m.start() for m in SPLIT.finditer(text)), None)
        return None if at is None else self._index(part, skip + len(text[:at].encode()), len(ids) - len(part))

    def _split_right(self, ids: list[int], w: int) -> int | None:
        part = ids[:w]
        text = self.spell(part).decode("utf-8", "ignore")
        at = None
        for m in SPLIT.finditer(text):
            at = m.start()
        return None if at is None else self._index(part, len(text[:at].encode()), 0)

    def _index(self, part: list[int], offset: int, first: int) -> int | None:
        n = 0
        for k, i in enumerate(part):
            if n == offset:
                return first + k
            n += len(self.bytes[i])
        return None

    def _join_run(self, left: list[int], right: list[int], most: int) -> list[int] | None:
        """Join inside one run without split points, or None if no window of up to `most` ids fits or it isn't one run."""
        w = 8
        a, b = (self.spell(x).decode("utf-8", "ignore") for x in (left[-most:], right[:most]))
        a = a.lstrip("�")
        if not ONE_RUN.fullmatch(a + b):
            return None
        while w < most and w < len(left) and w < len(right):
            mid = self.code._encode_single_piece(self.spell(left[-w:]) + self.spell(right[:w]))
            if self._pair_holds(left[-w - 1], mid[0]) and self._pair_holds(mid[-1], right[w]):
                return left[:-w] + mid + right[w:]
            w *= 2
        return None

    def join(self, left: list[int], right: list[int], window: int = 32) -> list[int]:
        """The ids of the concatenated text from the ids of its two parts."""
        if not left or not right:
            return left or right
        w = window
        while True:
            all_left, all_right = w >= len(left), w >= len(right)
            i = 0 if all_left else self._split_left(left, w)
            j = len(right) if all_right else self._split_right(right, w)
            if i is not None and j is not None:
                mid = self.encode((self.spell(left[i:]) + self.spell(right[:j])).decode("utf-8"))
                if (all_left or mid[:1] == left[i : i + 1]) and (all_right or mid[-1:] == right[j - 1 : j]):
                    return left[:i] + mid + right[j:]
            if w == 16 * window and not (all_left or all_right) and (run := self._join_run(left, right, w)) is not None:
                return run
            if all_left and all_right:
                return self.encode((self.spell(left) + self.spell(right)).decode("utf-8"))
            w *= 4

    def join_all(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []


def _ids_array(lists: list[list[int]]) -> pa.Array:
    offsets, n = [0], 0
    for x in lists:
        n += len(x)
        offsets.append(n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([i for x in lists for i in x], pa.int32()))


def _result(lists: list[list[int]], count_only: bool) -> pa.Array:
    return pa.array([len(x) for x in lists], pa.int64()) if count_only else _ids_array(lists)


def encode(df: DataFrame, text: str, keep: Sequence[str], vocabulary: str = VOCABULARY, count_only: bool = False, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """The kept columns with `ids` (list of int), or with `n_tokens` (bigint) if only the count is wanted; one row per row of df.

    Null and empty texts have no ids; blank texts are encoded as they are; strings of special tokens are ordinary text. Texts may be of any
    length. Rows are told apart by their place, so repeated or null ids of documents don't matter, nor do other columns.
    """
    if os.path.exists(vocabulary):
        df.sparkSession.sparkContext.addFile(vocabulary)
    name, kind = ("n_tokens", T.LongType()) if count_only else ("ids", T.ArrayType(T.IntegerType(), True))
    slim = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text).cast("string").alias("body"))
    ks = [f"k{i}" for i in range(len(keep))]
    fields = [slim.schema[k] for k in ks]
    size = F.coalesce(F.length("body"), F.lit(0))

    def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(vocabulary)
        for b in batches:
            at = b.schema.get_field_index("body")
            lists = [bpe.encode(t) if t else [] for t in b.column(at).to_pylist()]
            rest = [(b.schema.names[j], b.column(j)) for j in range(b.num_columns) if j != at]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], _result(lists, count_only)], names=[*[n for n, _ in rest], name])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(vocabulary)
        for b in batches:
            at = b.schema.get_field_index("body")
            lists = [bpe.encode(t) for t in b.column(at).to_pylist()]
            rest = [(b.schema.names[j], b.column(j)) for j in range(b.num_columns) if j != at]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], _ids_array(lists)], names=[*[n for n, _ in rest], "leaf_ids"])

    def join_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(vocabulary)
        for b in batches:
            at = b.schema.get_field_index("parts")
            lists = [bpe.join_all(parts) for parts in b.column(at).to_pylist()]
            rest = [(b.schema.names[j], b.column(j)) for j in range(b.num_columns) if j != at]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], _result(lists, count_only)], names=[*[n for n, _ in rest], name])

    out = T.StructType([*fields, T.StructField(name, kind)])
    short = slim.filter(size <= leaf_chars).mapInArrow(encode_batches, out)
    halvings = F.ceil(F.log2(size / F.lit(leaf_chars)))
    long = slim.filter(size > leaf_chars).withColumns({"uid": F.monotonically_increasing_id(), "leaves": F.pow(F.lit(2.0), halvings).cast("int"), "size": F.length("body").cast("bigint")})
    start = lambda i: F.floor(F.col("size") * i / F.col("leaves")).cast("int")
    leaf = long.withColumn("leaf", F.explode(F.sequence(F.lit(0), F.col("leaves") - 1)))
    leaf = leaf.select("uid", *ks, "leaf", F.substr("body", start(F.col("leaf")) + 1, start(F.col("leaf") + 1) - start(F.col("leaf"))).alias("body")).repartition("uid", "leaf")
    leaf_schema = T.StructType([T.StructField("uid", T.LongType()), *fields, T.StructField("leaf", T.IntegerType()), T.StructField("leaf_ids", T.ArrayType(T.IntegerType(), True))])
    encoded = leaf.mapInArrow(encode_leaves, leaf_schema)
    whole = encoded.groupBy("uid").agg(*[F.first(k).alias(k) for k in ks], F.array_sort(F.collect_list(F.struct("leaf", "leaf_ids"))).alias("p"))
    joined = whole.select(*ks, F.col("p.leaf_ids").alias("parts")).mapInArrow(join_leaves, out)
    return short.unionByName(joined).select(*[F.col(k).alias(n) for k, n in zip(ks, keep)], name)
