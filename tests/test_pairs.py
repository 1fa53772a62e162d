import math

import numpy as np
import pytest

from lociloom.functions.distance import gene_distance, gene_places, snp_distance
from lociloom.operators import compare, patterns
from lociloom.operators.matrix import marginals
from lociloom.operators.pairs import all_pairs, resolve_loci, selected_pairs
from pyspark.sql import functions as F


def naive(x, w, i, j):
    """One pair by the definition, in plain Python."""
    total, dp, dj = w.sum(), w @ x[i], w @ x[j]
    n11 = w @ (x[i] * x[j])
    cut = lambda v: min(max(v, 1e-9), 1 - 1e-9)
    p, q, s = cut(n11 / dp), cut((dj - n11) / (total - dp)), dp / total
    js = 0
    for a, b in ((p, q), (1 - p, 1 - q)):
        m = s * a + (1 - s) * b
        js += s * a * math.log2(a / m) + (1 - s) * b * math.log2(b / m)
    return math.sqrt(max(js, 0))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(20)
    x, w = rng.integers(0, 2, (97, 31)), rng.uniform(0.2, 2, 31)
    x[::10] = x[1]
    x[5] = 1
    df = spark.createDataFrame([(1000 + i, i, [int(v) for v in r]) for i, r in enumerate(x)], "locus long, row_pos long, x array<tinyint>")
    return x, w, df, spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "sample_pos int, weight double")


@pytest.mark.parametrize("t", [0.0, 0.3, 0.7])
def test_all_pairs_equal_the_naive_loop(data, t):
    x, w, df, weights = data
    want = {(1000 + i, 1000 + j): naive(x, w, i, j) for i in range(97) for j in range(i + 1, 97) if i != 5 and j != 5}
    want = {k: v for k, v in want.items() if v >= t}
    for out in (all_pairs(df, weights, t, tile=16), all_pairs(df, weights, t, tile=4096)):
        got = {(r.locus1, r.locus2): r.v for r in out.collect()}
        edge = {k for k in set(got) ^ set(want)}
        assert all(abs(naive(x, w, a - 1000, b - 1000) - t) < 1e-9 for a, b in edge)
        assert all(abs(got[k] - want[k]) < 2e-6 for k in set(got) & set(want))


def test_a_range_of_rows_has_its_share_of_the_pairs(data):
    _, _, df, weights = data
    whole = {(r.locus1, r.locus2, r.v) for r in all_pairs(df, weights, 0.1, tile=16).collect()}
    parts = [{(r.locus1, r.locus2, r.v) for r in all_pairs(df, weights, 0.1, tile=16, places=p).collect()} for p in ((0, 20), (20, 21), (21, 97))]
    assert set.union(*parts) == whole and sum(map(len, parts)) == len(whole) and all(20 == a - 1000 for a, _, _ in parts[1])


def test_blocks_carry_bits_not_numbers(data, spark):
    """An eighth of a byte a sample: the scores of 8,192 and 4,096 rows a tile are those of any other size."""
    from lociloom.operators.matrix import marginals
    from lociloom.operators.pairs import packed_rows

    x, _, df, weights = data
    rows = packed_rows(marginals(df, weights)).collect()
    assert all(len(r.bits) == 4 and (np.unpackbits(np.frombuffer(r.bits, np.uint8))[:31] == x[r.locus - 1000]).all() for r in rows)
    one, two = ({(r.locus1, r.locus2): r.v for r in all_pairs(df, weights, 0.3, tile=n).collect()} for n in (4096, 8192))
    assert one == two


def test_selected_pairs(data, spark):
    x, w, df, weights = data
    ask = spark.createDataFrame([("1003", "1001"), ("1001", "1003"), ("1005", "1007"), ("1090", "1008")], "locus1 string, locus2 string")
    got = {(r.locus1, r.locus2): r.v for r in selected_pairs(ask, df, weights).collect()}
    assert set(got) == {(1001, 1003), (1005, 1007), (1008, 1090)} and got[1005, 1007] == 0
    assert got[1008, 1090] == pytest.approx(naive(x, w, 8, 90), abs=1e-9)
    with pytest.raises(ValueError, match="5"):
        selected_pairs(spark.createDataFrame([(1001, 5)], "locus1 long, locus2 long"), df, weights)
    labels = spark.createDataFrame([("1001",), ("chr1_1002",), ("x",), (None,)], "label string")
    assert sorted(r.locus for r in resolve_loci(labels, "label", df).collect()) == [1001, 1002]


def test_collapse_score_restore_equals_direct(data):
    x, w, df, weights = data
    m = patterns.collapse(marginals(df, weights))
    reps = patterns.representatives(df, m)
    between = patterns.restore_between(all_pairs(reps, weights, 0.2, tile=32), m)
    within = patterns.restore_within(m, 0.2)
    got = {(r.locus1, r.locus2): r.v for r in between.unionByName(within).collect()}
    want = {(r.locus1, r.locus2): r.v for r in all_pairs(df, weights, 0.2, prune=False).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in got)


def test_restoration_counts_and_guard(spark):
    rows = [(10, 0, 0, 10, 2), (11, 1, 0, 10, 2), (20, 2, 1, 20, 3), (21, 3, 1, 20, 3), (22, 4, 1, 20, 3), (30, 5, 2, 30, 1)]
    m = spark.createDataFrame([(*r, 0.5) for r in rows], "locus long, row_position long, pattern_group long, representative long, pattern_size long, within_pattern_v double")
    pairs = spark.createDataFrame([(10, 20, 0.5), (20, 30, 0.6)], "locus1 long, locus2 long, v double")
    assert patterns.restore_between(pairs, m).count() == 9 and patterns.restore_within(m, 0.4).count() == 4
    with pytest.raises(MemoryError):
        patterns.restore_between(pairs, m, 8)
    with pytest.raises(ValueError):
        patterns.restore_between(spark.createDataFrame([(11, 20, 0.5)], pairs.schema), m)


def test_merge_takes_strings_and_ints(spark):
    a = spark.createDataFrame([("20", "10", 0.4)], "locus1 string, locus2 string, v double")
    b = spark.createDataFrame([(10, 20, 0.6, -1), (1, 2, 0.1, 7)], "locus1 long, locus2 long, v double, geno_dis long")
    got = sorted(tuple(r) for r in compare.merge_pairs(a, b).collect())
    assert got == [(1, 2, -1.0, 0.1, 7), (10, 20, 0.4, 0.6, -1)]


def test_distances(spark):
    c1, total = 3_288_558, 5_165_770
    rows = [(5, 5, 0), (1, c1, 1), (1, 11, 10), (c1, c1 + 1, -1), (c1 + 1, total, 1), (5, total + 1, -2), (total, total, 0)]
    df = spark.createDataFrame(rows, "a long, b long, d long").select("d", snp_distance(F.col("a"), F.col("b")).alias("got"))
    assert all(r.d == r.got for r in df.collect())


def test_gene_distances(spark):
    g = 5_165_770
    genes = spark.createDataFrame([(g + 1, "a"), (g + 2, "b"), (g + 3, "c"), (g + 4, "d"), (g + 5, "e"), (g + 6, "x")], "locus_id long, g string")
    iv = spark.createDataFrame([("a", 100, 200, "NC_1"), ("b", 350, 300, "NC_1"), ("c", 10, 20, "NC_004605"), ("e", 150, 250, "NC_1")], "qacc string, sstart int, send int, sacc string")
    places = gene_places(genes, iv, spark.createDataFrame([("d", "k1")], "qacc string, sacc string"))
    want = {(150, g + 1): 0, (90, g + 1): 10, (g + 1, 210): 10, (g + 1, g + 2): 150, (g + 1, g + 3): -1, (g + 1, g + 5): 0, (g + 4, 50): -1, (5, g + 6): -1, (g + 4, g + 4): 0}
    df = spark.createDataFrame(list(want), "locus1 long, locus2 long")
    got = {(r.locus1, r.locus2): r.geno_dis for r in gene_distance(df, places).collect()}
    assert got[90, g + 1] == 10 and got[150, g + 1] == 0 and got[g + 1, 210] == 10
    assert got[g + 1, g + 3] == -1 and got[g + 1, g + 5] == 0 and got[g + 4, 50] == -1 and got[5, g + 6] == -1 and got[g + 4, g + 4] == 0
