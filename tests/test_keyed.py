from collections import Counter

import numpy as np

from lociloom.operators.keyed import keyed_percentiles, keyed_profile
from lociloom.scratch import Scratch


def make(spark, rows):
    return spark.createDataFrame(rows, "run string, rep long, locus long, size long, freq string, field int")


def test_profile_counts_modes_and_nulls(spark):
    rows = [("a", 1, i % 40, 3 if i % 2 else 5, "x", 0) for i in range(400)] + [("a", 2, None, None, None, None), (None, 3, 7, 2, "", 1), (None, 3, 7, 2, "", 1)]
    got = {(r.run, r.rep): r for r in keyed_profile(make(spark, rows), ("run", "rep"), ("locus", "size")).collect()}
    hot = got["a", 1]
    assert (hot.n_rows, hot.locus_distinct, hot.size_mode, hot.size_min, hot.size_max) == (400, 40, 3, 3, 5)
    none = got["a", 2]
    assert (none.n_rows, none.locus_rows, none.locus_distinct, none.size_mode) == (1, 0, 0, None)
    assert (got[None, 3].n_rows, got[None, 3].locus_distinct) == (2, 1)


def test_profile_of_empty_table(spark):
    assert keyed_profile(make(spark, []), ("run", "rep"), ("locus", "size")).count() == 0


def test_percentiles_equal_numpy_with_a_hot_key(spark):
    rng = np.random.default_rng(5)
    vals = {("h", 1): rng.integers(0, 50, 3000), ("c", 2): rng.integers(-9, 9, 4), (None, 3): np.array([8])}
    rows = [(k[0], k[1], int(v), None, None, None) for k, vs in vals.items() for v in vs] + [("z", 9, None, 1, "", 1)]
    out = keyed_percentiles(make(spark, rows), ("run", "rep"), "locus", (0.0, 0.25, 0.5, 0.99, 1.0), Scratch(spark, "t")).collect()
    assert Counter((r.run, r.rep) for r in out) == {k: 5 for k in vals}
    for r in out:
        assert abs(r.percentile - np.quantile(vals[r.run, r.rep], r.prob)) < 1e-9
