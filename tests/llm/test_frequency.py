import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lociloom.llm import frequency
from lociloom.llm.frequency import mark, prefix_counts
from lociloom.scratch import Scratch
from pyspark.sql import functions as F


def brute(rows):
    n, rec = Counter(), defaultdict(set)
    for *terms, r in rows:
        if r is None or terms[0] is None:
            continue
        for d in range(1, len(terms) + 1):
            if terms[d - 1] is None:
                break
            key = (*terms[:d], *[None] * (len(terms) - d))
            n[key] += 1
            rec[key].add(r)
    return {k: (n[k], len(rec[k])) for k in n}


def run(spark, rows, schema, terms):
    out = prefix_counts(spark.createDataFrame(rows, schema), "n", terms, Scratch(spark, "t")).collect()
    got = {tuple(r[t] for t in terms): (r.n_occurrences, r.n_records) for r in out}
    assert len(got) == len(out)
    return got


@pytest.mark.parametrize("rows_per_task", [20, 2**18])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_ngrams(spark, monkeypatch, rows_per_task, batch):
    monkeypatch.setattr(frequency, "ROWS_PER_TASK", rows_per_task)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = random.Random(batch)
    rows = []
    for _ in range(600):
        size = rng.randint(1, 3)
        t = [rng.choice("aaaaab") if rng.random() < 0.7 else rng.choice("cdef") for _ in range(size)]
        rows.append((*t, *[None] * (3 - size), rng.randint(0, 20)))
    rows += [(None, None, None, 1), ("a", None, None, None)]
    try:
        assert run(spark, rows, "x string, y string, z string, n long", ["x", "y", "z"]) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_record_sets_are_settled_a_few_times():
    """One term with all rows, in many batches: every record is counted once, and the set is sorted a logarithmic number of times."""
    sorts = []
    real = frequency.Records._settle
    rng = random.Random(4)
    r = frequency.Records(np.array([0]))
    r._settle = lambda: sorts.append(1) or real(r)
    want = {0}
    for _ in range(2_000):
        more = sorted({rng.randrange(10**6) for _ in range(50)})
        want.update(more)
        r.add(np.array(more))
    assert r.size() == len(want) and len(sorts) < 40


def test_single_values_with_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(frequency, "ROWS_PER_TASK", 10)
    rows = [(5, i % 50) for i in range(3000)] + [(i, i % 3) for i in range(100, 160)] + [(None, 3), (9, None)]
    assert run(spark, rows, "x long, n int", ["x"]) == brute(rows)


def test_empty(spark):
    assert run(spark, [], "x long, n long", ["x"]) == {}


def test_marks(spark):
    df = spark.createDataFrame([(4,), (5,), (228,), (229,)], "c long").select(mark(F.col("c"), F.lit(240)).alias("m"))
    assert [r.m for r in df.collect()] == ["rare", None, None, "common"]
