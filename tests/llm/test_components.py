import random

import pytest

from lociloom.llm import components
from lociloom.llm.components import groups_of_all, linked_groups
from lociloom.scratch import Scratch

SCHEMA = "locus1 long, locus2 long, v float, u string, m int, h long"


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def run(spark, pairs):
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a long, b long")
    return {r.vertex: r.group_id for r in linked_groups(df, "a", "b", Scratch(spark, "t")).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(1, 120), rng.randint(1, 120)) for _ in range(70)]
    want = {k: v for k, v in brute(pairs).items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert run(spark, pairs) == want


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(1, 90)]
    random.Random(4).shuffle(chain)
    star = [(500, 1000 + i) for i in range(60)]
    assert run(spark, chain + star + star) == brute(chain + star)


def test_hub_goes_through_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_PARTS", 10**9)
    pairs = [(7, 10_000 + i) for i in range(2500)] + [(3, 10_000), (11_000, 90_000)]
    assert run(spark, pairs) == brute(pairs)


def test_dirty_rows(spark):
    rows = [(5, 3, 0.3), (3, 9, 1.0), (9, 20, 0.29), (20, 20, 0.9), (None, 7, 0.9), (-1, 8, 0.9), (30, 31, float("nan")), (31, 32, float("inf")), (40, 41, None), (5, 3, 0.8)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = sorted((r.locus, r.group_id) for r in groups_of_all(df, Scratch(spark, "t")).collect())
    assert got == [(3, 3), (5, 3), (7, 7), (8, 8), (9, 3), (20, 20), (30, 30), (31, 31), (32, 32), (40, 40), (41, 41)]


def test_empty(spark):
    assert groups_of_all(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0
