import numpy as np
import pytest

from lociloom.llm import quantiles
from lociloom.llm.quantiles import bounds, merge, part_of, percentiles, summary
from lociloom.scratch import Scratch
from pyspark.sql import functions as F

SCHEMA = "grp long, a double, b double, measure string, x string"


@pytest.mark.parametrize("halvings,hot", [(1, 500), (4, 500), (4, 1)])
def test_equal_numpy(spark, monkeypatch, halvings, hot):
    monkeypatch.setattr(quantiles, "HOT_PARTS", hot)
    rng = np.random.default_rng(halvings)
    groups = {1: rng.normal(size=400), 2: rng.choice([0.0, -1.5, 3.0], 300), 3: np.concatenate([10.0 ** rng.uniform(-200, 200, 90), -(10.0 ** rng.uniform(-200, 200, 90)), [0.0] * 5]), 4: np.array([2.5]), None: rng.random(50)}
    rows = [(g, float(v), None if i % 3 else float(v) / 2, "m", None) for g, vs in groups.items() for i, v in enumerate(vs)] + [(9, None, float("nan"), "m", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    probs = (0.0, 0.1, 0.5, 0.97, 1.0)
    halves = [df.filter(F.pmod(F.hash("a"), F.lit(2)) == k) for k in (0, 1)] + [df.filter("a is null")]
    passes: list = []
    out = percentiles(halves, "grp", ("a", "b"), probs, Scratch(spark, "t"), halvings, passes).collect()
    assert passes and passes == sorted(passes, reverse=True) and passes[0] > 10  # small groups take the passes as well
    assert {(r.group_key, r.measure) for r in out} == {(g, m) for g in groups for m in ("a", "b")}
    for r in out:
        vs = groups[r.group_key] if r.measure == "a" else groups[r.group_key][::3] / 2
        assert r.n == len(vs)
        for i, p in enumerate(probs):
            want = np.quantile(vs, p)
            assert abs(r[f"p{i}"] - want) <= 1e-9 * max(1, abs(want))


def test_empty(spark):
    assert percentiles([spark.createDataFrame([], SCHEMA)], "grp", ("a",), (0.5,), Scratch(spark, "t")).count() == 0


def test_hot_groups_by_broadcast(spark, monkeypatch):
    meet = quantiles._meet
    monkeypatch.setattr(quantiles, "_meet", lambda rows, state, keys, by, most, total: meet(rows, state, keys, by, 10**9, 20 * 10_000))
    monkeypatch.setattr(quantiles, "HOT_PARTS", 20)
    v = np.random.default_rng(3).normal(size=30_000)
    g = np.where(np.arange(30_000) < 15_000, 1, np.arange(30_000))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(np.where(g > 1, g % 50 + 2, 1), v)], "grp long, a double")
    got = {r.group_key: r.p0 for r in percentiles([df], "grp", ("a",), (0.5,), Scratch(spark, "t")).collect()}
    assert got[1] == pytest.approx(np.median(v[:15_000])) and len(got) == 51


def test_infinities_count(spark):
    rows = [(1, x) for x in [float("-inf")] * 3 + [1.0, 2.0, 3.0, 4.0, 5.0] + [float("inf")] * 3]
    r = percentiles([spark.createDataFrame(rows, "grp long, a double")], "grp", ("a",), (0.0, 0.5, 0.6), Scratch(spark, "t")).first()
    assert (r.n, r.p0, r.p1, r.p2) == (11, float("-inf"), 3.0, 4.0)


def test_no_list_of_values_in_the_plan(spark):
    s = Scratch(spark, "t")
    df = spark.createDataFrame([(1, float(i)) for i in range(40)], "grp long, a double")
    saved: list = []
    s.save, keep = (lambda d, name="t": saved.append(d._jdf.queryExecution().toString()) or keep(d, name)), s.save
    out = percentiles([df], "grp", ("a",), (0.3,), s)
    assert len(saved) >= 2 and not any("collect_list" in p or "collect_set" in p for p in [*saved, out._jdf.queryExecution().toString()])


def test_parts_keep_the_order_and_the_ends_apart(spark):
    pairs = [(-1.0, 1.0), (0.0, 5.0), (-3.0, 0.0), (1e-300, 1e300), (-1e300, -1e-300), (1.0, 1.0000000000000002), (2.0, 3.0), (-5e-324, 0.0), (0.0, 5e-324), (float("-inf"), 2.0), (-1e308, 1.7e308), (1e308, 1.7e308)]
    rng = np.random.default_rng(0)
    rows = [(i, lo, hi, float(x)) for i, (lo, hi) in enumerate(pairs) for x in [lo, hi, *(max(lo, -1e308) + (min(hi, 1e308) / 2 - max(lo, -1e308) / 2) * 2 * rng.random(30))] if lo <= x <= hi]
    for h in (1, 4):
        df = spark.createDataFrame(rows, "i int, lo double, hi double, x double").select("i", "lo", "hi", "x", part_of(F.col("x"), F.col("lo"), F.col("hi"), h).alias("p"))
        for i in range(len(pairs)):
            of = sorted((r.x, r.p) for r in df.filter(F.col("i") == i).collect())
            assert [p for _, p in of] == sorted(p for _, p in of) and of[0][1] < of[-1][1]


def test_summaries_combine_with_bounded_error(spark):
    rng = np.random.default_rng(8)
    groups = {1: rng.normal(size=900), None: rng.random(7), 2: np.array([0.25] * 40)}
    rows = [(g, float(v), "x") for g, vs in groups.items() for v in vs] + [(1, None, ""), (3, float("nan"), ""), (1, float("inf"), "")]
    df = spark.createDataFrame(rows, "grp long, a double, n string")
    days = [summary(df.filter(F.pmod(F.hash("a"), F.lit(3)) == d), "grp", ("a",), 2**-6) for d in range(3)]
    out = bounds(merge(days[0].unionByName(days[1]).unionByName(days[2])), (0.1, 0.5, 0.9)).collect()
    assert {r.group_key for r in out} == set(groups)
    for r in out:
        for j, p in enumerate((0.1, 0.5, 0.9)):
            want = np.quantile(groups[r.group_key], p)
            assert r.n == len(groups[r.group_key]) and r[f"p{j}_low"] - 1e-12 <= want <= r[f"p{j}_high"] + 1e-12 and r[f"p{j}_high"] - r[f"p{j}_low"] <= 2**-6
