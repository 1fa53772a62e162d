import numpy as np
import pytest

from lociloom.functions import encode as E
from lociloom.operators import weights as wt
from lociloom.operators.matrix import binarise, check_weights, minor_filter, with_row_position
from lociloom.queries.fixtures import event_matrix
from lociloom.operators.subgroups import subgroup_majors
from lociloom.plans.batch import fingerprint, load_full, run_batch, save_full, shard, signature
from lociloom.scratch import Scratch
from lociloom.sources.readers import header, long_matrix, read_backgrounds, read_matrix, read_pairs, read_weights
from lociloom.sources.sinks import delete, exists, write_pairs
from pyspark.sql import functions as F


def matrix(spark, rows):
    return spark.createDataFrame([(i, i, list(a)) for i, a in enumerate(rows, 1)], "locus long, row_pos long, alleles array<string>")


def test_tie_goes_to_the_first_occurrence(spark):
    got = [r.x for r in binarise(matrix(spark, ["TCTC", "CTTC", "-A-A", "GGAA"])).orderBy("locus").collect()]
    assert got == [[1, 0, 1, 0], [1, 0, 0, 1], [1, 0, 1, 0], [1, 1, 0, 0]]


def test_numbers_and_other_letters(spark):
    """Numbers 0 and 1 keep their coding, others are recoded; letters of any alphabet have a major one."""
    nums = lambda rows: spark.createDataFrame([(i, i, r) for i, r in enumerate(rows)], "locus long, row_pos long, alleles array<int>")
    got = lambda m: [r.x for r in binarise(m).orderBy("locus").collect()]
    assert got(nums([[0, 0, 0, 1], [1, 1, 0, 0]])) == [[0, 0, 0, 1], [1, 1, 0, 0]]
    assert got(nums([[0, 0, 0, 1], [7, 2, 7, 255]])) == [[1, 1, 1, 0], [1, 0, 1, 0]]
    assert got(matrix(spark, ["GGNN", "XYYX", "ZZZZ"])) == [[1, 1, 0, 0], [1, 0, 0, 1], [1, 1, 1, 1]]
    for bad in ([[0, 256]], [[-1, 0]], [[None, 2]]):
        with pytest.raises(Exception, match="not a code"):
            binarise(nums(bad)).collect()
    with pytest.raises(Exception, match="one symbol"):
        binarise(spark.createDataFrame([(1, 1, ["A", "AT"])], "locus long, row_pos long, alleles array<string>")).collect()
    sim = wt.similarity(nums([[3, 3, 1], [0, 0, 0]])).orderBy("s1", "s2").collect()
    assert [r.same for r in sim] == [2, 1, 1]


def test_encode_rejects_other_symbols(spark):
    assert matrix(spark, ["ATCG-"]).select(E.encode_alleles(F.col("alleles")).alias("c")).first().c == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="unknown allele: N"):
        matrix(spark, ["ATN"]).select(E.encode_alleles(F.col("alleles"))).collect()


def test_minor_count(spark):
    rows = [[1] * 10, [1] * 9 + [0], [1] * 6 + [0] * 4, [1] * 5 + [0] * 5]
    df = spark.createDataFrame([(i, i, x) for i, x in enumerate(rows)], "locus long, row_pos long, x array<tinyint>")
    assert [r.locus for r in minor_filter(df, 0.1, 5).collect()] == [3]


def test_similarity_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    a = rng.choice(list("ATCG-"), (57, 9))
    got = {(r.s1, r.s2): r.same for r in wt.similarity(matrix(spark, ["".join(x) for x in a]).repartition(5)).collect()}
    assert got == {(i, j): int((a[:, i] == a[:, j]).sum()) for i in range(9) for j in range(i + 1, 9)}


def test_clusters(spark):
    sim = spark.createDataFrame([(0, 1, 0.99), (1, 2, 0.985), (2, 3, 0.98), (3, 4, 1.0), (0, 4, 0.1)], "s1 int, s2 int, sim double")
    c = wt.scc(sim, spark.range(6).select(F.col("id").cast("int").alias("sample_pos")), 0.98, Scratch(spark, "t"))
    assert {r.sample: r.cluster for r in c.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    w = {r.sample_pos: r.weight for r in wt.cluster_weights(c).collect()}
    assert w[0] == pytest.approx(1 / 3) and w[3] == 0.5 and w[5] == 1


def test_complete_linkage_keeps_diameters(spark):
    rng = np.random.default_rng(3)
    x = rng.random((8, 8))
    s = (x + x.T) / 2
    np.fill_diagonal(s, 1)
    rows = [(i, j, float(s[i, j])) for i in range(8) for j in range(i + 1, 8)]
    got = {r.sample: r.cluster for r in wt.hcc(spark.createDataFrame(rows, "s1 int, s2 int, sim double"), 8, 0.9).collect()}
    d = np.sqrt(((s[:, None] - s[None]) ** 2).sum(-1))
    for i in range(8):
        for j in range(8):
            assert got[i] != got[j] or d[i, j] <= 0.9 + 1e-9


def test_complete_linkage_equals_merging_the_nearest_pair(spark):
    rng = np.random.default_rng(11)
    n = 24
    x = rng.random((n, 3))
    s = 1 / (1 + np.linalg.norm(x[:, None] - x[None], axis=2))
    d = np.round(np.sqrt(((s[:, None] - s[None]) ** 2).sum(-1)), 9)
    label, t = list(range(n)), 0.6
    while True:
        near = sorted((max(d[i, j] for i in range(n) for j in range(n) if label[i] == a and label[j] == b), a, b) for a in set(label) for b in set(label) if a < b)
        if not near or near[0][0] > t:
            break
        label = [near[0][1] if c == near[0][2] else c for c in label]
    rows = [(i, j, float(s[i, j])) for i in range(n) for j in range(i + 1, n)]
    out = wt.hcc(spark.createDataFrame(rows, "s1 int, s2 int, sim double"), n, t)
    assert [r.cluster for r in out.orderBy("sample").collect()] == label and 1 < len(set(label)) < n
    index = {r.sample: r.label for r in wt.cluster_index(out).collect()}
    order = sorted(set(label), reverse=True)
    assert index == {i: order.index(c) for i, c in enumerate(label)}
    tiles = wt.profile_distances(spark.createDataFrame(rows, "s1 int, s2 int, sim double"), n, tile=5).collect()
    assert len(tiles) == n * (n - 1) // 2 and all(abs(r.d - d[r.a, r.b]) < 1e-6 for r in tiles)


def test_sizes_of_samples():
    assert wt.ess_minima(1550, "hybrid") == (78, 31)
    assert wt.ess_minima(None) == (40, 25)


def test_weights_are_checked(spark):
    s = spark.range(3).select(F.col("id").cast("int").alias("sample_pos"))
    check_weights(s, spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 2.0)], "sample_pos int, weight double"))
    for bad in ([(0, 1.0), (1, 1.0)], [(0, -1.0), (1, 1.0), (2, 1.0)], [(0, 0.0), (1, 0.0), (2, 0.0)], [(0, float("nan")), (1, 1.0), (2, 1.0)]):
        with pytest.raises(ValueError):
            check_weights(s, spark.createDataFrame(bad, "sample_pos int, weight double"))


def test_readers(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("locus\ta\tb\tc\n9\tA\tT\t-\n4\tG\tG\tC\n")
    p = str(tmp_path / "m.tsv")
    assert header(spark, p) == ["a", "b", "c"]
    assert [(r.locus, r.row_pos, r.alleles) for r in read_matrix(spark, p).orderBy("row_pos").collect()] == [(9, 0, ["A", "T", "-"]), (4, 1, ["G", "G", "C"])]
    (tmp_path / "w.csv").write_text("sample,x,wet\nc,7,0.5\na,8,1\nb,9,2\n")
    assert [r.weight for r in read_weights(spark, str(tmp_path / "w.csv"), ["a", "b", "c"]).orderBy("sample_pos").collect()] == [1.0, 2.0, 0.5]
    (tmp_path / "b.tsv").write_text("grp\trep\n" + "".join(f"g{i}\t{x}\n" for i, x in enumerate([10, 11, 12, 13, 14, 15, 15])))
    b = read_backgrounds(spark, str(tmp_path / "b.tsv"))
    assert [r.locus for r in shard(b, 2, 1).orderBy("ordinal").collect()] == [11, 13, 15]
    assert [r.locus for r in shard(b, 1, 0, 2).orderBy("ordinal").collect()] == [10, 11]
    pairs = spark.createDataFrame([(1, 2, 0.5)], "locus1 long, locus2 long, v double")
    write_pairs(pairs, str(tmp_path / "p"), "tsv")
    assert [tuple(r) for r in read_pairs(spark, str(tmp_path / "p")).collect()] == [(1, 2, 0.5)]
    write_pairs(pairs.limit(0), str(tmp_path / "e.parquet"))
    assert read_pairs(spark, str(tmp_path / "e.parquet")).count() == 0


def test_row_positions_are_dense(spark):
    df = with_row_position(spark.range(0, 1000, 1, 7).filter("id % 3 = 0"))
    assert [(r.id, r.row_pos) for r in df.orderBy("row_pos").collect()] == [(3 * i, i) for i in range(334)]


def test_long_matrix_fills_gaps(spark):
    calls = spark.createDataFrame([(5, 0, "A"), (5, 2, "T"), (5, 2, "C")], "locus long, sample_pos int, allele string")
    assert long_matrix(calls, spark.range(4).select(F.col("id").cast("int").alias("sample_pos"))).first().alleles == ["A", "-", "C", "-"]


def test_batch_resumes_and_isolates_failures(spark, tmp_path):
    calls = []

    def run(locus, state, scratch):
        calls.append((locus, state))
        if locus == 2:
            raise RuntimeError("no such background")
        return spark.createDataFrame([(locus, state)], "locus long, state int")

    out = str(tmp_path / "out")
    assert run_batch(spark, [1, 2, 3], out, "s", run) == {"done": [1, 3], "skipped": [], "failed": [2]}
    assert len(calls) == 6
    assert run_batch(spark, [1, 3], out, "s", run)["skipped"] == [1, 3] and len(calls) == 6
    assert spark.read.parquet(f"{out}/status").filter("status = 'failed'").first().message.startswith("no such")
    with pytest.raises(RuntimeError):
        run_batch(spark, [2], out, "s", run, single=True)
    df = spark.range(3)
    sign = signature({"a": 1}, fingerprint(df))
    assert sign == signature({"a": 1}, fingerprint(df.repartition(2))) != signature({"a": 1}, fingerprint(spark.range(4)))
    save_full(spark, f"{out}/full", sign, pairs=df)
    assert load_full(spark, f"{out}/full", "other") is None and load_full(spark, f"{out}/full", sign)["pairs"].count() == 3
    delete(spark, f"{out}/full", f"{out}/1", keep=f"{out}/1/1/pairs")
    assert not exists(spark, f"{out}/full") and exists(spark, f"{out}/1/1/pairs")


def test_alleles_of_all_subgroups(spark):
    m = spark.createDataFrame([(1, 0, list("AATT")), (2, 1, list("CGGG")), (3, 2, list("AAAA"))], "locus long, row_pos long, alleles array<string>")
    out = {(r.background, r.state, r.locus): (r.major, r.n) for r in subgroup_majors(m, m.filter("locus <> 2").select("locus")).collect()}
    assert out == {(1, 1, 1): ("A", 2), (1, 1, 2): ("C", 2), (1, 1, 3): ("A", 2), (1, 0, 1): ("T", 2), (1, 0, 2): ("G", 2), (1, 0, 3): ("A", 2), (3, 1, 1): ("A", 4), (3, 1, 2): ("G", 4), (3, 1, 3): ("A", 4)}


def test_subgroups_in_blocks_equal_a_loop(spark):
    rng = np.random.default_rng(9)
    a = rng.choice(list("ATC-"), (23, 11))
    m = matrix(spark, ["".join(r) for r in a])
    major = lambda r: max(sorted(set(r), key=list(r).index), key=list(r).count)
    want = {}
    for b in range(23):
        hit = a[b] == major(a[b])
        for state, keep in ((1, hit), (0, ~hit)):
            want |= {(b + 1, state, i + 1): (major(a[i][keep]), int(keep.sum())) for i in range(23) if keep.any()}
    got = {(r.background, r.state, r.locus): (r.major, r.n) for r in subgroup_majors(m, m.select("locus"), tile=7, masks=5).collect()}
    assert got == want


def test_all_events_are_samples(spark, tmp_path):
    rows = [(u * 1000 + i, u, i, "click" if i < 40 else "signup") for u, n in ((1, 45), (2, 42)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    m, n = event_matrix(spark, str(tmp_path))
    got = {r.locus: "".join(r.alleles) for r in m.collect()}
    assert n == 45 and got == {1: "T" * 40 + "G" * 5, 2: "T" * 40 + "G" * 2 + "-" * 3}


def test_f6_events_are_shuffled_without_their_names(spark, tmp_path):
    spark.range(50).selectExpr("id AS event_id", "timestamp_micros(id * 7 % 50) AS ts", "id % 3 AS user_id", "element_at(array('view', 'click', 'purchase', 'signup', 'error'), 1 + int(id % 5)) AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    m, n = event_matrix(spark, str(tmp_path))
    letters = dict(zip(range(5), "ATCG-"))
    want = {u: [letters[i % 5] for i in sorted(range(u, 50, 3), key=lambda i: i * 7 % 50)] for u in range(3)}
    assert n == 17 and {r.locus: r.alleles for r in m.collect()} == {u: a + ["-"] * (n - len(a)) for u, a in want.items()}
    nodes = [m._jdf.queryExecution().sparkPlan()]
    for p in nodes:
        nodes += [p.children().apply(i) for i in range(p.children().size())]
    window = next(p for p in nodes if p.nodeName() == "Window")
    sent = window.children().apply(0).output()
    assert "string" not in [sent.apply(i).dataType().typeName() for i in range(sent.size())]
