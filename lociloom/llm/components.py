"""Groups of directly or indirectly linked vertices by seed-tree pruning.

Each round every vertex tells itself and its neighbours the least vertex of its neighbourhood. A vertex that nobody names drops
out of the graph and becomes a child of the least vertex it was told of; the others go on with edges between what they were told
and the least of it. Rounds end when no edge is left. The children form a propagation forest whose roots are the least vertices of
their groups, and the root's id flows down it, latest round first.

Hub vertices: the least neighbour is a map-side aggregate; what is sent back along a hub's edges is joined from a broadcast that holds
only vertices with more than 1/HOT_PARTS of the rows, so it has at most HOT_PARTS rows (times two) by counting. All other vertices are
joined by shuffle. Every round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociloom.scratch import Scratch

HOT_PARTS = 500


def _send(rows: DataFrame, key: str, told: DataFrame, told_key: str, weight: str, total: int, heaviest: int) -> DataFrame:
    """rows joined with told (unique on told_key), hot keys from a broadcast of at most HOT_PARTS rows (times three)."""
    cut = max(total // HOT_PARTS, 1000)
    if heaviest <= cut:
        return rows.join(told, F.col(key) == F.col(told_key))
    hot = told.filter(F.col(weight) > cut)
    hot_keys = F.broadcast(hot.select(F.col(told_key).alias("__hot")))
    cold_rows = rows.join(hot_keys, F.col(key) == F.col("__hot"), "left_anti")
    cold = cold_rows.join(told.filter(F.col(weight) <= cut), F.col(key) == F.col(told_key))
    return cold.unionByName(rows.join(F.broadcast(hot), F.col(key) == F.col(told_key)))


def linked_groups(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(vertex, group_id): every vertex with an edge to another vertex, with the least vertex it can reach.

    Edges need no order; repeated edges, both directions and self-edges are fine; an edge with a null end is ignored.
    No edges give no rows.
    """
    def halves(und: DataFrame) -> DataFrame:
        return und.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("y").alias("v")), F.struct(F.col("y").alias("u"), F.col("x").alias("v")))).alias("e")).select("e.u", "e.v")

    def undirected(p: F.Column, q: F.Column, df: DataFrame) -> DataFrame:
        return df.select(F.least(p, q).alias("x"), F.greatest(p, q).alias("y")).filter(F.col("x") != F.col("y")).distinct()

    pa, pb = F.col(a), F.col(b)
    rows = F.count(F.lit(1)).alias("n")
    und, seen = scratch.save_counting(undirected(pa, pb, edges.filter(pa.isNotNull() & pb.isNotNull())), "edges", rows)
    forest: list[tuple[DataFrame, int]] = []  # vertices that dropped out in a round, and their number
    while n := seen["n"]:
        nb = halves(und)
        least, hub = scratch.save_counting(nb.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("deg")), "least", F.max("deg").alias("most"))
        told = _send(nb, "u", least.withColumnRenamed("u", "k"), "k", "deg", 2 * n, hub["most"]).select(F.col("v").alias("u"), "m")
        heard = scratch.save(told.unionByName(least.select("u", "m")).distinct(), "heard")
        best, took = scratch.save_counting(
            heard.groupBy("u").agg(F.min("m").alias("h"), F.count(F.lit(1)).alias("cnt"), F.max(F.col("m") == F.col("u")).alias("stays")), "best", F.max("cnt").alias("most"), F.count(F.when(~F.col("stays"), 1)).alias("out")
        )
        forest.append((best, took["out"]))
        many = best.filter("cnt > 1").select(F.col("u").alias("k"), "h", "cnt")
        following, seen = scratch.save_counting(undirected(F.col("m"), F.col("h"), _send(heard, "u", many, "k", "cnt", 3 * n, took["most"])), "edges", rows)
        for old in (und, least, heard):
            scratch.drop(old)
        und = following
    if not forest:
        return und.select(F.col("x").alias("vertex"), F.col("x").alias("group_id"))
    known: DataFrame | None = None
    for best, out in reversed(forest):
        tree = best.filter(~F.col("stays")).select(F.col("u").alias("child"), F.col("h").alias("parent"))
        if known is None:
            level = scratch.save(tree.select(F.col("child").alias("vertex"), F.col("parent").alias("group_id")), "known")
        else:
            sizes, hub = scratch.save_counting(tree.groupBy("parent").agg(F.count(F.lit(1)).alias("kids")), "kids", F.max("kids").alias("most"))
            above = sizes.join(known, F.col("parent") == F.col("vertex"), "left").select(F.col("parent").alias("k"), F.coalesce("group_id", "parent").alias("g"), "kids")
            level = scratch.save(_send(tree, "parent", above, "k", "kids", out, hub["most"] or 0).select(F.col("child").alias("vertex"), F.col("g").alias("group_id")), "known")
            scratch.drop(sizes)
        scratch.drop(best)
        known = level if known is None else known.unionByName(level)  # every level is written once
    roots = known.select(F.col("group_id").alias("vertex"), "group_id").distinct()
    return known.unionByName(roots)


def groups_of_all(pairs: DataFrame, scratch: Scratch, low: float = 0.3, high: float = 1.0) -> DataFrame:
    """(locus, group_id) for each locus above 0 in either column of pairs(locus1, locus2, v).

    A row links its loci if both are above 0 and low <= v <= high, compared as floats; NaN, null and infinite v link nothing.
    Loci without a link have themselves.
    """
    slim = pairs.select(F.col("locus1").cast("bigint").alias("a"), F.col("locus2").cast("bigint").alias("b"), F.col("v").cast("float").alias("v"))
    loci = slim.select(F.explode(F.array("a", "b")).alias("locus")).filter("locus > 0").distinct()
    ok = (F.col("a") > 0) & (F.col("b") > 0) & ~F.isnan("v") & (F.col("v") >= F.lit(low).cast("float")) & (F.col("v") <= F.lit(high).cast("float"))
    groups = linked_groups(slim.filter(ok), "a", "b", scratch)
    return loci.join(groups, F.col("locus") == F.col("vertex"), "left").select("locus", F.coalesce("group_id", "locus").alias("group_id"))
