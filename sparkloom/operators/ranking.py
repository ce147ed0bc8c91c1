"""PageRank, core numbers and greedy colouring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.graph import Graph
from sparkloom.plans.fixpoint import iterate
from sparkloom.session import cut, dropped, stored

DAMPING, EPSILON, ROUNDS = 0.85, 1e-4, 100


def pagerank(g: Graph, rounds: int = ROUNDS, epsilon: float | None = EPSILON) -> DataFrame:
    """``id, rank``: Jacobi rounds from 1/n until the summed change is below ``epsilon``; the mass of sinks is dropped."""
    n = g.vertices.count()
    out = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    # the out-degree rides on the edges, so a round joins and groups once
    edges = g.edges.select("src", "dst").join(out, "src").select("src", "dst", (F.lit(1.0) / F.col("deg")).alias("share")).repartition("src").persist()
    ids = g.vertices.select("id").persist()

    def received(state: DataFrame) -> DataFrame:
        return edges.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))

    def step(state: DataFrame, _: int) -> DataFrame:
        got = received(state)
        old = state.select("id", F.col("rank").alias("old"))
        return old.join(got, "id", "left").select("id", ((1 - DAMPING) / n + DAMPING * F.coalesce("got", F.lit(0.0))).alias("rank"), "old")

    def done(after: DataFrame) -> bool:
        return epsilon is not None and (after.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < epsilon

    first = F.lit(1.0 / max(1, n))
    if epsilon is None:  # nothing is tested between rounds, so a few of them make one plan
        state = ids.select("id", first.alias("rank"))
        for k in range(1, rounds + 1):
            state = ids.join(received(state), "id", "left").select("id", ((1 - DAMPING) / n + DAMPING * F.coalesce("got", F.lit(0.0))).alias("rank"))
            if k % 5 == 0 or k == rounds:
                state = stored(state)
        edges.unpersist()
        ids.unpersist()
        return state
    ranks = iterate(ids.select("id", first.alias("rank"), first.alias("old")), step, done, rounds).select("id", "rank")
    edges.unpersist()
    ids.unpersist()
    return ranks


def core_numbers(g: Graph) -> DataFrame:
    """``id, core``: the fixpoint of each vertex's h-index over its neighbours' values, from the degrees on."""
    edges = g.edges.select("src", "dst").filter("src <> dst").distinct().repartition("dst").persist()
    deg = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("core"))
    start = g.vertices.select("id").join(deg, "id", "left").select("id", F.coalesce("core", F.lit(0)).cast("long").alias("core"), F.lit(-1).cast("long").alias("old"))

    def step(state: DataFrame, _: int) -> DataFrame:
        near = edges.join(state.select(F.col("id").alias("dst"), "core"), "dst")
        # an h-index needs only how many neighbours have each value: counts, then sums from the largest value down
        per = near.groupBy("src", F.col("core").alias("v")).agg(F.count(F.lit(1)).alias("n")).groupBy("src").agg(F.reverse(F.array_sort(F.collect_list(F.struct("v", "n")))).alias("vs"))
        zero = F.lit(0).cast("long")
        h = F.aggregate("vs", F.struct(zero.alias("sum"), zero.alias("h")), lambda s, x: F.struct((s["sum"] + x["n"]).alias("sum"), F.greatest(s["h"], F.least(x["v"], s["sum"] + x["n"])).alias("h")), lambda s: s["h"])
        return state.select("id", F.col("core").alias("old")).join(per.select(F.col("src").alias("id"), h.alias("_h")), "id", "left").select("id", F.coalesce("_h", zero).alias("core"), "old")

    def done(after: DataFrame) -> bool:
        return after.filter("core <> old").isEmpty()

    out = iterate(start, step, done, 100_000).select("id", "core")
    edges.unpersist()
    return out


def core_members(g: Graph, k: int) -> DataFrame:
    """``id`` of the vertices of the k-core, by peeling: each round drops what has fewer than ``k`` neighbours left."""
    edges = cut(g.edges.select("src", "dst").filter("src <> dst").distinct())
    size = edges.count()
    while True:
        stay = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        fewer = stored(edges.join(stay.select("src"), "src", "left_semi").join(stay.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"))
        dropped(edges.sparkSession, [edges])
        edges = fewer
        left = edges.count()
        if left == size:
            return edges.select(F.col("src").alias("id")).distinct()
        size = left


def greedy_colouring(g: Graph) -> DataFrame:
    """``id, colour``: first-fit in the order of ids. A vertex takes its colour once all neighbours with smaller ids have theirs, so each round colours a whole front."""
    low = g.edges.select("src", "dst").filter("dst < src").distinct().repartition("dst").persist()
    wait = low.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("need"))
    state = cut(g.vertices.select("id").join(wait, "id", "left").select("id", F.coalesce("need", F.lit(0)).alias("need"), F.when(F.col("need").isNull(), 0).cast("long").alias("colour")))
    while not state.filter("colour is null").isEmpty():
        have = low.join(state.filter("colour is not null").select(F.col("id").alias("dst"), "colour"), "dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("got"), F.array_sort(F.collect_set("colour")).alias("used"))
        free = F.aggregate("used", F.lit(0).cast("long"), lambda c, x: F.when(x == c, c + 1).otherwise(c))
        after = stored(state.join(have, "id", "left").select("id", "need", F.coalesce("colour", F.when(F.col("got") == F.col("need"), free)).alias("colour")))
        dropped(state.sparkSession, [state])
        state = after
    low.unpersist()
    return state.select("id", "colour")
