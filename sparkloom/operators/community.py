"""Strongly connected components and communities by modularity."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.graph import Graph
from sparkloom.operators.components import FINISH
from sparkloom.plans.fixpoint import iterate
from sparkloom.session import dropped, stored


def strongly_connected(g: Graph) -> DataFrame:
    """``id, component``: the component is its smallest id.

    In each turn every vertex takes the largest id that reaches it as its colour; what reaches the colour's own vertex
    within the colour is a component and leaves the graph. Vertices without a way in or out are components at once.
    """
    spark = g.edges.sparkSession
    edges = stored(g.edges.select("src", "dst").filter("src <> dst").distinct())
    left = stored(g.vertices.select("id").distinct())
    found = []
    while not left.isEmpty():
        live = left.join(edges.select(F.col("src").alias("id")), "id", "left_semi").join(edges.select(F.col("dst").alias("id")), "id", "left_semi")
        state = live.select("id", F.col("id").alias("colour"), F.lit(True).alias("new"))

        def step(s: DataFrame, _: int, edges: DataFrame = edges) -> DataFrame:
            got = s.filter("new").select(F.col("id").alias("src"), "colour").join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("got"))
            return s.join(got, "id", "left").select("id", F.greatest("colour", "got").alias("colour"), F.coalesce(F.col("got") > F.col("colour"), F.lit(False)).alias("new"))

        colours = iterate(state, step, lambda s: s.filter("new").isEmpty(), 1 << 30).select("id", "colour")
        a, b = (colours.select(F.col("id").alias(e), F.col("colour").alias(f"c{e}")) for e in ("src", "dst"))
        within = stored(edges.join(a, "src").join(b, "dst").filter("csrc = cdst").select("src", "dst"))
        front = seen = stored(colours.filter("id = colour"))
        while not front.isEmpty():
            back = front.select(F.col("id").alias("dst"), "colour").join(within, "dst").select(F.col("src").alias("id"), "colour").distinct()
            front = stored(back.join(seen, "id", "left_anti"))
            seen = seen.union(front)
        seen = stored(seen)
        alone = left.join(live, "id", "left_anti").select("id", F.col("id").alias("colour"))
        part = stored(seen.union(alone))
        found.append(part)
        rest = stored(left.join(part, "id", "left_anti"))
        fewer = stored(edges.join(rest.select(F.col("id").alias("src")), "src", "left_semi").join(rest.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
        dropped(spark, [left, edges, within])
        left, edges = rest, fewer
    if not found:
        return left.select("id", F.col("id").alias("component"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    heads = out.groupBy("colour").agg(F.min("id").alias("component"))
    return out.join(heads, "colour").select("id", "component")


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """``modularity`` of ``groups (id, community)`` over ``edges (src, dst[, w])`` that hold both directions."""
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w"))
    a, b = (groups.select(F.col("id").alias(x), F.col("community").alias(f"c{x}")) for x in ("src", "dst"))
    joined = e.join(a, "src").join(b, "dst")
    per = joined.groupBy(F.col("csrc").alias("c")).agg(F.sum(F.when(F.col("csrc") == F.col("cdst"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("all"))
    total = F.sum("all")
    return per.agg((F.sum("inside") / total - F.sum(F.col("all") * F.col("all")) / (total * total)).alias("modularity"))


def _settled(near: dict[int, dict[int, float]], total: float) -> dict[int, int]:
    """The community of each vertex by local moving and contraction in turn; vertices and neighbours go by id, so the result is fixed."""
    at = {v: v for v in near}
    while True:
        strength = {v: sum(n.values()) for v, n in near.items()}
        group, every = {v: v for v in near}, dict(strength)
        moved = again = True
        rounds = 0
        while again and rounds < 100:
            again, rounds = False, rounds + 1
            for v in sorted(near):
                own, k = group[v], strength[v]
                into: dict[int, float] = defaultdict(float, {own: 0.0})
                for u, w in near[v].items():
                    if u != v:
                        into[group[u]] += w
                gain = lambda c: round(into[c] - k * (every[c] - (k if c == own else 0.0)) / total, 9)  # noqa: B023, E731
                best = max(sorted(into), key=lambda c: (gain(c), c == own, -c))
                if best != own:
                    every[own] -= k
                    every[best] += k
                    group[v], again = best, True
        heads: dict[int, int] = {}
        for v in sorted(group):
            heads.setdefault(group[v], v)
        moved = len(heads) < len(near)
        at = {v: heads[group[c]] for v, c in at.items()}
        if not moved:
            return at
        fewer: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for v, n in near.items():
            for u, w in n.items():
                fewer[heads[group[v]]][heads[group[u]]] += w
        near = fewer


def _united(e: DataFrame, total: float) -> DataFrame:
    """``id, head`` for a bounded number of edges, in one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: dict[int, dict[int, float]] = defaultdict(dict)
        for x in parts:
            for a, b, w in zip(x["src"].tolist(), x["dst"].tolist(), x["w"].tolist(), strict=True):
                near[a][b] = w
        found = _settled(near, total)
        yield pd.DataFrame({"id": list(found), "head": list(found.values())}, dtype="int64")

    return e.select("src", "dst", "w").coalesce(1).mapInPandas(run, "id long, head long")


def louvain(edges: DataFrame, levels: int = 10, rounds: int = 20, seed: int = 1, finish: int = FINISH) -> DataFrame:
    """``id, community`` by Louvain's two phases; ``edges (src, dst[, w])`` hold both directions, and the community is its smallest id.

    Local moving goes in rounds in which a hashed half of the vertices move to the neighbouring community with the largest
    gain (ties to the smaller one), so that two neighbours do not just swap; a level ends when two halves in a row gain
    nothing worth a move, or after ``rounds``. Then communities become vertices. All is joins and sums by key. Once at
    most ``finish`` edges are left, one task goes on vertex by vertex.
    """
    spark = edges.sparkSession
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    e = stored(edges.groupBy("src", "dst").agg(F.sum(w).alias("w")))
    total = e.agg(F.sum("w")).first()[0] or 0.0
    label = e.select(F.col("src").alias("id"), F.col("src").alias("community")).distinct()
    if not total:
        return label
    for level in range(levels):
        if e.count() <= finish:
            last = stored(_united(e, total))
            label = label.join(last.withColumnRenamed("id", "community"), "community").select("id", F.col("head").alias("community"))
            break
        strength = stored(e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
        state = stored(strength.select("id", F.col("id").alias("c"), "k"))
        links = stored(e.filter("src <> dst"))
        still = moved = 0
        for r in range(rounds):
            size = state.groupBy("c").agg(F.sum("k").alias("all"))
            near = links.join(state.select(F.col("id").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("id"), F.col("c").alias("to")).agg(F.sum("w").alias("in"))
            may = state.filter(F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "id"), F.lit(2)) == r % 2)
            # staying is a choice too, also without links inside the own community
            options = may.join(near, "id").select("id", "c", "k", "to", "in").union(may.select("id", "c", "k", F.col("c").alias("to"), F.lit(0.0)))
            gain = F.col("in") - F.col("k") * (F.col("all") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)) / total
            scored = options.groupBy("id", "c", "k", "to").agg(F.sum("in").alias("in")).join(size.withColumnRenamed("c", "to"), "to").select("id", "c", F.round(gain, 9).alias("gain"), "to")
            best = scored.groupBy("id", "c").agg(F.max(F.struct("gain", (F.col("to") == F.col("c")).alias("stay"), (-F.col("to")).alias("to"))).alias("x"))
            goes = stored(best.filter(~F.col("x.stay")).select("id", (-F.col("x.to")).alias("to")))
            n = goes.count()
            moved += n
            still = 0 if n else still + 1
            if still == 2:
                break
            if n:
                after = stored(state.join(goes, "id", "left").select("id", F.coalesce("to", "c").alias("c"), "k"))
                dropped(spark, [state])
                state = after
        if not moved:
            break
        heads = state.groupBy("c").agg(F.min("id").alias("head"))
        named = stored(state.join(heads, "c").select("id", "head"))
        label = stored(label.join(named.select(F.col("id").alias("community"), "head"), "community").select("id", F.col("head").alias("community")))
        a, b = (named.select(F.col("id").alias(x), F.col("head").alias(f"h{x}")) for x in ("src", "dst"))
        e = stored(e.join(a, "src").join(b, "dst").groupBy(F.col("hsrc").alias("src"), F.col("hdst").alias("dst")).agg(F.sum("w").alias("w")))
    # heads are smallest ids at every level, so the last ones are the smallest of all
    heads = label.groupBy("community").agg(F.min("id").alias("m"))
    return label.join(heads, "community").select("id", F.col("m").alias("community"))
