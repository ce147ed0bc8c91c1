"""Minimum spanning forests by Boruvka rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.components import FINISH, component_labels
from sparkloom.session import dropped, stored


def _greedy(e: DataFrame) -> DataFrame:
    """``w, src, dst`` of the forest of a bounded number of edges between components ``a`` and ``b``: lightest first, in one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict = {}

        def top(x):
            r = x
            while above.setdefault(r, r) != r:
                r = above[r]
            while above[x] != r:
                above[x], x = r, above[x]
            return r

        held = list(parts)
        if not held:
            return
        rows = pd.concat(held).sort_values(["w", "src", "dst"], kind="stable")
        keep = []
        for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
            x, y = top(a), top(b)
            keep.append(x != y)
            above[x] = y
        yield rows.loc[keep, ["w", "src", "dst"]]

    return e.coalesce(1).mapInPandas(run, T.StructType([e.schema[c] for c in ("w", "src", "dst")]))


def spanning_forest(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """``src, dst, w``: a forest of least total weight, each edge once (``src < dst``).

    In a round every component takes its lightest leaving edge, ties by the ends, so choices never close a cycle; the
    chosen edges' components contract and edges inside them go. At least half of the components vanish in a round. Once
    at most ``finish`` edges are left, one task takes the lightest first, with the same order and so the same result.
    """
    spark = edges.sparkSession
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").filter("src <> dst")
    e = stored(e.groupBy("src", "dst").agg(F.min("w").alias("w")).select(F.col("src").alias("a"), F.col("dst").alias("b"), "src", "dst", "w"))
    forest = None
    while (left := e.count()) > finish:
        light = F.struct("w", "src", "dst")
        ends = e.select(F.col("a").alias("c"), light.alias("x")).union(e.select(F.col("b").alias("c"), light.alias("x")))
        best = stored(ends.groupBy("c").agg(F.min("x").alias("x")).select("x.*").distinct())
        forest = best if forest is None else forest.union(best)
        chosen = e.join(best.select("src", "dst"), ["src", "dst"], "left_semi").select("a", "b")
        labels = component_labels(chosen, "a", "b", finish)
        la, lb = labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        moved = e.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"), "src", "dst", "w").filter("a <> b")
        # of parallel edges between two components only the lightest can be chosen
        pair = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(light).alias("x"))
        fewer = stored(pair.select("a", "b", "x.src", "x.dst", "x.w"))
        dropped(spark, [e, labels])
        e = fewer
    if left:
        last = stored(_greedy(e))
        forest = last if forest is None else forest.union(last)
        dropped(spark, [e])
    if forest is None:
        return e.select("src", "dst", "w")
    return forest.select("src", "dst", "w")


def forest_summary(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``weight, edges, components`` of the minimum spanning forest."""
    f = spanning_forest(edges).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("weight"), F.count(F.lit(1)).alias("edges"))
    n = vertices.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    both = f.withColumn("n", F.lit(0).cast("long")).unionByName(n.withColumns({"weight": F.lit(0), "edges": F.lit(0)}))
    return both.agg(F.sum("weight").alias("weight"), F.sum("edges").alias("edges"), (F.sum("n") - F.sum("edges")).alias("components"))
