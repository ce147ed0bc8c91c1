"""Hierarchical agglomerative clustering of a weighted graph into a dendrogram."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.components import component_labels
from sparkloom.operators.transform import exclusive_scan

Weight = tuple[float, int]


def _average(x: Weight, y: Weight) -> Weight:
    return (x[0] * x[1] + y[0] * y[1]) / (x[1] + y[1]), x[1] + y[1]


#: How the weights of two merging clusters to a third combine, for similarities.
LINKAGES: dict[str, Callable[[Weight, Weight], Weight]] = {
    "single": lambda x, y: (max(x[0], y[0]), x[1] + y[1]),
    "complete": lambda x, y: (min(x[0], y[0]), x[1] + y[1]),
    "weighted_average": lambda x, y: ((x[0] + y[0]) / 2, x[1] + y[1]),
    "normalized_average": _average,
    # by sizes: all weight between two clusters over the product of their sizes
    "average": lambda x, y: (x[0] + y[0], x[1] + y[1]),
}


def merges(edges: list[tuple[int, int, float]], linkage: str = "complete", similarity: bool = True) -> Iterator[tuple[int, int, float]]:
    """``a, b, weight`` of each merge, best edge first, ties by the smaller ends; the k-th merge makes the cluster -(k + 1)."""
    combine = LINKAGES[linkage]
    if not similarity and linkage in ("single", "complete"):
        combine = LINKAGES["complete" if linkage == "single" else "single"]
    by_size = linkage == "average"
    sign = -1 if similarity else 1
    near: dict[int, dict[int, Weight]] = {}
    size: dict[int, int] = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = (w, 1)
        near.setdefault(b, {})[a] = (w, 1)
    rank = {v: k for k, v in enumerate(sorted(near))}
    size = dict.fromkeys(near, 1)
    worth = lambda a, b: near[a][b][0] / (size[a] * size[b]) if by_size else near[a][b][0]
    heap = [(sign * w, rank[min(a, b)], rank[max(a, b)], min(a, b), max(a, b)) for a, b, w in edges]
    heapq.heapify(heap)
    k = 0
    while heap:
        key, _, _, a, b = heapq.heappop(heap)
        if a not in near or b not in near[a] or sign * worth(a, b) != key:
            continue
        k += 1
        new = -k
        yield a, b, sign * key
        if len(near[a]) < len(near[b]):
            a, b = b, a
        mine, theirs = near.pop(a), near.pop(b)
        mine.pop(b)
        theirs.pop(a)
        changed = set(theirs)
        for v, w in theirs.items():
            if v in mine:
                mine[v] = combine(mine[v], w)
            else:
                mine[v] = w
        rank[new] = len(rank)
        near[new], size[new] = mine, size[a] + size[b]
        for v, w in mine.items():
            near[v].pop(a, None)
            if v in changed:
                near[v].pop(b, None)
            near[v][new] = w
            heapq.heappush(heap, (sign * worth(new, v), min(rank[v], rank[new]), max(rank[v], rank[new]), min(v, new, key=rank.get), max(v, new, key=rank.get)))


def dendrogram(edges: DataFrame, linkage: str = "complete", similarity: bool = True) -> DataFrame:
    """``component, node, parent, weight``: per connected component, who merges into which cluster.

    Merges of different components never touch, so each component is clustered on its own, in parallel; within one the
    order of merges is sequential by definition, and its edges must fit one task. Clusters have negative numbers in
    the order of merges; the last of a component is its root.
    """
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("w").cast("double").alias("w")).filter("src <> dst").groupBy("src", "dst").agg((F.max if similarity else F.min)("w").alias("w"))
    labels = component_labels(e)
    dealt = e.join(labels.select(F.col("id").alias("src"), "component"), "src")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["component"].iloc[0])
        rows = []
        for k, (a, b, w) in enumerate(merges(list(zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["w"].tolist(), strict=True)), linkage, similarity), 1):
            rows += [(c, a, -k, w), (c, b, -k, w)]
        return pd.DataFrame(rows, columns=["component", "node", "parent", "weight"])

    return dealt.groupBy("component").applyInPandas(cluster, "component long, node long, parent long, weight double")


def completed(tree: DataFrame, vertices: DataFrame) -> DataFrame:
    """``pos, component, node, parent, weight``: how the roots of a :func:`dendrogram`, lone vertices included, are joined up to one tree with weight 0.

    Roots queue in the order of their components; the first two leave and their cluster joins the end, again and again.
    So of ``n`` roots the one at ``pos`` goes to the cluster at ``n + pos div 2``, and clusters go on in the same way; the
    last one, at ``2 n - 2``, has no parent. Clusters made here have the component -1 and the node ``n - 1 - pos``.
    """
    tops = tree.select("component", F.col("parent").alias("node")).groupBy("component").agg(F.min("node").alias("node"))
    lone = vertices.select(F.col("id").alias("component"), F.col("id").alias("node")).distinct().join(tree.select(F.col("node").alias("component")), "component", "left_anti")
    roots = tops.union(lone)
    n = roots.count()
    at = exclusive_scan(roots.select("component", F.lit(1).alias("one")), "component", "one").select("component", F.col("before").cast("long").alias("pos"))
    first = roots.join(at, "component").select("pos", "component", "node")
    made = tree.sparkSession.range(n, max(n, 2 * n - 1)).select(F.col("id").alias("pos"), F.lit(-1).cast("long").alias("component"), (n - 1 - F.col("id")).alias("node"))
    parent = F.when(F.col("pos") < 2 * n - 2, n + F.floor(F.col("pos") / 2))
    return first.union(made).select("pos", "component", "node", parent.cast("long").alias("parent"), F.lit(0.0).alias("weight"))


def single_linkage(edges: DataFrame) -> DataFrame:
    """``src, dst, w``: the merges of single linkage on similarities, which are the edges of a maximum spanning forest: distributed at any size."""
    from sparkloom.operators.spanning import spanning_forest

    return spanning_forest(edges.select("src", "dst", (-F.col("w")).alias("w"))).select("src", "dst", (-F.col("w")).alias("w"))


def unweighted_rule(edges: DataFrame) -> DataFrame:
    """``src, dst, w`` with ``w = 1 + ceil(log2(1 + deg(src) + deg(dst)))`` for graphs without weights."""
    d = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    e = edges.select("src", "dst").join(d.withColumnRenamed("d", "ds"), "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    return e.select("src", "dst", (1 + F.ceil(F.log2(1 + F.col("ds") + F.col("dd")))).cast("long").alias("w"))
