"""Connected components of an undirected link table by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.session import dropped, stored

#: Links that one task finishes by itself once contraction has left no more.
FINISH = 100_000


def _rank(k: int, node: Column) -> Column:
    """The order of vertices in round ``k``: that of a hash, so that no order of ids makes long chains."""
    return F.struct(F.xxhash64(F.lit(k), node).alias("h"), node.alias("id"))


def _united(e: DataFrame) -> DataFrame:
    """``id, p`` for the ends of a bounded number of links, by union and find in one task."""
    kind = e.schema["a"].dataType

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict = {}

        def top(x):
            r = x
            while above.setdefault(r, r) != r:
                r = above[r]
            while above[x] != r:
                above[x], x = r, above[x]
            return r

        for part in parts:
            for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
                x, y = top(a), top(b)
                if x != y:
                    above[max(x, y)] = min(x, y)
        nodes = list(above)
        yield pd.DataFrame({"id": nodes, "p": [top(x) for x in nodes]})

    return e.select("a", "b").coalesce(1).mapInPandas(run, T.StructType([T.StructField("id", kind), T.StructField("p", kind)]))


def component_labels(links: DataFrame, a: str = "src", b: str = "dst", finish: int = FINISH) -> DataFrame:
    """``id, component`` for each end of a link; the component is its smallest id, of any type that has an order.

    In each round the vertices are ordered by a fresh hash; every vertex points to the smallest of itself and its
    neighbours, goes two steps along the pointers, and the links are contracted along them. Whatever the ids, a constant
    part of the vertices is expected to vanish (most of a path), so there are O(log n) rounds, each a constant number of
    shuffles over links that shrink. No group is gathered: the only aggregates are minima, which combine before the
    shuffle. Once at most ``finish`` links are left, one task unites them. The rounds' maps, smaller each time, are
    then joined from the last to the first, and the smallest id of each class names it. Null ends are left out.
    """
    spark = links.sparkSession
    e = stored(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    maps: list[DataFrame] = []
    while (left := e.count()) > finish:
        k = len(maps) + 1
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("id")).agg(F.min(_rank(k, F.col("b"))).alias("m"))
        p = stored(near.select("id", F.least(_rank(k, F.col("id")), "m")["id"].alias("p")))
        q = p.select(F.col("id").alias("_id"), F.col("p").alias("_p"))
        maps.append(stored(p.join(q, F.col("p") == F.col("_id")).select("id", F.col("_p").alias("p"))))
        pa, pb = (maps[-1].select(F.col("id").alias(c), F.col("p").alias(f"p{c}")) for c in ("a", "b"))
        moved = e.join(pa, "a").join(pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        fewer = stored(moved.filter("a <> b").distinct())
        dropped(spark, [p, e])
        e = fewer
    if left:
        maps.append(stored(_united(e)))
    if not maps:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    done = [e]
    label = maps.pop()
    while maps:
        step = maps.pop()
        further = label.select(F.col("id").alias("_id"), F.col("p").alias("_p"))
        done += [step, label]
        label = stored(step.join(further, F.col("p") == F.col("_id"), "left").select("id", F.coalesce("_p", "p").alias("p")))
    heads = label.groupBy("p").agg(F.min("id").alias("component"))
    out = stored(label.join(heads, "p").select("id", "component"))
    dropped(spark, [*done, label])
    return out
