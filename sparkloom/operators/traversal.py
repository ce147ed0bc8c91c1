"""Breadth-first search and shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.graph import Graph
from sparkloom.session import cut, dropped, stored

#: Distances of vertices that are not reached.
UNREACHED_HOPS, UNREACHED_LENGTH = 1_000_000_000, 2_147_483_647


def reached(g: Graph, source: int) -> DataFrame:
    """``id, dist`` of the vertices reached from ``source``, however far. Each round joins the frontier with the edges; AQE broadcasts a small frontier."""
    spark = g.edges.sparkSession
    seen = frontier = stored(spark.createDataFrame([(source, 0)], "id long, dist long").join(g.vertices.select("id").distinct(), "id", "left_semi"))
    edges = g.edges.select("src", "dst").repartition("src").persist()
    parts = [seen]
    k = 0
    while not frontier.isEmpty():
        k += 1
        found = frontier.select(F.col("id").alias("src")).join(edges, "src").select(F.col("dst").alias("id")).distinct()
        frontier = stored(found.join(seen, "id", "left_anti").select("id", F.lit(k).cast("long").alias("dist")))
        seen = seen.union(frontier)
        parts.append(frontier)
        if len(parts) == 16:  # few tables to read, each row rewritten once in so many rounds
            seen = stored(seen)
            dropped(spark, [x for x in parts if x is not frontier])
            parts = [seen]
    edges.unpersist()
    return seen


def bfs(g: Graph, source: int) -> DataFrame:
    """``id, dist`` for all vertices; those not reached have 1,000,000,000."""
    return g.vertices.select("id").join(reached(g, source), "id", "left").select("id", F.coalesce("dist", F.lit(UNREACHED_HOPS)).cast("long").alias("dist"))


def sssp(g: Graph, source: int, delta: int | None = None) -> DataFrame:
    """``id, dist``: shortest distances by non-negative integer weights; those not reached have 2,147,483,647.

    With ``delta``, only vertices of the current distance range relax their edges in a round, which saves work where
    weights differ much; the result is the same.
    """
    spark = g.edges.sparkSession
    dist = cut(spark.createDataFrame([(source, 0, True)], "id long, dist long, open boolean").join(g.vertices.select("id").distinct(), "id", "left_semi"))
    edges = g.edges.select("src", "dst", F.col("w").cast("long").alias("w")).repartition("src").persist()
    while True:
        low = dist.filter("open").agg(F.min("dist")).first()[0]
        if low is None:
            break
        now = F.col("open") if delta is None else F.col("open") & (F.col("dist") < (low // delta + 1) * delta)
        cand = dist.filter(now).select(F.col("id").alias("src"), "dist").join(edges, "src").select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("new"))
        cand = cand.groupBy("id").agg(F.min("new").alias("new"))
        left = dist.withColumn("_rest", F.col("open") & ~now)
        better = F.col("dist").isNull() | (F.col("new") < F.col("dist"))
        after = stored(left.join(cand, "id", "full").select("id", F.least("dist", "new").alias("dist"), F.coalesce(F.when(F.col("new").isNotNull() & better, True), F.col("_rest"), F.lit(False)).alias("open")))
        dropped(spark, [dist])
        dist = after
    edges.unpersist()
    return g.vertices.select("id").join(dist.select("id", "dist"), "id", "left").select("id", F.coalesce("dist", F.lit(UNREACHED_LENGTH)).cast("long").alias("dist"))


def betweenness(g: Graph, source: int) -> DataFrame:
    """``id, bc``: dependency of ``source`` on each vertex, the source's own included, over the largest; 0 for all if that is 0."""
    levels = cut(reached(g, source))
    depth = levels.agg(F.max("dist")).first()[0] or 0
    edges = g.edges.select("src", "dst").join(levels.select(F.col("id").alias("src"), F.col("dist").alias("ls")), "src").join(levels.select(F.col("id").alias("dst"), F.col("dist").alias("ld")), "dst")
    dag = cut(edges.filter("ld = ls + 1").select("src", "dst", "ls"))  # only edges to the next level carry paths
    sigma = cut(levels.filter("dist = 0").select("id", F.lit(1.0).alias("sigma"), "dist"))
    every = [sigma]
    for k in range(depth):
        sigma = cut(dag.filter(F.col("ls") == k).join(sigma.select(F.col("id").alias("src"), "sigma"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma")).withColumn("dist", F.lit(k + 1).cast("long")))
        every.append(sigma)
    deltas = [every[-1].select("id", "sigma", F.lit(0.0).alias("delta"))]
    for k in range(depth - 1, -1, -1):
        below = deltas[-1].select(F.col("id").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        sums = dag.filter(F.col("ls") == k).join(below, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("share").alias("share"))
        deltas.append(cut(every[k].join(sums, "id", "left").select("id", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta"))))
    score = deltas[0]
    for d in deltas[1:]:
        score = score.union(d)
    top = score.agg(F.max("delta")).first()[0] or 0.0
    return g.vertices.select("id").join(score, "id", "left").select("id", (F.coalesce("delta", F.lit(0.0)) / (top or 1.0)).alias("bc"))
