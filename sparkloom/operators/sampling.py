"""Neighbour sampling and random walks, reproducible by seeded hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.graph import Graph
from sparkloom.operators.transform import draw, exclusive_scan, induced
from sparkloom.session import cut, stored

FANOUT = (15, 10, 10)


def fanout(g: Graph, roots: DataFrame, sizes: tuple[int, ...] = FANOUT, seed: int = 1) -> DataFrame:
    """``root, hop, path, id``: per hop, ``k`` neighbours of each frontier vertex with replacement; ``path`` numbers the draws."""
    at = Window.partitionBy("src").orderBy("dst")
    near = stored(g.edges.select("src", (F.row_number().over(at) - 1).alias("pos"), "dst"))
    size = near.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).persist()
    front = roots.select(F.col("id").alias("root"), F.lit("").alias("path"), "id")
    out = None
    for hop, k in enumerate(sizes, 1):
        # a draw is a place among the neighbours, found by an equality join; no list of neighbours is copied
        drawn = front.join(size, "id").select("root", "path", F.col("id").alias("src"), "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
        drawn = drawn.withColumn("pos", F.pmod(draw(seed, F.col("root"), F.col("path"), F.col("j")), F.col("n")).cast("int"))
        front = stored(drawn.join(near, ["src", "pos"]).select("root", F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), F.col("j").cast("string")).alias("path"), F.col("dst").alias("id")))
        part = front.select("root", F.lit(hop).alias("hop"), "path", "id")
        out = part if out is None else out.union(part)
    size.unpersist()
    return out


def random_walk(g: Graph, roots: DataFrame, length: int, seed: int = 1) -> DataFrame:
    """``root, hop, path, id``: one draw per step."""
    return fanout(g, roots, (1,) * length, seed)


def frontier_members(edges: DataFrame, roots: DataFrame, walks: int, m: int, n: int, seed: int = 1, clip: int = 3000) -> DataFrame:
    """``walk, id``: the vertices of ``walks`` subgraphs by m-dimensional random walks.

    A walk keeps ``m`` training vertices, picks one by its degree (``clip`` at most), replaces it by a random neighbour,
    and goes on until ``n`` vertices are met or ``8 n`` steps are done. All walks take a step in a round; a walk's state is
    one bounded row, so that any number of walks is dealt over the cluster while the graph stays a table.
    """
    g = Graph.of_edges(edges.select("src", "dst"), directed=True)
    adj = g.adjacency().filter(F.size("nbrs") > 0).select("id", "nbrs", F.least(F.size("nbrs"), F.lit(clip)).alias("deg")).persist()
    spark = edges.sparkSession
    ids = stored(exclusive_scan(roots.join(adj.select("id"), "id", "left_semi").select("id", F.lit(1).alias("one")).distinct(), "id", "one"))
    n_roots = ids.count()
    m = min(m, n_roots)
    if not m:
        return ids.select(F.lit(0).cast("long").alias("walk"), "id").limit(0)
    # all roots can start a walk: they are numbered, cut into m runs, and a walk takes one of each run
    begin = F.floor(F.col("j") * n_roots / m)
    picked = begin + F.pmod(F.xxhash64(F.lit(seed), "walk", "j"), F.floor((F.col("j") + 1) * n_roots / m) - begin)
    start = spark.range(walks).withColumnRenamed("id", "walk").select("walk", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j")).select("walk", picked.alias("before")).join(ids.select("id", "before"), "before").select("walk", "id")
    state = start.join(adj, "id").groupBy("walk").agg(F.array_sort(F.collect_list(F.struct("id", "deg"))).alias("front")).withColumn("met", F.transform("front", lambda x: x["id"]))
    state = cut(state)
    for k in range(8 * n):
        live = state.filter(F.size("met") < n)
        if live.isEmpty():
            break
        total = F.aggregate("front", F.lit(0), lambda s, x: s + x["deg"])
        aim = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "walk"), total).cast("int")
        seen = F.aggregate("front", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at")), lambda s, x: F.struct((s["sum"] + x["deg"]).alias("sum"), (s["at"] + F.when(s["sum"] + x["deg"] <= F.col("aim"), 1).otherwise(0)).alias("at")), lambda s: s["at"])
        chosen = live.withColumn("aim", aim).withColumn("at", seen).withColumn("id", F.col("front")[F.col("at")]["id"])
        step = chosen.join(adj.select("id", "nbrs"), "id").withColumn("next", F.element_at("nbrs", F.pmod(F.xxhash64(F.lit(seed), F.lit(-k - 1), "walk"), F.size("nbrs")).cast("int") + 1)).drop("id", "nbrs")
        step = step.join(adj.select(F.col("id").alias("next"), "deg"), "next", "left")
        front = F.transform("front", lambda x, i: F.when((i == F.col("at")) & F.col("deg").isNotNull(), F.struct(F.col("next").alias("id"), F.col("deg").alias("deg"))).otherwise(x))
        state = cut(step.select("walk", front.alias("front"), F.array_union("met", F.array("next")).alias("met")).union(state.filter(F.size("met") >= n)))
    adj.unpersist()
    return state.select("walk", F.explode("met").alias("id"))


def sampled_subgraph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The induced subgraph of sampled vertices, with compact ids."""
    return induced(edges, members.select("id").distinct())
