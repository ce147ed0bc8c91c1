"""Structural operators on edge tables ``src, dst[, w]`` and vertex tables ``id[, label]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.graph import Graph


def cleaned(edges: DataFrame) -> DataFrame:
    """``edges`` without self-loops and repeats."""
    return edges.filter("src <> dst").dropDuplicates(["src", "dst"])


def cleaning_report(edges: DataFrame) -> DataFrame:
    """``self_loops, repeated, kept`` in one pass."""
    per = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    loop = F.col("src") == F.col("dst")
    return per.agg(F.coalesce(F.sum(F.when(loop, F.col("n"))), F.lit(0)).alias("self_loops"), F.coalesce(F.sum(F.when(~loop, F.col("n") - 1)), F.lit(0)).alias("repeated"), F.count(F.when(~loop, 1)).alias("kept"))


def symmetrized(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each once."""
    e = edges.select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def oriented(g: Graph) -> DataFrame:
    """Of each undirected edge the direction towards the higher degree, ties towards the higher id."""
    d = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    a, b = d.select("src", F.col("d").alias("du")), d.select(F.col("src").alias("dst"), F.col("d").alias("dv"))
    e = g.edges.select("src", "dst").join(a, "src").join(b, "dst")
    return e.filter("dv > du OR (dv = du AND dst > src)").select("src", "dst")


def half(edges: DataFrame, ascend: bool = True) -> DataFrame:
    """The edge list with symmetry broken by id."""
    return edges.filter("src < dst" if ascend else "src > dst")


def degree_histogram(g: Graph, width: int = 10) -> DataFrame:
    """``bin, n``: vertices by ``degree div width``."""
    return g.degrees().groupBy(F.floor(F.col("degree") / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def edges_exist(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """``src, dst, found`` for each wanted pair."""
    have = edges.select("src", "dst").distinct().withColumn("_f", F.lit(True))
    return wanted.select("src", "dst").join(have, ["src", "dst"], "left").select("src", "dst", F.coalesce("_f", F.lit(False)).alias("found"))


def label_frequency(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def label_index(vertices: DataFrame) -> DataFrame:
    """``label, ids``: the vertices of each label, ascending."""
    return vertices.groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def frequent_labels(vertices: DataFrame, threshold: int) -> DataFrame:
    """``n``: labels of more than ``threshold`` vertices."""
    return label_frequency(vertices).filter(F.col("n") > threshold).agg(F.count(F.lit(1)).alias("n"))


def frequent_vertices(vertices: DataFrame, threshold: int) -> DataFrame:
    """``id`` of vertices whose label has ``threshold`` vertices or more."""
    often = label_frequency(vertices).filter(F.col("n") >= threshold).select("label")
    return vertices.join(often, "label", "left_semi").select("id")


def neighbour_labels(g: Graph) -> DataFrame:
    """``id, label, n``: how many neighbours of each label a vertex has."""
    lab = g.vertices.select(F.col("id").alias("dst"), "label")
    return g.edges.join(lab, "dst").groupBy(F.col("src").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))


def masked(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among ``members (id)``."""
    a, b = members.select(F.col("id").alias("src")), members.select(F.col("id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select(*edges.columns)


def ranked_ids(members: DataFrame) -> DataFrame:
    """``id, new``: compact ids from 0 in ascending order.

    Ids are dealt to ranges first, numbered within a range, and shifted by the sizes of the ranges before; no task sees all.
    """
    from sparkloom.session import cut

    held = cut(members.select("id").distinct().repartitionByRange("id").withColumn("_p", F.spark_partition_id()))
    sizes = held.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("id")) - 1
    return held.withColumn("_r", rank).join(before, "_p").select("id", (F.col("_r") + F.col("_b")).cast("long").alias("new"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The subgraph of ``members`` with compact ids."""
    ids = ranked_ids(members)
    a, b = ids.select(F.col("id").alias("src"), F.col("new").alias("a")), ids.select(F.col("id").alias("dst"), F.col("new").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def with_self_loops(g: Graph) -> DataFrame:
    loops = g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return g.edges.select("src", "dst").union(loops).distinct()


def exclusive_scan(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value, before``: the sum of ``value`` over smaller keys, by ranges as in :func:`ranked_ids`."""
    from sparkloom.session import cut

    held = cut(rows.select(key, value).repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    sizes = held.groupBy("_p").agg(F.sum(value).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("_o", own).join(before, "_p").select(key, value, (F.col("_o") + F.col("_b")).alias("before"))


def draw(*parts: Column | int) -> Column:
    """A number from 0 to 2**60 - 1 that the parts decide: the first 15 hexadecimal digits of the MD5 of their texts, joined by colons."""
    text = F.concat_ws(":", *[(F.lit(x) if isinstance(x, int) else x).cast("string") for x in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sampled(rows: DataFrame, key: Column, k: int, seed: int = 1) -> DataFrame:
    """``k`` rows by the order of a seeded hash of ``key``."""
    return rows.orderBy(draw(seed, key), key).limit(k)


def weighted_choice(items: DataFrame, draws: DataFrame, seed: int = 1) -> DataFrame:
    """``draw, id``: for each ``draws (draw)``, one of the positive integer-weighted ``items (id, w)``, by the range that a seeded hash falls into."""
    have = items.filter("w > 0").select("id", "w")
    n, total = have.agg(F.count(F.lit(1)), F.sum("w")).first()
    width = max(1, -(-(total or 1) // max(1, n)))
    # each item's range is cut at multiples of the mean weight, twice as many pieces as items at most, which then join by equality
    pieces = exclusive_scan(have, "id", "w").select("id", "before", (F.col("before") + F.col("w")).alias("end"))
    pieces = pieces.withColumn("cell", F.explode(F.sequence(F.floor(F.col("before") / width), F.floor((F.col("end") - 1) / width))))
    aim = draws.select("draw", F.pmod(draw(seed, F.col("draw")), F.lit(total or 1)).alias("aim")).withColumn("cell", F.floor(F.col("aim") / width))
    return aim.join(pieces, "cell").filter((F.col("aim") >= F.col("before")) & (F.col("aim") < F.col("end"))).select("draw", "id")
