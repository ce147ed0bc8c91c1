"""Graph partitions: by ranges of ids, with halos, by destination blocks, and in two dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.transform import exclusive_scan
from sparkloom.session import stored


def range_part(v: Column, n: int, parts: int) -> Column:
    """The part of a vertex by contiguous ranges of ``ceil(n / parts)`` ids."""
    return F.floor(v / -(-n // parts)).cast("long")


def one_dimensional(edges: DataFrame, n: int, parts: int) -> DataFrame:
    """``part, src, dst`` by the source's range."""
    return edges.select(range_part(F.col("src"), n, parts).alias("part"), "src", "dst")


def by_destination(edges: DataFrame, n: int, parts: int) -> DataFrame:
    """``part, src, dst`` by the destination's range (segments of the columns)."""
    return edges.select(range_part(F.col("dst"), n, parts).alias("part"), "src", "dst")


def two_dimensional(edges: DataFrame, n: int, parts: int) -> DataFrame:
    """``part, src, dst`` where the cell is ``part(src) * parts + part(dst)``."""
    return edges.select((range_part(F.col("src"), n, parts) * parts + range_part(F.col("dst"), n, parts)).alias("part"), "src", "dst")


def halo_members(edges: DataFrame, n: int, parts: int) -> DataFrame:
    """``part, id``: for each range, its vertices with edges and their neighbours."""
    part = range_part(F.col("src"), n, parts).alias("part")
    return edges.select(part, F.col("src").alias("id")).union(edges.select(part, F.col("dst").alias("id"))).distinct()


def with_halo(edges: DataFrame, n: int, parts: int) -> DataFrame:
    """``part, src, dst``: for each range, all edges among its vertices and their neighbours."""
    members = halo_members(edges, n, parts)
    a, b = members.select("part", F.col("id").alias("src")), members.select("part", F.col("id").alias("dst"))
    return edges.select("src", "dst").join(a, "src").join(b, ["part", "dst"], "left_semi").select("part", "src", "dst")


def local_ids(members: DataFrame) -> DataFrame:
    """``part, id, local``: compact ids from 0 in each part; a part is what one machine holds, so its members are ranked in one task."""
    return members.withColumn("local", (F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1).cast("long")).select("part", "id", "local")


def with_halo_local(edges: DataFrame, n: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """The edges of :func:`with_halo` by local ids, and the map ``part, id, local`` back to global ones."""
    ids = stored(local_ids(halo_members(edges, n, parts)))
    a, b = (ids.select("part", F.col("id").alias(e), F.col("local").alias(f"l{e}")) for e in ("src", "dst"))
    return with_halo(edges, n, parts).join(a, ["part", "src"]).join(b, ["part", "dst"]).select("part", F.col("lsrc").alias("src"), F.col("ldst").alias("dst")), ids


def cells(edges: DataFrame, wanted: list[int], n: int, parts: int) -> DataFrame:
    """``src, dst`` of the induced subgraph of chosen ranges; on a table stored by cell this prunes files."""
    keep = [a * parts + b for a in wanted for b in wanted]
    return two_dimensional(edges, n, parts).filter(F.col("part").isin(keep)).select("src", "dst")


def balanced_chunks(edges: DataFrame, parts: int) -> DataFrame:
    """``part, load``: edges dealt by hash of the source and destination; the load estimate is the smaller degree of an edge's ends."""
    d = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    e = edges.select("src", "dst").join(d.withColumnRenamed("d", "ds"), "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    return e.groupBy(F.pmod(F.xxhash64("src", "dst"), F.lit(parts)).alias("part")).agg(F.sum(F.least("ds", "dd")).alias("load"))


def round_robin(edges: DataFrame, parts: int) -> DataFrame:
    """``part, src, dst``: edges in the order of their ends, dealt in turn."""
    at = exclusive_scan(edges.select("src").groupBy("src").agg(F.count(F.lit(1)).alias("d")), "src", "d")
    place = F.col("before") + F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    return edges.select("src", "dst").join(at, "src").select(F.pmod(place, F.lit(parts)).cast("long").alias("part"), "src", "dst")


def vertex_chunks(edges: DataFrame, n: int, chunk: int, parts: int) -> DataFrame:
    """``part, src, dst``: chunks of ``chunk`` neighbouring source ids, dealt in turn."""
    return edges.select(F.pmod(F.floor(F.col("src") / chunk), F.lit(parts)).cast("long").alias("part"), "src", "dst")


def write_parts(parted: DataFrame, path: str) -> None:
    """One folder per part, so that reading one part reads no other."""
    parted.write.partitionBy("part").parquet(path)


def read_parts(spark: SparkSession, path: str, parts: list[int] | None = None) -> DataFrame:
    """``part, src, dst`` of what :func:`write_parts` wrote, from the folders of the wanted parts alone."""
    rows = spark.read.parquet(path)
    return rows if parts is None else rows.filter(F.col("part").isin(parts))
