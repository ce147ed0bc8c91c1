"""Graphs projected from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.graph import Graph
from sparkloom.session import cut, table


def co_purchase(spark: SparkSession, d: str, least: int = 1) -> DataFrame:
    """``src < dst, w``: parts that share ``least`` orders or more; ``w`` is the number of orders."""
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p")).distinct()
    # an order has a handful of lines, so pairs within it stay few
    held = x.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    pairs = F.flatten(F.transform("ps", lambda a: F.transform(F.filter("ps", lambda b: b > a), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    e = held.select(F.explode(pairs).alias("e")).groupBy("e.src", "e.dst").agg(F.count(F.lit(1)).alias("w"))
    return e.filter(F.col("w") >= least) if least > 1 else e


def co_purchase_graph(spark: SparkSession, d: str, least: int = 1) -> Graph:
    return Graph.of_edges(co_purchase(spark, d, least))


def trade(spark: SparkSession, d: str) -> DataFrame:
    """``src`` customer, ``dst`` supplier, ``w`` mean quantity."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.avg("l_quantity").alias("w"))


def part_supplier(spark: SparkSession, d: str) -> DataFrame:
    """``src`` part, ``dst`` supplier, ``w`` mean quantity."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.avg("l_quantity").alias("w"))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """``src, dst, w``: users whose events follow each other, directed."""
    e = table(spark, d, "events").select("ts", "event_id", "user_id")
    # One global order: rows are range-partitioned and numbered by partition, so that only each part's edge meets the next one's
    # (stored once, as the bounds of the ranges come from a sample that may differ if they are drawn again)
    held = cut(e.repartitionByRange("ts", "event_id").withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy("ts", "event_id")
    inner = held.select("part", F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).filter("dst is not null").select("src", "dst")
    ends = held.groupBy("part").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("a"), F.max(F.struct("ts", "event_id", "user_id")).alias("z"))
    seams = ends.select(F.col("z.user_id").alias("src"), F.lead("a.user_id").over(Window.orderBy("part")).alias("dst")).filter("dst is not null")
    return inner.union(seams).filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


#: The same graphs in DuckDB's SQL, as common table expressions.
SQL = {
    "g_cp": "g_cp AS (SELECT x.l_partkey AS src, y.l_partkey AS dst, count(DISTINCT x.l_orderkey) AS w FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2)",
    "g_cp2": "g_cp2 AS (SELECT x.l_partkey AS src, y.l_partkey AS dst, count(DISTINCT x.l_orderkey) AS w FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2 HAVING count(DISTINCT x.l_orderkey) >= 2)",
    "g_trade": "g_trade AS (SELECT o_custkey AS src, l_suppkey AS dst, avg(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)",
    "g_ps": "g_ps AS (SELECT l_partkey AS src, l_suppkey AS dst, avg(l_quantity) AS w FROM lineitem GROUP BY 1, 2)",
    "g_evt": "g_evt AS (SELECT user_id AS src, nx AS dst, count(*) AS w FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NOT NULL AND nx <> user_id GROUP BY 1, 2)",
}


def both_sql(name: str) -> str:
    """Both directions of an undirected projection, as the table ``e``."""
    return f"{SQL[name]}, e AS (SELECT src, dst, w FROM {name} UNION ALL SELECT dst, src, w FROM {name})"
