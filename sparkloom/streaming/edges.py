"""Streams of edges: running degrees, windowed counts with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str = "src long, dst long, ts timestamp") -> DataFrame:
    """A stream of Parquet files of edges."""
    return spark.readStream.schema(schema).parquet(path)


def running_degrees(edges: DataFrame) -> DataFrame:
    """``id, degree`` so far, both ends counted; complete or update mode."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def windowed_edges(edges: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, n, vertices``: edges and (approximately) distinct sources per window; state older than ``late`` is dropped."""
    w = edges.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("src").alias("vertices"))
    return w.select(F.col("window.start").alias("start"), "n", "vertices")


def distinct_edges(edges: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each edge once within the watermark."""
    return edges.withWatermark("ts", late).dropDuplicatesWithinWatermark(["src", "dst"])
