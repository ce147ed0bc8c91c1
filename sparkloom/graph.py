"""The graph model: a table of vertices and a table of edges."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """``vertices (id, ...)`` and ``edges (src, dst[, w])``; an undirected graph stores both directions of each edge."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False

    @classmethod
    def of_edges(cls, edges: DataFrame, directed: bool = False, vertices: DataFrame | None = None) -> Graph:
        """A graph of the ends of ``edges``; one direction each, unless ``directed``, is completed to both."""
        if not directed:
            rest = [c for c in edges.columns if c not in ("src", "dst")]
            edges = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))
        if vertices is None:
            vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return cls(vertices, edges, directed)

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def degrees(self) -> DataFrame:
        """``id, degree`` by outgoing edges; vertices without edges have 0."""
        out = self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("id").join(out, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def adjacency(self) -> DataFrame:
        """``id, nbrs``: sorted neighbours; vertices without edges have none."""
        out = self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
        return self.vertices.select("id").join(out, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<long>")).alias("nbrs"))

    def max_degree(self) -> DataFrame:
        return self.degrees().agg(F.max("degree").alias("max_degree"))
