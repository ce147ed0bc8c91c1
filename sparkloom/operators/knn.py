"""Exact nearest neighbours of stated queries, and the neighbour graph of a vector table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries that one task compares.
PART, GROUP = 8_192, 1_024


def top_k(vectors: DataFrame, queries: DataFrame, k: int, measure: str = "cosine") -> DataFrame:
    """``q, id, rank, score`` among ``vectors (id, v)`` for each of ``queries (q, v)``, ties to smaller ids; a query's own id is left out.

    Both sides are dealt by hash into pieces of bounded size, each two of which meet in one task that keeps k per query.
    """
    parts, groups = (max(1, -(-t.count() // n)) for t, n in ((vectors, PART), (queries, GROUP)))
    left = vectors.select("id", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"))
    right = queries.select("q", F.col("v").cast("array<double>").alias("qv"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.pmod(F.xxhash64("q"), F.lit(groups)).alias("grp"))

    def compare(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            ids, v = a.column("id").to_numpy(), np.stack(a.column("v").to_numpy(zero_copy_only=False))
            qs, qv = b.column("q").to_numpy(), np.stack(b.column("qv").to_numpy(zero_copy_only=False))
            if measure == "cosine":
                norms = np.linalg.norm(qv, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
                score = np.divide(qv @ v.T, norms, out=np.zeros_like(norms), where=norms > 0)
            for i, q in enumerate(qs):
                s = np.round(score[i] if measure == "cosine" else -np.sqrt(((v - qv[i]) ** 2).sum(axis=1)), 6)
                at = np.lexsort((ids, -s))
                at = at[ids[at] != q][:k]
                out[0].extend([q] * len(at))
                out[1].extend(ids[at])
                out[2].extend(s[at])
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["q", "id", "score"])

    found = left.groupBy("part", "grp").cogroup(right.groupBy("part", "grp")).applyInArrow(compare, "q long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("q", "id", F.col("rank").cast("long").alias("rank"), "score")


def knn_edges(vectors: DataFrame, k: int = 5) -> DataFrame:
    """``src, dst``: symmetric edges between each vector and its nearest by cosine."""
    near = top_k(vectors, vectors.select(F.col("id").alias("q"), "v"), k).select(F.col("q").alias("src"), F.col("id").alias("dst"))
    return near.union(near.select("dst", "src")).distinct()
