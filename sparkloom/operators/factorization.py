"""Matrix factorisation of a bipartite rating table by full-batch gradient steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import vectors as V
from sparkloom.session import cut

#: Latent length, regularisation and step.
K, LAMBDA, STEP = 20, 0.001, 3.5e-7


def both_ways(ratings: DataFrame) -> DataFrame:
    """``src, dst, w`` over tagged ids: users are ``(0, id)`` and items ``(1, id)``; both directions."""
    u, i = F.struct(F.lit(0).alias("side"), F.col("src").cast("long").alias("id")), F.struct(F.lit(1).alias("side"), F.col("dst").cast("long").alias("id"))
    return ratings.select(u.alias("src"), i.alias("dst"), F.col("w").cast("double").alias("w")).union(ratings.select(i, u, F.col("w").cast("double")))


def start(edges: DataFrame, k: int = K, seed: int | None = None) -> DataFrame:
    """``id, p``: each vertex's first vector, 0.5 everywhere or hashed uniformly from a seed."""
    value = F.lit(0.5) if seed is None else None
    ids = edges.select(F.col("src").alias("id")).distinct()
    if value is not None:
        return ids.select("id", F.array_repeat(value, k).alias("p"))
    unit = lambda i: (F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(1 << 24)).cast("double") + 0.5) / (1 << 24)
    return ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), unit).alias("p"))


def _with_vectors(edges: DataFrame, state: DataFrame) -> DataFrame:
    a, b = state.select(F.col("id").alias("src"), F.col("p").alias("ps")), state.select(F.col("id").alias("dst"), F.col("p").alias("pd"))
    return edges.join(b, "dst").join(a, "src")


def factorize(ratings: DataFrame, rounds: int = 5, k: int = K, lam: float = LAMBDA, step: float = STEP, seed: int | None = None) -> DataFrame:
    """``id (side, id), p``: for every vertex ``p += step * (sum of errors times the other's vector - lam * p)``, all at once in a round."""
    edges = both_ways(ratings).repartition("src").persist()
    state = cut(start(edges, k, seed))
    for _ in range(rounds):
        e = _with_vectors(edges, state).withColumn("err", F.col("w") - V.dot(F.col("ps"), F.col("pd")))
        # one partial sum per component keeps the aggregate in generated code and combines before the shuffle
        sums = e.groupBy("src").agg(*[F.sum(F.col("err") * F.col("pd")[j]).alias(f"s{j}") for j in range(k)])
        grad = sums.select(F.col("src").alias("id"), F.array(*[F.col(f"s{j}") for j in range(k)]).alias("grad"))
        state = cut(state.join(grad, "id").select("id", F.zip_with("p", "grad", lambda p, g: p + step * (g - lam * p)).alias("p")))
    edges.unpersist()
    return state


def rmse(ratings: DataFrame, state: DataFrame) -> DataFrame:
    """``rmse`` over both directions of the ratings."""
    e = _with_vectors(both_ways(ratings), state)
    return e.agg(F.sqrt(F.avg(F.pow(F.col("w") - V.dot(F.col("ps"), F.col("pd")), 2))).alias("rmse"))
