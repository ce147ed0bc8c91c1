"""Weighted rendezvous hashing: each record goes to the shard that scores highest for its key.

A shard ``s`` of weight ``w`` scores ``-w / ln(u)`` where ``u`` is the hash of ``(key, s)`` as a number in (0, 1). The
record's key and the list of shards decide alone, so one more shard takes records only into itself, in proportion to
its weight, and moves none between the others. Everything is a JVM expression on the row; no shuffle.

Null keys hash as nulls: all of them go to one and the same shard, in slots of their own. Repeated rows take a slot
each. Null texts have no bytes (CRC 0). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import stored

#: Rows of one shard that one task numbers.
ROWS_A_BUCKET = 200_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard, from 0, that ``key`` belongs to; a shard of weight 0 gets nothing."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be 0 or more, one of them more than 0")
    equal = len({w for w in weights if w > 0}) == 1
    scores = []
    for s, w in enumerate(weights):
        if w <= 0:
            continue
        h = F.xxhash64(F.lit(s), key)
        if equal:  # the logarithm keeps the order of the hashes, so they are compared as they are
            score = h
        else:
            unit = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
            score = F.lit(-float(w)) / F.log(unit)
        scores.append(F.struct(score.alias("score"), F.lit(-s).alias("s")))  # ties: the smaller number
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["s"]).cast("int")


def assign(rows: DataFrame, key: Column, weights: Sequence[float], into: str = "shard") -> DataFrame:
    """``rows`` with the shard number in the column ``into``."""
    return rows.withColumn(into, rendezvous(key, weights))


def numbered(rows: DataFrame, shard: str, order: Sequence[Column], into: str = "slot") -> DataFrame:
    """``rows`` with gapless numbers from 0 within each shard.

    No task sorts a whole shard: rows are ranked within hash buckets of bounded size, and the buckets' counts, one small
    row each, give the offsets. The counts come from the same stored rows that are numbered.
    """
    held = stored(rows)
    n = held.count()
    buckets = max(1, -(-n // ROWS_A_BUCKET))
    dealt = held.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy(F.col(shard).alias("_s"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order)) - 1
    ranked = dealt.withColumn("_rank", rank)
    # AQE broadcasts the offsets if they are small; otherwise they are joined by shuffle
    joined = ranked.join(offsets, (ranked[shard] == offsets["_s"]) & (ranked["_bucket"] == offsets["_b"]))
    return joined.withColumn(into, (F.col("_before") + F.col("_rank")).cast("long")).drop("_s", "_b", "_before", "_rank", "_bucket")


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 40, grown: float | None = 1.0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: the shard of each document by its ``doc_id``.

    ``grown``: the weight of one more shard, for ``grown_shard``.
    """
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    key = F.col("doc_id")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(key.cast("long"), weights).alias("shard"), rendezvous(key.cast("long"), [*weights, grown]).alias("grown_shard") if grown else F.lit(None).cast("int").alias("grown_shard"),
    )
    out = numbered(rows, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
