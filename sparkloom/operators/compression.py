"""Compressed adjacency lists: their sizes by code lengths alone, and the codes themselves with their way back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.graph import Graph
from sparkloom.session import stored


def zigzag(x: Column) -> Column:
    """Naturals for integers: ``2x``, or ``-(2x + 1)`` where negative."""
    return F.when(x >= 0, 2 * x).otherwise(-(2 * x + 1))


def _bits(x: Column) -> Column:
    """``floor(log2(x))`` of a positive integer, exactly, by its binary form."""
    return F.length(F.bin(x)) - 1


def gamma_bits(x: Column) -> Column:
    return (2 * _bits(x + 1) + 1).cast("long")


def zeta_bits(x: Column, k: int = 2) -> Column:
    """Bits of the zeta code, with whole groups of ``k`` bits."""
    return ((F.floor(_bits(x + 1) / k) + 1) * (k + 1)).cast("long")


def vbyte_bytes(x: Column) -> Column:
    """Data bytes, 1 to 4, of StreamVByte."""
    return F.when(x < 1 << 8, 1).when(x < 1 << 16, 2).when(x < 1 << 24, 3).otherwise(4).cast("long")


def gaps(g: Graph) -> DataFrame:
    """``src, first, gap``: the first neighbour as a zig-zag of its distance from the source, then the distances between neighbours."""
    w = Window.partitionBy("src").orderBy("dst")
    prev = F.lag("dst").over(w)
    return g.edges.select("src", "dst").distinct().select("src", prev.isNull().alias("first"), F.when(prev.isNull(), zigzag(F.col("dst") - F.col("src"))).otherwise(F.col("dst") - prev - 1).alias("gap"))


def code_lengths(g: Graph, k: int = 2, threshold: int = 32) -> DataFrame:
    """``scheme, bits``: total of gamma, zeta, StreamVByte on gaps (2-bit length keys included), and of the hybrid that takes StreamVByte for lists longer than ``threshold``."""
    x = F.col("gap")
    per = gaps(g).groupBy("src").agg(F.sum(gamma_bits(x)).alias("gamma"), F.sum(zeta_bits(x, k)).alias("zeta"), (8 * F.sum(vbyte_bytes(x)) + 8 * F.ceil(F.count(F.lit(1)) / 4)).alias("vbyte"), F.count(F.lit(1)).alias("deg"))
    total = per.agg(F.sum("gamma").alias("gamma"), F.sum("zeta").alias("zeta"), F.sum("vbyte").alias("vbyte"), F.sum(F.when(F.col("deg") > threshold, F.col("vbyte")).otherwise(F.col("zeta"))).alias("hybrid"))
    return total.select(F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in ("gamma", "zeta", "vbyte", "hybrid")]), F.array(*[F.col(s).cast("long") for s in ("gamma", "zeta", "vbyte", "hybrid")]))).alias("scheme", "bits"))


SCHEMES = ("gamma", "zeta", "vbyte", "hybrid")


def _bits_of(gaps: list[int], scheme: str, k: int) -> bytes:
    """Gamma or zeta codes of naturals, one after the other, the last byte filled with zeros."""
    out = []
    for x in gaps:
        n = (x + 1).bit_length() - 1
        if scheme == "gamma":
            out.append("0" * n + format(x + 1, "b"))
        else:
            h = n // k
            out.append("0" * h + "1" + format(x + 1, f"0{(h + 1) * k}b"))
    text = "".join(out)
    return int(text or "0", 2).__lshift__(-len(text) % 8).to_bytes(-(-len(text) // 8), "big")


def _gaps_of(raw: bytes, count: int, scheme: str, k: int) -> list[int]:
    text = format(int.from_bytes(raw, "big"), f"0{8 * len(raw)}b") if raw else ""
    out, at = [], 0
    for _ in range(count):
        one = text.index("1", at)
        h = one - at
        if scheme == "gamma":
            out.append(int(text[one : one + h + 1], 2) - 1)
            at = one + h + 1
        else:
            out.append(int(text[one + 1 : one + 1 + (h + 1) * k], 2) - 1)
            at = one + 1 + (h + 1) * k
    return out


def _vbyte(gaps: list[int]) -> bytes:
    """StreamVByte: two-bit lengths, four to a byte, then one to four little-endian bytes of each."""
    size = [max(1, -(-x.bit_length() // 8)) for x in gaps]
    if any(n > 4 for n in size):
        raise ValueError("StreamVByte holds numbers below 2**32")
    keys = bytes(sum((n - 1) << 2 * j for j, n in enumerate(size[i : i + 4])) for i in range(0, len(size), 4))
    return keys + b"".join(x.to_bytes(n, "little") for x, n in zip(gaps, size, strict=True))


def _unvbyte(raw: bytes, count: int) -> list[int]:
    at, out = -(-count // 4), []
    for i in range(count):
        n = (raw[i // 4] >> 2 * (i % 4) & 3) + 1
        out.append(int.from_bytes(raw[at : at + n], "little"))
        at += n
    return out


def encoded_list(src: int, nbrs: list[int], scheme: str, k: int = 2, threshold: int = 32) -> bytes:
    """The code of a sorted list of neighbours."""
    d = nbrs[0] - src if nbrs else 0
    gaps_ = [2 * d if d >= 0 else -(2 * d + 1), *[b - a - 1 for a, b in zip(nbrs, nbrs[1:], strict=False)]] if nbrs else []
    if scheme == "vbyte" or scheme == "hybrid" and len(nbrs) > threshold:
        return _vbyte(gaps_)
    return _bits_of(gaps_, "gamma" if scheme == "gamma" else "zeta", k)


def decoded_list(src: int, degree: int, raw: bytes, scheme: str, k: int = 2, threshold: int = 32) -> list[int]:
    if scheme == "vbyte" or scheme == "hybrid" and degree > threshold:
        found = _unvbyte(raw, degree)
    else:
        found = _gaps_of(raw, degree, "gamma" if scheme == "gamma" else "zeta", k)
    out: list[int] = []
    for i, x in enumerate(found):
        out.append((src + (x >> 1 if x % 2 == 0 else -(x + 1 >> 1))) if i == 0 else out[-1] + x + 1)
    return out


def encode(g: Graph, scheme: str, k: int = 2, threshold: int = 32) -> DataFrame:
    """``src, degree, code``: each vertex's neighbours as bytes; a list is one value by its nature, so a task holds one list at a time beside its batch."""
    lists = g.edges.select("src", "dst").distinct().groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [encoded_list(s, n, scheme, k, threshold) for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in b.column(1)], pa.int64()), pa.array(codes, pa.binary())], names=["src", "degree", "code"])

    return lists.select(F.col("src").cast("long"), F.col("nbrs").cast("array<long>")).mapInArrow(run, "src long, degree long, code binary")


def decode(codes: DataFrame, scheme: str, k: int = 2, threshold: int = 32) -> DataFrame:
    """``src, dst`` from what :func:`encode` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, n, raw in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([s] * n, pa.int64()), pa.array(decoded_list(s, n, raw, scheme, k, threshold), pa.int64())], names=["src", "dst"])

    return codes.select("src", "degree", "code").mapInArrow(run, "src long, dst long")


def write_compressed(g: Graph, path: str, scheme: str = "zeta") -> None:
    """The codes as a table, with the scheme in each file's rows."""
    encode(g, scheme).withColumn("scheme", F.lit(scheme)).write.parquet(path)


def read_compressed(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst`` of a graph that :func:`write_compressed` wrote."""
    codes = spark.read.parquet(path)
    first = codes.select("scheme").first()
    return decode(codes, first["scheme"] if first else "zeta")


def round_trip(g: Graph, schemes: tuple[str, ...] = SCHEMES) -> DataFrame:
    """``scheme, bytes, edges, wrong``: the size of the codes, the edges that come back, and how many do not match."""
    have = g.edges.select("src", "dst").distinct()
    out = None
    for s in schemes:
        codes = stored(encode(g, s))
        back = decode(codes, s).withColumn("n", F.lit(1)).unionByName(have.withColumn("n", F.lit(-1)))
        wrong = back.groupBy("src", "dst").agg(F.sum("n").alias("n")).agg(F.count_if(F.col("n") != 0).alias("wrong"))
        size = codes.agg(F.coalesce(F.sum(F.length("code")), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum("degree"), F.lit(0)).cast("long").alias("edges"))
        row = size.crossJoin(wrong).select(F.lit(s).alias("scheme"), "bytes", "edges", "wrong")  # one row each
        out = row if out is None else out.union(row)
    return out


def vertex_info(g: Graph, v: int, most: int = 10) -> DataFrame:
    """``degree`` and the first ``most`` neighbours of a vertex."""
    own = g.edges.filter(F.col("src") == v).select("dst").distinct()
    first = own.orderBy("dst").limit(most).agg(F.array_sort(F.collect_list("dst")).alias("first"))
    return own.agg(F.count(F.lit(1)).alias("degree")).crossJoin(first)  # one row each
