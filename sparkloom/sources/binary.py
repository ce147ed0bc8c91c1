"""Readers and writers of binary graph formats.

Files are read through Spark's own readers, so they may lie in any store it knows. Fixed-size records are read in
parallel chunks; only headers come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.text import read_meta


def _values(spark: SparkSession, path: str, dtype: str, name: str) -> DataFrame:
    """``at, <name>``: the numbers of a raw file by position. Files are taken whole, one task each (2 GB at most)."""
    size = np.dtype(dtype).itemsize
    out = pa.float64() if np.dtype(dtype).kind == "f" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                raw = np.frombuffer(x.as_buffer(), dtype)
                for a in range(0, len(raw), 1 << 16):
                    part = raw[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part), dtype=np.int64)), pa.array(part.astype(np.float64 if np.dtype(dtype).kind == "f" else np.int64), out)], names=["at", name])

    assert size
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"at long, {name} {'double' if out == pa.float64() else 'long'}")


def _rows_to_edges(spark: SparkSession, vertex: str, edge: str) -> DataFrame:
    """``at, src, dst`` from row offsets and column numbers: each edge's row is the last offset not past it, found by ranges."""

    def spans(rows: DataFrame) -> DataFrame:
        nxt = rows.select((F.col("at") - 1).alias("at"), F.col("v").alias("end"))
        return rows.join(nxt, "at").filter("v < end").select(F.col("at").alias("src"), F.explode(F.sequence(F.col("v"), F.col("end") - 1)).alias("at"))

    return spans(_values(spark, vertex, "<i8", "v")).join(_values(spark, edge, "<u4", "dst"), "at").select("at", "src", "dst")


def read_csr(spark: SparkSession, prefix: str, labels: bool = False, edge_labels: bool = False) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Vertices ``id[, label]``, edges ``src, dst[, w]`` and the meta header of ``prefix.{meta.txt,vertex.bin,edge.bin,...}``."""
    meta = read_meta(spark, f"{prefix}.meta.txt")
    e = _rows_to_edges(spark, f"{prefix}.vertex.bin", f"{prefix}.edge.bin")
    if edge_labels:
        e = e.join(_values(spark, f"{prefix}.elabel.bin", "<i4", "w"), "at")
    v = spark.range(meta["n"]).select("id")
    if labels:
        v = v.join(_values(spark, f"{prefix}.vlabel.bin", "u1", "label").withColumnRenamed("at", "id"), "id")
    return v, e.drop("at"), meta


def seeded_labels(vertices: DataFrame, classes: int, seed: int = 1) -> DataFrame:
    """Labels from a seeded hash of the id, for graphs without a label file; asked for, never silent."""
    return vertices.select("id", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(classes)).alias("label"))


def read_features(spark: SparkSession, path: str, length: int) -> DataFrame:
    """``id, feat`` of raw 32-bit floats, row by row."""
    x = _values(spark, path, "<f4", "x")
    rows = x.groupBy(F.floor(F.col("at") / length).cast("long").alias("id")).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"))
    return rows.select("id", F.transform("xs", lambda s: s["x"].cast("float")).alias("feat"))


def read_gr(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices ``id`` and edges ``src, dst[, w]`` of a version 1 GR file: sizes, end offsets, destinations, edge data of 4 bytes if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                raw = x.as_buffer()
                version, width, n, m = (int(v) for v in np.frombuffer(raw, "<u8", 4))
                if version != 1 or width not in (0, 4):
                    raise ValueError(f"version {version} with edge data of {width} bytes is not supported")
                ends = np.frombuffer(raw, "<u8", n, 32).astype(np.int64)
                dst = np.frombuffer(raw, "<u4", m, 32 + 8 * n)
                data = np.frombuffer(raw, "<i4", m, 32 + 8 * n + 4 * (m + m % 2)) if width else np.ones(m, np.int32)
                src = np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
                for a in range(0, m, 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(src[a : a + (1 << 16)]), pa.array(dst[a : a + (1 << 16)].astype(np.int64)), pa.array(data[a : a + (1 << 16)].astype(np.int64))], names=["src", "dst", "w"])

    e = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "src long, dst long, w long")

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(x.as_buffer(), "<u8", 4)[2]) for x in b.column(0)], pa.int64())], names=["n"])

    n = spark.read.format("binaryFile").load(path).select("content").mapInArrow(size, "n long").first()["n"]
    return spark.range(n).select("id"), e


def write_csr(vertices: DataFrame, edges: DataFrame, prefix: str, label: str | None = None, weight: str | None = None) -> dict[str, int]:
    """Export to ``prefix.{meta.txt,vertex.bin,edge.bin[,vlabel.bin][,elabel.bin]}`` on a local disk; ids must be dense from 0.

    Rows reach the driver one partition at a time, in order, and go straight to the files.
    """
    n = vertices.count()
    cols = ["src", "dst", *([weight] if weight else [])]
    ordered = edges.select(*cols).repartitionByRange("src").sortWithinPartitions("src", "dst")
    offsets = np.zeros(n + 1, np.int64)
    m = 0
    with open(f"{prefix}.edge.bin", "wb") as out, open(f"{prefix}.elabel.bin" if weight else "/dev/null", "wb") as marks:
        held: list = []

        def flush() -> None:
            if held:
                a = np.array(held, np.int64)
                np.add.at(offsets, a[:, 0] + 1, 1)
                out.write(a[:, 1].astype("<u4").tobytes())
                if weight:
                    marks.write(a[:, 2].astype("<i4").tobytes())
                held.clear()

        for row in ordered.toLocalIterator(prefetchPartitions=True):
            held.append(tuple(row))
            m += 1
            if len(held) >= 100_000:
                flush()
        flush()
    degree = int(offsets.max(initial=0))
    np.cumsum(offsets).astype("<i8").tofile(f"{prefix}.vertex.bin")
    classes = edge_classes = 0
    if label:
        values = np.array([r[0] for r in vertices.orderBy("id").select(label).toLocalIterator()], np.uint8)
        values.tofile(f"{prefix}.vlabel.bin")
        classes = int(values.max(initial=0)) + 1
    if weight:
        edge_classes = (edges.agg(F.max(weight)).first()[0] or 0) + 1
    meta = [n, m, "4 8 1 4", degree, 0, classes, int(edge_classes)]
    with open(f"{prefix}.meta.txt", "w") as f:
        f.write("\n".join(map(str, meta)) + "\n")
    return {"n": n, "m": m, "max_degree": degree}
