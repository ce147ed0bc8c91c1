"""Readers and writers of text graph formats, as DataFrame plans over lines.

Where a header line must be told from data, lines carry their reading order, so a single file of any size is read in
parallel. All readers give ids from 0, drop self-loops and repeats, and return edges ``src, dst[, w]``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """``i, t``: lines in reading order, trimmed, without empty and comment lines."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("i"), F.trim("value").alias("t")).filter("t <> ''")
    return rows.filter(~F.col("t").startswith(comment)) if comment else rows


def _header(lines: DataFrame) -> tuple[int, list[str]]:
    """The number and fields of the first line."""
    row = lines.agg(F.min(F.struct("i", "t")).alias("x")).first()["x"]
    if row is None:
        raise ValueError("no header line")
    return row["i"], row["t"].split()


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select("i", F.split("t", r"[\s,]+").alias("f"))


def _number(k: int, kind: str = "long") -> Column:
    return F.get("f", F.lit(k)).try_cast(kind)


def read_mtx(spark: SparkSession, path: str, bipartite: bool = False) -> tuple[DataFrame, int, int]:
    """Edges ``src, dst, w`` of a Matrix Market file, with its rows and columns.

    Symmetric files and bipartite ones give both directions; in a bipartite graph items follow the users' ids. Pattern
    files have the weight 1. Skew-symmetric files change the sign of the reverse direction.
    """
    banner = spark.read.text(path).filter(F.col("value").startswith("%%")).first()
    kind = (banner[0] if banner else "").lower().split()
    lines = _lines(spark, path, "%")
    at, (rows, columns, *_) = _header(lines)
    f = _fields(lines.filter(F.col("i") != at))
    w = F.lit(1.0) if "pattern" in kind else F.coalesce(_number(2, "double"), F.lit(1.0))
    e = f.select((_number(0) - 1).alias("src"), (_number(1) - 1).alias("dst"), w.alias("w")).filter("src IS NOT NULL AND dst IS NOT NULL")
    if bipartite:
        e = e.select("src", (F.col("dst") + int(rows)).alias("dst"), "w")
    e = e.filter("src <> dst")
    if bipartite or "symmetric" in kind or "skew-symmetric" in kind:
        back = -F.col("w") if "skew-symmetric" in kind else F.col("w")
        e = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), back.alias("w")))
    return e.groupBy("src", "dst").agg(F.min("w").alias("w")), int(rows), int(columns)


def read_edge_list(spark: SparkSession, path: str, base: int = 1, both: bool = True, comment: str = "#") -> DataFrame:
    """Edges ``src, dst, w`` of lines ``src dst [weight]`` with ids from ``base``; ``both``: in both directions. Covers SNAP-like files."""
    e = _fields(_lines(spark, path, comment)).select((_number(0) - base).alias("src"), (_number(1) - base).alias("dst"), F.coalesce(_number(2, "double"), F.lit(1.0)).alias("w")).filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    if both:
        e = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return e.groupBy("src", "dst").agg(F.min("w").alias("w"))


def read_lg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices ``id, label`` and undirected edges ``src, dst, label`` of ``t / v / e`` lines."""
    f = _fields(_lines(spark, path))
    tag = F.get("f", F.lit(0))
    v = f.filter(tag == "v").select(_number(1).alias("id"), _number(2).alias("label"))
    e = f.filter(tag == "e").select(_number(1).alias("src"), _number(2).alias("dst"), _number(3).alias("label"))
    e = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label")).filter("src <> dst")
    return v.dropDuplicates(["id"]), e.groupBy("src", "dst").agg(F.min("label").alias("label"))


def read_labelled_adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices ``id, label`` and edges ``src, dst`` of lines ``id label neighbour...``."""
    f = _fields(_lines(spark, path)).select(_number(0).alias("id"), _number(1).alias("label"), F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))).alias("n"))
    e = f.select(F.col("id").alias("src"), F.explode("n").alias("d")).select("src", F.col("d").try_cast("long").alias("dst")).filter("src <> dst").distinct()
    return f.select("id", "label"), e


def read_dimacs(spark: SparkSession, path: str) -> DataFrame:
    """Arcs ``src, dst, w`` of a shortest-path challenge file (``a src dst weight`` lines, ids from 1)."""
    f = _fields(_lines(spark, path)).filter(F.get("f", F.lit(0)) == "a")
    return f.select((_number(1) - 1).alias("src"), (_number(2) - 1).alias("dst"), _number(3, "double").alias("w")).filter("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))


def read_metis(spark: SparkSession, path: str) -> DataFrame:
    """Edges ``src, dst`` of an unweighted adjacency file: after the header, line ``k`` lists the neighbours of vertex ``k``, both from 1."""
    raw = spark.read.text(path, wholetext=False).select(F.monotonically_increasing_id().alias("i"), F.trim("value").alias("t")).filter(~F.col("t").startswith("%"))
    at, _ = _header(raw)
    from sparkloom.operators.transform import ranked_ids

    order = ranked_ids(raw.filter(F.col("i") > at).select(F.col("i").alias("id")))
    f = raw.join(order, F.col("i") == F.col("id")).select(F.col("new").alias("src"), F.explode(F.split("t", r"\s+")).alias("d"))
    return f.select("src", (F.col("d").try_cast("long") - 1).alias("dst")).filter("dst IS NOT NULL AND src <> dst").distinct()


def read_one_hot(spark: SparkSession, path: str, single: bool = True) -> DataFrame:
    """Class labels of a file with a header ``rows classes`` and a 0/1 line per vertex: ``id, label``, or ``id, labels`` if several may be set."""
    from sparkloom.operators.transform import ranked_ids

    lines = _lines(spark, path)
    at, _ = _header(lines)
    rows = lines.filter(F.col("i") > at)
    order = ranked_ids(rows.select(F.col("i").alias("id")))
    f = _fields(rows).join(order, F.col("i") == F.col("id")).select(F.col("new").alias("id"), F.transform("f", lambda x: x.cast("int")).alias("f"))
    return f.select("id", (F.array_position("f", 1) - 1).alias("label")) if single else f.select("id", F.col("f").alias("labels"))


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """``id`` of the vertices of a mask file: a header ``begin end`` and, per vertex, 0 or 1."""
    from sparkloom.operators.transform import ranked_ids

    lines = _lines(spark, path)
    at, (begin, end, *_) = _header(lines)
    rows = lines.filter(F.col("i") > at)
    order = ranked_ids(rows.select(F.col("i").alias("id")))
    return rows.join(order, F.col("i") == F.col("id")).filter((F.col("t") == "1") & F.col("new").between(int(begin), int(end) - 1)).select(F.col("new").alias("id"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """``id, feat`` of a file with a header ``rows length`` and lines ``row column value``; missing values are 0."""
    lines = _lines(spark, path)
    at, (_, length, *_) = _header(lines)
    f = _fields(lines.filter(F.col("i") != at)).select(_number(0).alias("id"), _number(1).alias("c"), _number(2, "double").alias("x"))
    held = f.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("int"), "x"))).alias("m"))
    return held.select("id", F.transform(F.sequence(F.lit(0), F.lit(int(length) - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)).cast("float")).alias("feat"))


def read_meta(spark: SparkSession, path: str, bipartite: bool = False) -> dict[str, int]:
    """The numbers of a graph's meta header by name."""
    numbers = [int(x) for r in spark.read.text(path, wholetext=True).collect() for x in r[0].split()]
    names = ["n0", "n1"] if bipartite else ["n"]
    names += ["m", "vid_size", "eid_size", "vlabel_size", "elabel_size", "max_degree", "feat_len", "vertex_classes", "edge_classes"]
    names += [f"{s}_{k}" for s in ("train", "val", "test") for k in ("begin", "end", "count")]
    return dict(zip(names, numbers, strict=False))


def write_dendrogram(rows: DataFrame, path: str) -> None:
    """``node parent weight`` lines; roots have no parent and so no line."""
    rows.select(F.concat_ws(" ", "node", "parent", "weight").alias("value")).write.text(path)


def write_edge_list(edges: DataFrame, path: str, base: int = 1) -> None:
    rest = [F.col(c).cast("string") for c in edges.columns if c not in ("src", "dst")]
    edges.select(F.concat_ws(" ", F.col("src") + base, F.col("dst") + base, *rest).alias("value")).write.text(path)
