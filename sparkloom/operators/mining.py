"""Triangles and small patterns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.graph import Graph
from sparkloom.session import dropped, stored


#: Edges that one cell holds at about, edges that a task packs at once, candidates that a cell looks up at once.
CELL, PACK, LOOK = 3_000_000, 2_000_000, 262_144


def _colours(ids: np.ndarray, p: int) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % p


def _narrow(x: np.ndarray) -> tuple[int, np.ndarray]:
    """Whole numbers as the smallest and what is added to it, in 32 bits where that fits."""
    low = int(x.min())
    return (low, (x - low).astype(np.uint32)) if int(x.max()) - low < 1 << 32 else (0, x)


def _packed(p: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges as blocks by the two colours of their ends: sources as steps, both sides in 32 bits where that fits."""

    def pack(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
        a, b = _colours(src, p), _colours(dst, p)
        pair = np.minimum(a, b) * p + np.maximum(a, b)
        order = np.lexsort((src, pair))
        src, dst, pair = src[order], dst[order], pair[order]
        rows = []
        ends = np.flatnonzero(np.diff(pair, append=-1)) + 1
        for k, z in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
            s, x = _narrow(src[k:z])
            d, y = _narrow(dst[k:z])
            rows.append((int(pair[k]) // p, int(pair[k]) % p, z - k, s, np.diff(x, prepend=x.dtype.type(0)).tobytes(), d, y.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["i", "j", "n", "s", "src", "d", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for x in batches:
            if x.num_rows:
                held.append((np.asarray(x.column(0)), np.asarray(x.column(1))))
            if sum(len(h[0]) for h in held) >= PACK:
                yield pack(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
        if held:
            yield pack(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _unpacked(n: int, low: int, data: bytes, steps: bool) -> np.ndarray:
    x = np.frombuffer(data, np.uint32 if len(data) == 4 * n else np.int64).astype(np.int64)
    return (np.cumsum(x) if steps else x) + low


def _distinct(x: np.ndarray) -> np.ndarray:
    """The sorted values of ``x``, which it sorts in place: faster than hashing them."""
    x.sort()
    return x[np.diff(x, prepend=x[:1] - 1) != 0]


def _closed(src: np.ndarray, dst: np.ndarray, p: int, mixed: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct vertices of a cell and, in pieces, its triangles by their places among these; with ``mixed``, none whose vertices all share a colour.

    Edges go from the lower degree in the cell to the higher, which bounds the paths by the edges to the power 1.5. A path's
    closing edge is looked up in a table of bits first and, where a bit is set, among the sorted edges.
    """
    ids = _distinct(np.concatenate([src, dst]))
    u, v = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    order = np.argsort(np.bincount(u, minlength=len(ids)) + np.bincount(v, minlength=len(ids)), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(ids))
    u, v = rank[u], rank[v]
    ids, thirty_two = ids[order], np.int64(32)
    edge = _distinct(np.minimum(u, v) << thirty_two | np.maximum(u, v))
    del u, v, rank, order
    lo, hi = (edge >> thirty_two).astype(np.int32), (edge & np.int64(0xFFFFFFFF)).astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(np.bincount(lo, minlength=len(ids)))])
    size = max(10, min(27, (len(edge) * 32).bit_length()))

    def spots(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size)
        return (h >> np.uint64(3)).astype(np.int64), np.left_shift(1, (h & np.uint64(7)).astype(np.uint8), dtype=np.uint8)

    bits = np.zeros(1 << (size - 3), np.uint8)
    for k in range(0, len(edge), LOOK):
        np.bitwise_or.at(bits, *spots(edge[k : k + LOOK]))
    colour = _colours(ids, p) if mixed else None
    ahead = begin[hi + 1] - begin[hi]
    total = np.concatenate([[0], np.cumsum(ahead)])
    k = 0
    while k < len(edge):
        z = max(k + 1, int(np.searchsorted(total, total[k] + LOOK, "right")) - 1)
        n = ahead[k:z]
        e = np.repeat(np.arange(k, z), n)
        c = hi[np.arange(total[k], total[z]) + np.repeat(begin[hi[k:z]] - total[k:z], n)]
        k = z
        probe = lo[e].astype(np.int64) << thirty_two | c
        at, bit = spots(probe)
        keep = np.flatnonzero(bits[at] & bit)
        probe = probe[keep]
        place = np.minimum(np.searchsorted(edge, probe), len(edge) - 1)
        keep = keep[edge[place] == probe]
        a, b, c = lo[e[keep]], hi[e[keep]], c[keep]
        if mixed:
            other = (colour[a] != colour[b]) | (colour[b] != colour[c])
            a, b, c = a[other], b[other], c[other]
        yield ids, a, b, c


def _by_cells(g: Graph, schema: str, found: Callable[[Iterator], Iterator[pa.RecordBatch]], after: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """What ``found`` makes of each cell's triangles, then ``after`` of that, as one stored table per pass.

    Vertices have one of ``p`` colours by hash, and each three colours, equal ones too, make a cell with the edges among
    them, so a triangle lies whole in the cell of its colours. An edge travels ``p`` times, packed in blocks of a few bytes an
    edge, and paths of two edges are never written. The cells are dealt in passes that each send every edge about twice.
    """
    spark = g.edges.sparkSession
    edges = g.edges.filter("src < dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    m = edges.count()
    p = max(4, math.isqrt(6 * m // CELL) + 1)
    passes = -(-p * m // max(2 * m, 16 * CELL)) or 1
    blocks = stored(edges.mapInArrow(_packed(p), "i long, j long, n long, s long, src binary, d long, dst binary"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda k: F.array_sort(F.array("i", "j", k.cast("long"))))
    codes = F.transform(cells, lambda x: (x[0] * p + x[1]) * p + x[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, cell = [], [], None
        for x in batches:
            for r in x.to_pylist():
                cell = r["cell"]
                src.append(_unpacked(r["n"], r["s"], r["src"], True))
                dst.append(_unpacked(r["n"], r["d"], r["dst"], False))
        i, j, k = cell // (p * p), cell // p % p, cell % p
        a, b = np.concatenate(src), np.concatenate(dst)
        del src, dst
        yield from found(_closed(a, b, p, i != k and j in (i, k)))

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    out = []
    for t in range(passes):
        mine = F.lit(t)
        own = blocks.select(F.explode(F.filter(codes, lambda c: F.pmod(F.xxhash64(c), F.lit(passes)) == mine)).alias("cell"), "n", "s", "src", "d", "dst")  # noqa: B023
        out.append(stored(after(own.groupBy("cell").applyInArrow(run, schema))))
    dropped(spark, [blocks])
    return out


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def triangle_list(g: Graph) -> DataFrame:
    """``a < b < c``: each triangle once."""

    def found(pieces: Iterator) -> Iterator[pa.RecordBatch]:
        for ids, *corners in pieces:
            if len(corners[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.sort(np.stack([ids[x] for x in corners]), axis=0)], names=["a", "b", "c"])

    return _all(_by_cells(g, "a long, b long, c long", found, lambda x: x))


def triangle_count(g: Graph) -> DataFrame:
    def found(pieces: Iterator) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(x[1]) for x in pieces)], pa.int64())], names=["n"])

    sums = _by_cells(g, "n long", found, lambda x: x.agg(F.sum("n").alias("n")))
    return _all(sums).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("triangles"))


def triangles_per_vertex(g: Graph) -> DataFrame:
    """``id, triangles`` for all vertices."""

    def found(pieces: Iterator) -> Iterator[pa.RecordBatch]:
        ids, n = None, None
        for ids, *corners in pieces:
            n = np.zeros(len(ids), np.int64) if n is None else n
            n += np.bincount(np.concatenate(corners), minlength=len(ids))
        if n is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], names=["id", "n"])

    each = _all(_by_cells(g, "id long, n long", found, lambda x: x.groupBy("id").agg(F.sum("n").alias("n")))).groupBy("id").agg(F.sum("n").alias("triangles"))
    return g.vertices.select("id").join(each, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def wedge_count(g: Graph) -> DataFrame:
    """Paths of two edges, by the closed form over degrees."""
    return g.degrees().agg(F.coalesce(F.sum((F.col("degree") * (F.col("degree") - 1) / 2).cast("long")), F.lit(0)).alias("wedges"))


def jaccard(g: Graph) -> DataFrame:
    """``src < dst, jaccard`` for pairs with a common neighbour (an extension)."""
    e = g.edges.select("src", "dst")
    common = e.select(F.col("src").alias("m"), F.col("dst").alias("a")).join(e.select(F.col("src").alias("m"), F.col("dst").alias("b")), "m").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    d = g.degrees()
    joined = common.join(d.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    return joined.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.round(F.col("n") / (F.col("da") + F.col("db") - F.col("n")), 6).alias("jaccard"))


@dataclass
class Pattern:
    """A small query graph: edges between vertices 0 to n - 1, and labels if any."""

    edges: list[tuple[int, int]]
    labels: list[int] | None = None
    n: int = field(init=False)

    def __post_init__(self) -> None:
        self.n = max(max(e) for e in self.edges) + 1

    def has(self, a: int, b: int) -> bool:
        return (a, b) in self.edges or (b, a) in self.edges

    def add(self, a: int, b: int) -> None:
        if not self.has(a, b):
            self.edges.append((a, b))
            self.n = max(self.n, a + 1, b + 1)

    @classmethod
    def parse(cls, text: str) -> Pattern:
        """From a header ``n m ...`` and lines ``vertex label neighbour...``."""
        lines = [x.split() for x in text.strip().splitlines()]
        edges, labels = set(), {}
        for v, label, *near in lines[1:]:
            labels[int(v)] = int(label)
            edges |= {(min(int(v), int(u)), max(int(v), int(u))) for u in near}
        return cls(sorted(edges), [labels[k] for k in sorted(labels)])

    def name(self) -> str:
        degrees = tuple(sorted(sum(v in e for e in self.edges) for v in range(self.n)))
        return NAMES.get((self.n, len(self.edges), degrees), f"{self.n}-vertex pattern")

    def __str__(self) -> str:
        return ", ".join(f"{a}-{b}" if self.labels is None else f"{a}({self.labels[a]})-{b}({self.labels[b]})" for a, b in self.edges)

    def plan(self) -> list[list[tuple[str, int]]]:
        """For each vertex after the first, how it meets each earlier one: ``join`` on an edge, or ``anti`` on its absence."""
        return [[("join" if self.has(u, v) else "anti", u) for u in range(v)] for v in range(1, self.n)]

    def order(self) -> list[tuple[int, int]]:
        """Pairs ``u, v`` such that of all relabellings of an occurrence only one has ``v_u < v_v`` for each of them: every vertex is the first of those that it can trade places with while the ones before it stay."""
        group, out = self.relabellings(), []
        for u in range(self.n):
            out += [(u, v) for v in sorted({p[u] for p in group} - {u})]
            group = [p for p in group if p[u] == u]
        return out

    def relabellings(self) -> list[tuple[int, ...]]:
        """The permutations of the vertices that keep the pattern."""
        from itertools import permutations

        own = {frozenset(e) for e in self.edges}
        return [p for p in permutations(range(self.n)) if own == {frozenset((p[a], p[b])) for a, b in own} and (self.labels is None or all(self.labels[i] == self.labels[p[i]] for i in range(self.n)))]

    def automorphisms(self) -> int:
        """How many relabellings keep the pattern."""
        return len(self.relabellings())


#: Names of connected patterns by vertices, edges and sorted degrees.
NAMES = {
    (3, 2, (1, 1, 2)): "wedge", (3, 3, (2, 2, 2)): "triangle", (4, 3, (1, 1, 1, 3)): "3-star", (4, 3, (1, 1, 2, 2)): "4-path", (4, 4, (1, 2, 2, 3)): "tailed_triangle",
    (4, 4, (2, 2, 2, 2)): "square", (4, 5, (2, 2, 3, 3)): "diamond", (4, 6, (3, 3, 3, 3)): "4-clique",
}
MOTIFS = [Pattern(e) for e in ([(0, 1), (0, 2)], [(0, 1), (0, 2), (1, 2)], [(0, 1), (0, 2), (0, 3)], [(0, 1), (1, 2), (2, 3)], [(0, 1), (0, 2), (1, 2), (0, 3)], [(0, 1), (1, 2), (2, 3), (0, 3)], [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)], [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)])]


def matches(g: Graph, p: Pattern, induced: bool = True, once: bool = False) -> DataFrame:
    """``v0, v1, ...``: all embeddings of a connected pattern, by the joins and anti-joins of its plan (an extension); with ``once``, one of each occurrence, its symmetry broken while joining."""
    ahead = p.order() if once else []
    e = g.edges.select("src", "dst")
    lab = g.vertices.select("id", "label") if p.labels is not None else None
    out = g.vertices.select(F.col("id").alias("v0"))

    def labelled(df: DataFrame, v: int) -> DataFrame:
        return df if lab is None else df.join(lab.filter(F.col("label") == p.labels[v]).select(F.col("id").alias(f"v{v}")), f"v{v}", "left_semi")

    out = labelled(out, 0)
    for v, steps in enumerate(p.plan(), 1):
        joined = [u for how, u in steps if how == "join"]
        if not joined:
            raise ValueError("each vertex must meet an earlier one")
        out = out.join(e.select(F.col("src").alias(f"v{joined[0]}"), F.col("dst").alias(f"v{v}")), f"v{joined[0]}")
        for u in range(v):
            out = out.filter(F.col(f"v{u}") < F.col(f"v{v}") if (u, v) in ahead else F.col(f"v{u}") != F.col(f"v{v}"))
        for how, u in steps:
            pair = e.select(F.col("src").alias(f"v{u}"), F.col("dst").alias(f"v{v}"))
            if how == "join" and u != joined[0]:
                out = out.join(pair, [f"v{u}", f"v{v}"], "left_semi")
            elif how == "anti" and induced:
                out = out.join(pair, [f"v{u}", f"v{v}"], "left_anti")
        out = labelled(out, v)
    return out.select(*[f"v{i}" for i in range(p.n)])


def motif_counts(g: Graph, patterns: list[Pattern] | None = None, induced: bool = True) -> DataFrame:
    """``motif, n``: occurrences of each pattern, each once."""
    parts = [matches(g, p, induced, True).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p.name()).alias("motif"), "n") for p in patterns or MOTIFS[:2]]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out
