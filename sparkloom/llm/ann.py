"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors are one node of a graph, which carries the few smallest ids of its copies that an answer can need, so
copies in any number cost nothing. Nodes are dealt to shards by the hash of the vector, whose size grows with the root
of the number of rows, from SHARD_ROWS on; each shard builds its graph on its own, as flat arrays (a fixed number of
neighbour places per node and level), and is one row of the index table. Queries go to every shard as packed blocks of
bounded bytes; each shard answers with its nearest, the distances recomputed in double precision on the original
vectors, and the merge keeps the best of all shards. Graphs are walked in single precision; a query or a shard with a
component beyond LARGE, whose squares single precision cannot hold, is compared row by row in double precision instead
(distances beyond that precision are infinite, and tie).

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without id. Rows
that repeat an id count once, with the smallest of their vectors. Vectors are only compared within one dimension. Ties
go to the smaller id. Fewer candidates than asked for give fewer rows; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import stored

#: Nodes of the smallest shards, rows from which shards grow, bytes of queries that one search task holds.
SHARD_ROWS, GROWING, BLOCK = 2_500, 100_000, 64 << 20
#: Components up to here are walked in single precision.
LARGE = 1e15
#: Neighbours of a node on upper levels (twice as many on the lowest), and the breadth of the search when building and when asking.
LINKS, BUILD, ASK = 12, 48, 80


class SmallWorld:
    """A navigable small-world hierarchy in flat arrays: ``near[level]`` has a row of neighbour places per node of that level, -1 where free."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, near: list[np.ndarray], row: list[np.ndarray]):
        self.v, self.levels, self.near, self.row = vectors, levels, near, row
        self.stamp, self.now = np.zeros(len(vectors), np.int32), 0
        self.entry = int(np.argmax(levels)) if len(levels) else -1

    @staticmethod
    def draw_levels(n: int) -> np.ndarray:
        """Node levels, from a fixed seed: geometric, so that each level has 1 / LINKS of the one below."""
        u = np.random.Generator(np.random.PCG64(n)).random(n)
        return np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(np.int64)

    @classmethod
    def build(cls, vectors: np.ndarray) -> SmallWorld:
        n = len(vectors)
        levels = cls.draw_levels(n)
        row, near = [], []
        for level in range(int(levels.max(initial=0)) + 1):
            have = np.flatnonzero(levels >= level)
            place = np.full(n, -1, np.int32)
            place[have] = np.arange(len(have))
            row.append(place)
            near.append(np.full((len(have), 2 * LINKS if level == 0 else LINKS), -1, np.int32))
        g = cls(vectors.astype(np.float32), levels, near, row)
        g.entry = 0
        for i in range(1, n):
            g._insert(i)
        return g

    def _distances(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = self.v[at] - q
        return np.einsum("ij,ij->i", d, d)

    def _search(self, q: np.ndarray, start: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        """The nearest nodes found from ``start``, nearest first."""
        self.now += 1
        stamp, now, near, row = self.stamp, self.now, self.near[level], self.row[level]
        stamp[[i for _, i in start]] = now
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        while todo:
            d, c = heapq.heappop(todo)
            if len(best) >= breadth and d > -best[0][0]:
                break
            nb = near[row[c]]
            nb = nb[nb >= 0]
            nb = nb[stamp[nb] != now]
            if not len(nb):
                continue
            stamp[nb] = now
            ds = self._distances(q, nb)
            if len(best) >= breadth:
                ok = ds < -best[0][0]
                nb, ds = nb[ok], ds[ok]
            for x, i in zip(ds.tolist(), nb.tolist(), strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (-x, i))
                    heapq.heappush(todo, (x, i))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, i))
                    heapq.heappush(todo, (x, i))
        return sorted((-d, i) for d, i in best)

    def _chosen(self, d: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
        """Of candidates, nearest first, those that are nearer to the node than to any already chosen; then the nearest of the rest."""
        if len(at) <= most:
            return at
        x = self.v[at]
        sq = np.einsum("ij,ij->i", x, x)
        between = sq[:, None] + sq[None, :] - 2 * (x @ x.T)
        alive = np.ones(len(at), bool)
        picked: list[int] = []
        while len(picked) < most:
            k = int(np.argmax(alive))
            if not alive[k]:
                break
            picked.append(k)
            alive[k] = False
            alive &= between[k] >= d
        if len(picked) < most:
            rest = np.ones(len(at), bool)
            rest[picked] = False
            picked += np.flatnonzero(rest)[: most - len(picked)].tolist()
        return at[picked]

    def _insert(self, i: int) -> None:
        q, level = self.v[i], int(self.levels[i])
        top = int(self.levels[self.entry])
        found = [(float(self._distances(q, np.array([self.entry]))[0]), self.entry)]
        for h in range(top, level, -1):
            found = self._search(q, found[:1], 1, h)
        for h in range(min(top, level), -1, -1):
            found = self._search(q, found, BUILD, h)
            near, row = self.near[h], self.row[h]
            d, at = np.array([x for x, _ in found], np.float32), np.array([x for _, x in found], np.int32)
            mine = self._chosen(d, at, LINKS)
            near[row[i], : len(mine)] = mine
            for j in mine.tolist():
                own = near[row[j]]
                free = int(np.count_nonzero(own >= 0))
                if free < len(own):
                    own[free] = i
                else:
                    many = np.append(own, np.int32(i))
                    ds = self._distances(self.v[j], many)
                    order = np.argsort(ds, kind="stable")
                    keep = self._chosen(ds[order], many[order], len(own))
                    own[:] = -1
                    own[: len(keep)] = keep
        if level > top:
            self.entry = i

    def ask(self, q: np.ndarray, k: int) -> list[int]:
        """About the ``k`` nearest nodes, nearest first."""
        if not len(self.v):
            return []
        found = [(float(self._distances(q, np.array([self.entry]))[0]), self.entry)]
        for h in range(int(self.levels[self.entry]), 0, -1):
            found = self._search(q, found[:1], 1, h)
        return [i for _, i in self._search(q, found, max(ASK, k), 0)[:k]]


def valid(vector: Column) -> Column:
    """Whether a vector takes part."""
    big = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(vector, lambda x: x != 0)


_INDEX = "shard int, dim int, n int, vectors binary, ids binary, ends binary, levels binary, near array<binary>"


def build_index(vectors: DataFrame, k: int = 10, shard_rows: int | None = None) -> DataFrame:
    """The index of ``vec_id, embedding``: a row per shard and dimension, with its vectors, ids and flat neighbour arrays."""
    one = vectors.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
    n = vectors.count()
    shards = max(1, -(-n // (shard_rows or int(SHARD_ROWS * max(1.0, n / GROWING) ** 0.5))))
    # an answer leaves out at most the query's own id, so k + 1 ids of equal vectors are enough
    first = one.withColumn("_k", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("_k") <= k + 1)
    nodes = first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    dealt = nodes.select(F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), F.size("embedding").alias("dim"), "embedding", "ids")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        table = table.sort_by([("first", "ascending")])
        v = np.asarray(table.column("embedding").combine_chunks().flatten()).reshape(-1, dim)
        ids = table.column("ids").combine_chunks()
        g = SmallWorld.build(v if np.abs(v).max(initial=0) <= LARGE else np.zeros_like(v))
        values = [[key[0].as_py()], [dim], [len(v)], [v.tobytes()], [np.asarray(ids.flatten()).astype(np.int64).tobytes()], [np.cumsum(np.asarray(ids.value_lengths())).astype(np.int32).tobytes()], [g.levels.astype(np.int32).tobytes()], [[x.tobytes() for x in g.near]]]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
        return pa.table([pa.array(x, t) for x, t in zip(values, types, strict=True)], names=["shard", "dim", "n", "vectors", "ids", "ends", "levels", "near"])

    return dealt.withColumn("first", F.col("ids")[0]).groupBy("shard", "dim").applyInArrow(build, _INDEX)


def load(row: dict) -> tuple[SmallWorld, np.ndarray, np.ndarray, np.ndarray]:
    """The graph of an index row, its vectors in double precision, its ids, and where each node's ids end."""
    n, dim = row["n"], row["dim"]
    v = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
    levels = np.frombuffer(row["levels"], np.int32).astype(np.int64)
    near, places = [], []
    for level, raw in enumerate(row["near"]):
        near.append(np.frombuffer(raw, np.int32).reshape(-1, 2 * LINKS if level == 0 else LINKS))
        place = np.full(n, -1, np.int32)
        have = np.flatnonzero(levels >= level)
        place[have] = np.arange(len(have))
        places.append(place)
    g = SmallWorld(v.astype(np.float32), levels, near, places)
    return g, v, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int32)


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for each of ``queries`` (``vec_id, embedding``), its own id aside."""
    asked = queries.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).groupBy(F.col("vec_id").cast("long").alias("query_id")).agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
    last, widest = index.agg(F.max("shard"), F.max("dim")).first()
    groups = max(1, -(-queries.count() * 8 * (widest or 1) // BLOCK))

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        values = [[key[0].as_py()], [key[1].as_py()], [rows.column("query_id").to_numpy().astype(np.int64).tobytes()], [np.asarray(rows.column("embedding").combine_chunks().flatten()).tobytes()]]
        return pa.table([pa.array(x, t) for x, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "dim", "asked", "points"])

    dealt = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("part"), F.size("embedding").alias("dim"), "query_id", "embedding")
    blocks = stored(dealt.groupBy("part", "dim").applyInArrow(block, "part int, dim int, asked binary, points binary"))
    # every block of queries meets every shard: rows here are blocks and shards, not queries
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last or 0))))
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def answer(key: tuple, shard: pa.Table, wanted: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        for row in shard.to_pylist() if wanted.num_rows else []:
            g, v, ids, ends = load(row)
            large = np.abs(v).max(initial=0) > LARGE
            for b in range(wanted.num_rows):
                names = np.frombuffer(wanted.column("asked")[b].as_buffer(), np.int64)
                q = np.frombuffer(wanted.column("points")[b].as_buffer(), np.float64).reshape(len(names), row["dim"])
                for own, x in zip(names.tolist(), q, strict=True):
                    with np.errstate(over="ignore"):
                        if large or np.abs(x).max(initial=0) > LARGE:
                            at = np.argsort(((v - x) ** 2).sum(axis=1), kind="stable")[: k + 1].tolist()
                        else:
                            at = g.ask(x.astype(np.float32), k + 1)
                        score = np.sqrt(((v[at] - x) ** 2).sum(axis=1)).tolist()
                    pairs = sorted((s, int(i)) for s, node in zip(score, at, strict=True) for i in ids[ends[node - 1] if node else 0 : ends[node]] if i != own)[:k]
                    out[0].extend([own] * len(pairs))
                    out[1].extend(i for _, i in pairs)
                    out[2].extend(s for s, _ in pairs)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    by = ["shard", "dim", "part"]
    found = copies.groupBy(*by).cogroup(blocks.groupBy(*by)).applyInArrow(answer, "query_id long, vec_id long, score double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The neighbours of each row whose ``vec_id`` is divisible by ``every``, among all rows."""
    index = stored(build_index(vectors, k))
    return search(index, vectors.filter(F.col("vec_id") % every == 0), k)
