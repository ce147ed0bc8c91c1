"""Graph neural networks: normalisation, aggregation, layers, losses, optimisers and training.

Topology and features stay tables. Aggregation is a join of edges with features and one partial sum per component;
weights are small matrices on the driver that ride along as literals in Arrow maps. Gradients of weights are sums over
vertices, computed per partition and added up, so that no task or driver holds the features of the graph.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.graph import Graph
from sparkloom.session import cut, dropped, stored

# --- normalisation and aggregation ---------------------------------------------------------------------------------


def vertex_norms(g: Graph) -> DataFrame:
    """``id, norm``: one over the root of the degree, 0 where that is 0."""
    return g.degrees().select("id", F.when(F.col("degree") > 0, 1 / F.sqrt("degree")).otherwise(0.0).alias("norm"))


def edge_norms(g: Graph) -> DataFrame:
    """``src, dst, norm``: product of both ends' norms."""
    n = vertex_norms(g)
    e = g.edges.select("src", "dst").join(n.select(F.col("id").alias("src"), F.col("norm").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("norm").alias("b")), "dst")
    return e.select("src", "dst", (F.col("a") * F.col("b")).alias("norm"))


def weighted_sum(weights: DataFrame, features: DataFrame, dim: int) -> DataFrame:
    """``id, h``: for each ``src`` the sum of ``norm`` times the features of ``dst``. ``features (id, h)``."""
    e = weights.join(features.select(F.col("id").alias("dst"), "h"), "dst")
    sums = e.groupBy("src").agg(*[F.sum(F.col("norm") * F.col("h")[j]).alias(f"s{j}") for j in range(dim)])
    out = sums.select(F.col("src").alias("id"), F.array(*[F.col(f"s{j}") for j in range(dim)]).alias("s"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return features.select("id").join(out, "id", "left").select("id", F.coalesce("s", zero).alias("h"))


def mean_weights(g: Graph, transposed: bool = False) -> DataFrame:
    """``src, dst, norm``: one over the source's degree; transposed, over the destination's."""
    d = g.degrees().filter("degree > 0").select(F.col("id").alias("dst" if transposed else "src"), (1 / F.col("degree")).alias("norm"))
    return g.edges.select("src", "dst").join(d, "dst" if transposed else "src").select("src", "dst", "norm")


def with_loops(g: Graph) -> Graph:
    """The graph with an edge from each vertex to itself."""
    loops = g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return g.with_edges(g.edges.select("src", "dst").union(loops).distinct())


def gcn_aggregate(g: Graph, features: DataFrame, dim: int) -> DataFrame:
    """Symmetrically normalised sum over neighbours, self-loops included by the caller's graph."""
    return weighted_sum(edge_norms(g), features, dim)


def sage_aggregate(g: Graph, features: DataFrame, dim: int) -> DataFrame:
    """Mean over neighbours."""
    return weighted_sum(mean_weights(g), features, dim)


def attention(g: Graph, features: DataFrame, left: list[float], right: list[float], slope: float = 0.2) -> DataFrame:
    """``src, dst, norm``: softmax over each source's edges of a leaky ReLU of ``left . h(src) + right . h(dst)``.

    The two dot products are taken once per vertex; only scalars travel along edges.
    """
    dot = lambda v: sum((F.col("h")[j] * float(x) for j, x in enumerate(v)), F.lit(0.0))
    s = features.select("id", dot(left).alias("l"), dot(right).alias("r"))
    e = g.edges.select("src", "dst").join(s.select(F.col("id").alias("src"), "l"), "src").join(s.select(F.col("id").alias("dst"), "r"), "dst")
    raw = F.col("l") + F.col("r")
    e = e.select("src", "dst", F.when(raw > 0, raw).otherwise(raw * slope).alias("s"))
    top = e.groupBy("src").agg(F.max("s").alias("top"))
    e = e.join(top, "src").select("src", "dst", F.exp(F.col("s") - F.col("top")).alias("x"))
    return e.join(e.groupBy("src").agg(F.sum("x").alias("total")), "src").select("src", "dst", (F.col("x") / F.col("total")).alias("norm"))


def gat_aggregate(g: Graph, features: DataFrame, left: list[float], right: list[float], dim: int) -> DataFrame:
    return weighted_sum(attention(g, features, left, right), features, dim)


# --- losses and metrics over tables ----------------------------------------------------------------------------------


def accuracy(rows: DataFrame, scores: str, label: str) -> DataFrame:
    """``accuracy``: share of rows whose first largest score is at their label."""
    return rows.agg(F.avg((F.array_position(scores, F.array_max(scores)) - 1 == F.col(label)).cast("double")).alias("accuracy"))


def micro_f1(rows: DataFrame, scores: str, targets: str, threshold: float = 0.5) -> DataFrame:
    """``f1`` from pooled true and false positives and false negatives."""
    each = F.zip_with(scores, targets, lambda s, t: F.struct(((s > threshold) & (t > 0)).alias("tp"), ((s > threshold) & (t <= 0)).alias("fp"), ((s <= threshold) & (t > 0)).alias("fn")))
    x = rows.select(F.explode(each).alias("x")).agg(*[F.sum(F.col(f"x.{k}").cast("long")).alias(k) for k in ("tp", "fp", "fn")])
    return x.select(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))


# --- optimisers --------------------------------------------------------------------------------------------------------


@dataclass
class Optimizer:
    """Updates of a NumPy array by the named rule; its state is kept per array key."""

    kind: str = "adam"
    lr: float = 0.01
    momentum: float = 0.9
    rho: float = 0.99
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    #: Weight decay of plain, momentum and Nesterov steps.
    decay: float = 0.0
    state: dict = field(default_factory=dict)

    def step(self, key: str, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        m, v, t = self.state.get(key, (np.zeros_like(w), np.zeros_like(w), 0))
        t += 1
        if self.kind in ("sgd", "momentum", "nesterov"):
            g = g + self.decay * w
        if self.kind == "sgd":
            d = self.lr * g
        elif self.kind in ("momentum", "nesterov"):
            m = self.momentum * m - self.lr * g
            d = -(self.momentum * m - self.lr * g) if self.kind == "nesterov" else -m
        elif self.kind == "adagrad":
            v = v + g * g
            d = self.lr * g / (np.sqrt(v) + self.eps)
        elif self.kind == "rmsprop":
            v = self.rho * v + (1 - self.rho) * g * g
            d = self.lr * g / np.sqrt(v + self.eps)
        elif self.kind == "adam":
            m, v = self.beta1 * m + (1 - self.beta1) * g, self.beta2 * v + (1 - self.beta2) * g * g
            d = self.lr * (m / (1 - self.beta1**t)) / np.sqrt(v / (1 - self.beta2**t) + self.eps)
        elif self.kind == "adamax":
            m, v = self.beta1 * m + (1 - self.beta1) * g, np.maximum(self.beta2 * v, np.abs(g))
            d = self.lr / (1 - self.beta1**t) * m / (v + self.eps)
        else:
            raise ValueError(self.kind)
        self.state[key] = (m, v, t)
        return w - d


def glorot(rows: int, columns: int, seed: int) -> np.ndarray:
    bound = np.sqrt(6 / (rows + columns))
    return np.random.default_rng(seed).uniform(-bound, bound, (rows, columns))


# --- dense steps over tables -----------------------------------------------------------------------------------------------


def _matrix(c: pa.Array) -> np.ndarray:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return np.asarray(c.flatten()).reshape(len(c), -1)


def _column(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.reshape(-1)))


def dense(rows: DataFrame, w: np.ndarray, into: str = "h") -> DataFrame:
    """``id`` and ``h`` times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), _column(_matrix(b.column(1)) @ w)], names=["id", into])

    return rows.select("id", "h").mapInArrow(run, f"id long, {into} array<double>")


def outer_sum(rows: DataFrame, a: str, b: str, shape: tuple[int, int]) -> np.ndarray:
    """The sum over rows of the outer products of two vector columns: one small matrix per task, added in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in batches:
            if x.num_rows:
                total += _matrix(x.column(0)).T @ _matrix(x.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["at", "v"])

    sums = rows.select(a, b).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(shape[0] * shape[1])
    for r in sums:
        out[r["at"]] = r["v"]
    return out.reshape(shape)


@dataclass
class Layer:
    """A graph convolution: ``arch`` is gcn, sage or gat; ReLU unless it is the last."""

    arch: str
    w: np.ndarray
    own: np.ndarray | None = None
    left: np.ndarray | None = None
    right: np.ndarray | None = None
    relu: bool = True


class Network:
    """Layers with a softmax loss over labelled vertices, trained by full-batch steps.

    ``g`` carries the edges that the architecture aggregates over (self-loops for gcn and gat are added here).
    """

    def __init__(self, g: Graph, dims: list[int], arch: str = "gcn", seed: int = 1, lr: float = 0.01, optimizer: str = "adam", dropout: float = 0.0):
        self.g = with_loops(g) if arch in ("gcn", "gat") else g
        self.arch, self.dims, self.dropout, self.seed = arch, dims, dropout, seed
        self.layers = []
        for k, (a, b) in enumerate(zip(dims, dims[1:], strict=False)):
            self.layers.append(Layer(arch, glorot(a, b, seed + k), glorot(a, b, seed + 100 + k) if arch == "sage" else None, glorot(b, 1, seed + 200 + k)[:, 0] if arch == "gat" else None, glorot(b, 1, seed + 300 + k)[:, 0] if arch == "gat" else None, k < len(dims) - 2))
        self.opt = Optimizer(optimizer, lr)
        # fixed weights are worked out once; attention changes in each pass
        self.weights = stored(edge_norms(self.g) if arch == "gcn" else mean_weights(self.g)) if arch != "gat" else None
        self.back = stored(self.weights.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "norm")) if arch != "gat" else None

    def _aggregate(self, weights: DataFrame, h: DataFrame, dim: int) -> DataFrame:
        return weighted_sum(weights, h, dim)

    def forward(self, features: DataFrame, training: bool = False, epoch: int = 0) -> list[dict]:
        """Per layer its input ``x``, the attention if any, and its output ``h``."""
        h, kept = features, []
        for k, layer in enumerate(self.layers):
            a, b = layer.w.shape
            if training and self.dropout:
                from sparkloom.functions.vectors import dropout

                h = h.select("id", dropout(F.col("h"), self.dropout, F.col("id"), F.lit(epoch), F.lit(k), seed=self.seed).alias("h"))
            z = dense(h, layer.w)
            weights = self.weights
            if layer.arch == "gat":
                z = cut(z)
                weights = cut(attention(self.g, z, layer.left.tolist(), layer.right.tolist()))
                out = self._aggregate(weights, z, b)
            elif a <= b:  # the shorter of both widths travels along edges
                out = dense(self._aggregate(weights, h, a), layer.w)
            else:
                out = self._aggregate(weights, z, b)
            if layer.own is not None:
                out = out.join(dense(h, layer.own, "o"), "id").select("id", F.zip_with("h", "o", lambda x, y: x + y).alias("h"))
            if layer.relu:
                out = out.select("id", F.transform("h", lambda x: F.greatest(x, F.lit(0.0))).alias("h"))
            out = cut(out)
            kept.append({"x": h, "z": z, "weights": weights, "h": out})
            h = out
        return kept

    @staticmethod
    def probabilities(scores: DataFrame) -> DataFrame:
        from sparkloom.functions.vectors import softmax

        return scores.select("id", softmax(F.col("h")).alias("p"))

    def loss(self, scores: DataFrame, labels: DataFrame) -> float:
        """Mean cross-entropy over ``labels (id, label)``."""
        from sparkloom.functions.vectors import cross_entropy

        return self.probabilities(scores).join(labels, "id").agg(F.avg(cross_entropy(F.col("p"), F.col("label")))).first()[0]

    def evaluate(self, features: DataFrame, labels: DataFrame) -> float:
        scores = self.forward(features)[-1]["h"]
        return accuracy(scores.join(labels, "id"), "h", "label").first()[0]

    def epoch(self, features: DataFrame, labels: DataFrame, number: int = 0) -> float:
        """One step on all labelled vertices; the loss before it."""
        passes = self.forward(features, True, number)
        n = labels.count()
        scores = passes[-1]["h"]
        loss = self.loss(scores, labels)
        p = self.probabilities(scores).join(labels, "id", "left")
        grad = p.select("id", F.when(F.col("label").isNull(), F.transform("p", lambda x: x * 0.0)).otherwise(F.transform("p", lambda x, i: (x - F.when(i == F.col("label"), 1.0).otherwise(0.0)) / n)).alias("d"))
        updates = []
        for k in range(len(self.layers) - 1, -1, -1):
            layer, p = self.layers[k], passes[k]
            a, b = layer.w.shape
            if layer.relu:
                grad = grad.join(p["h"], "id").select("id", F.zip_with("d", "h", lambda d, h: F.when(h > 0, d).otherwise(0.0)).alias("d"))
            grad = cut(grad)
            d = grad.select("id", F.col("d").alias("h"))
            if layer.arch == "gat":
                dz, dl, dr = self._attention_back(p["weights"], p["z"], d, layer, b)
                updates += [(k, "left", dl), (k, "right", dr)]
            else:
                dz = cut(self._aggregate(self.back, d, b))
            both = p["x"].join(dz.select("id", F.col("h").alias("dz")), "id")
            updates.append((k, "w", outer_sum(both, "h", "dz", (a, b))))
            if layer.own is not None:
                updates.append((k, "own", outer_sum(p["x"].join(grad, "id"), "h", "d", (a, b))))
            if k:
                down = dense(dz, layer.w.T)
                if layer.own is not None:
                    down = down.join(dense(d, layer.own.T, "o"), "id").select("id", F.zip_with("h", "o", lambda x, y: x + y).alias("h"))
                grad = down.select("id", F.col("h").alias("d"))
                if self.dropout:
                    from sparkloom.functions.vectors import d_dropout

                    grad = grad.select("id", d_dropout(F.col("d"), self.dropout, F.col("id"), F.lit(number), F.lit(k), seed=self.seed).alias("d"))
        for k, name, g in updates:
            setattr(self.layers[k], name, self.opt.step(f"{k}.{name}", getattr(self.layers[k], name), g))
        return loss

    def _attention_back(self, weights: DataFrame, z: DataFrame, d: DataFrame, layer: Layer, dim: int, slope: float = 0.2) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """Gradients of the attention's inputs and of its two vectors."""
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
        e = weights.join(z.select(F.col("id").alias("src"), F.col("h").alias("zs")), "src").join(z.select(F.col("id").alias("dst"), F.col("h").alias("zd")), "dst").join(d.select(F.col("id").alias("src"), F.col("h").alias("g")), "src")
        e = e.withColumn("da", dot(F.col("g"), F.col("zd"))).withColumn("raw", dot(F.col("zs"), lit(layer.left)) + dot(F.col("zd"), lit(layer.right)))
        e = cut(e)
        mean = e.groupBy("src").agg(F.sum(F.col("norm") * F.col("da")).alias("mean"))
        e = cut(e.join(mean, "src").withColumn("ds", F.col("norm") * (F.col("da") - F.col("mean")) * F.when(F.col("raw") > 0, 1.0).otherwise(slope)))
        one = e.select("zs", "zd", F.array("ds").alias("ds"))
        dl, dr = outer_sum(one, "zs", "ds", (dim, 1))[:, 0], outer_sum(one, "zd", "ds", (dim, 1))[:, 0]
        through = self._aggregate(weights.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "norm"), d, dim)
        out, into = e.groupBy(F.col("src").alias("id")).agg(F.sum("ds").alias("a")), e.groupBy(F.col("dst").alias("id")).agg(F.sum("ds").alias("b"))
        x = through.join(out, "id", "left").join(into, "id", "left")
        add = lambda h: F.zip_with(h, F.zip_with(lit(layer.left), lit(layer.right), lambda p, q: p * F.coalesce("a", F.lit(0.0)) + q * F.coalesce("b", F.lit(0.0))), lambda u, v: u + v)
        return cut(x.select("id", add(F.col("h")).alias("h"))), dl, dr

    def on(self, g: Graph) -> Network:
        """The same layers and optimizer over another graph: what it learns there, it learns here."""
        other = Network(g, self.dims, self.arch, self.seed, self.opt.lr, dropout=self.dropout)
        other.layers, other.opt = self.layers, self.opt
        return other

    def train_batches(self, features: DataFrame, labels: DataFrame, batches: int, members: Callable[[int], DataFrame]) -> list[float]:
        """The loss of each minibatch before its step: ``members(k)`` gives the ``id`` of the vertices of the k-th subgraph."""
        losses = []
        for k in range(batches):
            own = stored(members(k).select("id").distinct())
            labelled = labels.join(own, "id", "left_semi")
            if not labelled.isEmpty():
                losses.append(self.on(inductive(self.g, own)).epoch(features.join(own, "id", "left_semi"), labelled, k))
        return losses

    def train(self, features: DataFrame, labels: DataFrame, epochs: int) -> list[float]:
        """The loss before each epoch's step."""
        return [self.epoch(features, labels, k) for k in range(epochs)]


def inductive(g: Graph, members: DataFrame) -> Graph:
    """The graph that training may see: the masked vertices and the edges among them. Training on all of ``g`` is transductive."""
    from sparkloom.operators.transform import masked

    return Graph(g.vertices.join(members.select("id"), "id", "left_semi"), masked(g.edges.select("src", "dst"), members), g.directed)


GATES = ("Wz", "Uz", "Wr", "Ur", "Wc", "Uc")


class DrawnGates:
    """The gates that ``rng = default_rng(seed)`` and ``rng.normal(0, scale, (n, n))`` for each of ``GATES`` give, made row by row where they are needed.

    A normal number takes one word of the generator or, seldom, more, so where a row begins must be found out. Tasks draw
    through segments of the words and tell how many numbers begin in each and how far the last one reaches beyond it; where
    a number reaches beyond, a few draws show at which word both readings of the next segment agree again.
    """

    def __init__(self, seed: int, n: int, scale: float):
        self.seed, self.n, self.scale = seed, n, scale
        #: Numbers that come before known places, and these places in words.
        self.before, self.at = [0], [0]

    def _from(self, word: int) -> np.random.Generator:
        rng = np.random.default_rng(self.seed)
        rng.bit_generator.advance(word)
        return rng

    @staticmethod
    def _words(then: dict, now: dict) -> int:
        """Steps of the generator from one state to a later one, bit by bit."""
        full = (1 << 128) - 1
        x, y, plus, times, bit, out = then["state"]["state"], now["state"]["state"], then["state"]["inc"], 0x2360ED051FC65DA44385DF649FCCF645, 1, 0
        while x != y:
            if (x ^ y) & bit:
                x, out = (x * times + plus) & full, out | bit
            bit, plus, times = bit << 1, (times + 1) * plus & full, times * times & full
        return out

    @staticmethod
    def _skip(rng: np.random.Generator, k: int) -> None:
        for done in range(0, k, 1 << 18):
            rng.standard_normal(min(1 << 18, k - done))

    def _segment(self, start: int, length: int) -> tuple[int, int]:
        """Numbers that begin within ``length`` words from the word ``start``, where one begins, and the words of the last beyond them."""
        rng, count, past = self._from(start), 0, 0
        begin = rng.bit_generator.state
        step = length
        while past < length:
            step = max(1, min(step, (length - past) * 19 // 20 if length - past > 64 else 1))
            state = rng.bit_generator.state
            self._skip(rng, step)
            now = self._words(begin, rng.bit_generator.state)
            if now > length and step > 1:  # some number before the last may have passed the end
                rng.bit_generator.state, step = state, step // 2
            else:
                past, count, step = now, count + step, length
        return count, past - length

    def _again(self, start: int, over: int, length: int, count: int, beyond: int) -> tuple[int, int]:
        """``count`` and ``beyond`` of a segment as read from ``over`` words later."""
        rngs, place, drawn = [self._from(start), self._from(start + over)], [0, over], [0, 0]
        while place[0] != place[1] and min(place) < length:
            k = place.index(min(place))
            state = rngs[k].bit_generator.state
            self._skip(rngs[k], 1)
            place[k] += self._words(state, rngs[k].bit_generator.state)
            drawn[k] += 1
        return (count - drawn[0] + drawn[1], beyond) if place[0] == place[1] else (drawn[1], place[1] - length)

    def located(self, spark: SparkSession, tasks: int, least: int = 1 << 20) -> DrawnGates:
        """Itself, with a known place in every stretch of numbers, ``least`` long or a sixteenth of a task's share."""
        total = len(GATES) * self.n * self.n
        length = max(least, total // (16 * tasks))
        if total <= length:
            return self
        parts = -(-total * 21 // (20 * length))  # 1.02 words for a number; what lies beyond is drawn from the last place

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for k in x.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (k, *self._segment(k * length, length))], names=["k", "count", "beyond"])

        found = {r["k"]: (r["count"], r["beyond"]) for r in spark.range(0, parts, 1, min(parts, 8 * tasks)).mapInArrow(run, "k long, count long, beyond long").collect()}
        before, at, total, over = [], [], 0, 0
        for k in range(parts):
            before.append(total)
            at.append(k * length + over)
            count, beyond = self._again(k * length, over, length, *found[k]) if over else found[k]
            total, over = total + count, beyond
        self.before, self.at = before, at
        return self

    def rows(self, name: str, low: int, high: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """The rows from ``low`` to before ``high`` of a gate, at most ``most`` at once, each time after the number of the first."""
        first = (GATES.index(name) * self.n + low) * self.n
        k = bisect.bisect_right(self.before, first) - 1
        rng = self._from(self.at[k])
        self._skip(rng, first - self.before[k])
        for r in range(low, high, most):
            yield r, rng.normal(0, self.scale, (min(most, high - r), self.n))


def gated_layer(features: DataFrame, w: np.ndarray, g: Graph, gates: dict[str, np.ndarray] | DrawnGates) -> DataFrame:
    """A gated layer: the projection by ``w``, then one gated update."""
    return gated_step(dense(features, w), g, gates)


def gated_step(features: DataFrame, g: Graph, gates: dict[str, np.ndarray] | DrawnGates) -> DataFrame:
    """One gated recurrent update with ``n x n`` gates that mix vertices (by ascending ids): ``gates`` has Wz, Uz, Wr, Ur, Wc, Uc.

    Gates are multiplied by strips of rows, a task for some of the strips; each task holds the features of all vertices,
    which are small beside the gates. Gates given as arrays travel to the tasks; drawn ones are made there and never whole.
    """
    spark = features.sparkSession
    dim = len(features.first()["h"])
    ones = g.edges.select("src", "dst", F.lit(1.0).alias("norm"))
    rows = stored(features.select("id", "h").join(weighted_sum(ones, features, dim).withColumnRenamed("h", "a"), "id"))
    n = rows.count()
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, n * n >> 16))
    if isinstance(gates, DrawnGates):
        gates.located(spark, tasks)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def times(name: str, x: np.ndarray, low: int, high: int) -> np.ndarray:
        most = max(1, (1 << 21) // n)
        strips = gates.rows(name, low, high, most) if isinstance(gates, DrawnGates) else [(low, gates[name][low:high])]
        out = np.empty((high - low, x.shape[1]))
        for r, w in strips:
            out[r - low : r - low + len(w)] = w @ x
        return out

    def share(key: tuple, table: pa.Table) -> tuple[pa.Table, int, int]:
        part = key[0].as_py()
        return table.sort_by("id"), n * part // tasks, n * (part + 1) // tasks

    def first(key: tuple, table: pa.Table) -> pa.Table:
        table, low, high = share(key, table)
        h, a = _matrix(table.column("h")), _matrix(table.column("a"))
        z = sig(times("Wz", a, low, high) + times("Uz", h, low, high))
        r = sig(times("Wr", a, low, high) + times("Ur", h, low, high))
        own = h[low:high]
        return pa.table([table.column("id")[low:high], *(_column(x) for x in (own, z, r * own, times("Wc", a, low, high)))], names=["id", "h", "z", "x", "c"])

    def second(key: tuple, table: pa.Table) -> pa.Table:
        table, low, high = share(key, table)
        return pa.table([table.column("id")[low:high], _column(times("Uc", _matrix(table.column("x")), low, high))], names=["id", "u"])

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h, z, c, u = (_matrix(b.column(k)) for k in range(1, 5))
                yield pa.RecordBatch.from_arrays([b.column(0), _column((1 - z) * h + z * np.tanh(c + u))], names=["id", "h"])

    parts = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("part")
    half = stored(rows.select("id", "h", "a", parts).groupBy("part").applyInArrow(first, "id long, h array<double>, z array<double>, x array<double>, c array<double>"))
    rest = half.select("id", "x", parts).groupBy("part").applyInArrow(second, "id long, u array<double>")
    out = stored(half.select("id", "h", "z", "c").join(rest, "id").select("id", "h", "z", "c", "u").mapInArrow(mixed, "id long, h array<double>"))
    dropped(spark, [rows, half])
    return out


def l2_layer(rows: DataFrame, column: str = "h") -> DataFrame:
    from sparkloom.functions.vectors import l2_normalized

    return rows.select("id", l2_normalized(F.col(column)).alias("h"))


def components_of(vector: str, into: str = "value") -> list[Column]:
    """``pos`` and the component, for results by component."""
    return [F.posexplode(vector).alias("pos", into)]
