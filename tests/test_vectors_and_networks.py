import numpy as np
import pytest
from graphs import TESTER
from pyspark.sql import functions as F

from sparkloom.functions import sets as S
from sparkloom.functions import vectors as V
from sparkloom.graph import Graph
from sparkloom.operators import factorization, gnn


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def arr(*x):
    return F.array(*[F.lit(v) for v in x])


def test_set_algebra(spark):
    a, b = arr(1, 3, 5, 7), arr(3, 4, 7, 9)
    assert one(spark, S.intersect(a, b)) == [3, 7]
    assert one(spark, S.intersect_bounded(a, b, F.lit(7))) == [3]
    assert one(spark, S.intersect_except(a, b, F.lit(3))) == [7]
    assert one(spark, S.difference(a, b, F.lit(5))) == [1]
    assert one(spark, S.difference(a, b, F.lit(0), F.lit(5))) == [1]
    assert one(spark, S.lower_bound(a, F.lit(5))) == 2
    box = lambda *p: F.array(*[F.struct(F.lit(x).alias("lo"), F.lit(y).alias("hi")) for x, y in p])
    assert one(spark, S.in_intervals(a, box((0, 4), (7, 8)))) == 3
    assert one(spark, S.intervals_overlap(box((0, 4), (6, 9)), box((2, 7)))) == 3
    assert one(spark, S.intervals_overlap(box((0, 4), (6, 9)), box((2, 7)), F.lit(3))) == 1


def test_vector_functions(spark):
    a = arr(1.0, -2.0, 3.0)
    assert one(spark, V.dot(a, a)) == 14.0
    assert one(spark, V.argmax(arr(1.0, 5.0, 5.0))) == 1
    assert one(spark, V.relu(a)) == [1.0, 0.0, 3.0]
    assert one(spark, V.leaky_relu(a)) == pytest.approx([1.0, -0.4, 3.0])
    assert one(spark, V.l2_normalized(arr(0.0, 0.0))) == [0.0, 0.0]
    p = one(spark, V.softmax(a))
    assert p == pytest.approx((np.exp([1, -2, 3]) / np.exp([1, -2, 3]).sum()).tolist())
    assert one(spark, V.cross_entropy(arr(0.0, 1.0), F.lit(0))) == pytest.approx(-np.log(1e-10))
    kept = one(spark, V.dropout(F.array_repeat(F.lit(1.0), 1000), 0.25, F.lit(1)))
    assert 650 < sum(x > 0 for x in kept) < 850 and set(kept) == {0.0, 1 / 0.75}
    assert one(spark, V.matvec(arr(1.0, 2.0), [[1, 2], [3, 4]])) == [7.0, 10.0]
    eps = 1e-6
    f = lambda x: x / np.sqrt(max((x**2).sum(), 1e-12))
    x, g = np.array([1.0, -2.0, 3.0]), np.array([0.3, 0.2, -0.5])
    numeric = [((f(x + eps * e) - f(x - eps * e)) / (2 * eps)) @ g for e in np.eye(3)]
    assert one(spark, V.d_l2_normalized(a, arr(*g.tolist()))) == pytest.approx(numeric, abs=1e-6)


@pytest.mark.parametrize("kind", ["sgd", "momentum", "nesterov", "adagrad", "rmsprop", "adam", "adamax"])
def test_optimizers_go_downhill(kind):
    opt, w = gnn.Optimizer(kind, 0.5 if kind == "adagrad" else 0.05), np.array([3.0, -2.0])
    for _ in range(300):
        w = opt.step("w", w, 2 * w)
    assert np.abs(w).max() < 0.6


def dense_graph(spark):
    g = Graph.of_edges(spark.createDataFrame(TESTER, "src long, dst long"), vertices=spark.range(8))
    a = np.zeros((8, 8))
    for x, y in TESTER:
        a[x, y] = a[y, x] = 1
    feats = np.random.default_rng(5).normal(size=(8, 3))
    h = spark.createDataFrame([(i, feats[i].tolist()) for i in range(8)], "id long, h array<double>")
    return g, a, feats, h


def matrix(df):
    return np.array([r["h"] for r in df.orderBy("id").collect()])


@pytest.mark.parametrize("arch", ["gcn", "sage", "gat"])
def test_gradients_against_numbers(spark, arch):
    g, a, feats, h = dense_graph(spark)
    labels = np.array([0, 1, 0, 1, 0, 1, 0, 1])
    lab = spark.createDataFrame([(i, int(labels[i])) for i in range(6)], "id long, label long")
    net = gnn.Network(g, [3, 2, 2], arch, seed=4)
    loops = a + np.eye(8)

    def loss(ws):
        x = feats
        for k, layer in enumerate(net.layers):
            w = ws.get((k, "w"), layer.w)
            if arch == "gcn":
                d = 1 / np.sqrt(loops.sum(1))
                out = (d[:, None] * loops * d[None, :]) @ x @ w
            elif arch == "sage":
                out = (a / a.sum(1, keepdims=True)) @ x @ w + x @ ws.get((k, "own"), layer.own)
            else:
                z = x @ w
                s = (z @ ws.get((k, "left"), layer.left))[:, None] + (z @ ws.get((k, "right"), layer.right))[None, :]
                s = np.where(loops > 0, np.where(s > 0, s, 0.2 * s), -np.inf)
                p = np.exp(s - s.max(1, keepdims=True))
                out = p / p.sum(1, keepdims=True) @ z
            x = np.maximum(out, 0) if layer.relu else out
        p = np.exp(x - x.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return -np.log(p[np.arange(6), labels[:6]]).mean()

    seen = {}
    net.opt.step = lambda key, w, grad: seen.setdefault(key, grad) is None or w
    before = {k: {n: getattr(x, n) for n in ("w", "own", "left", "right") if getattr(x, n) is not None} for k, x in enumerate(net.layers)}
    assert net.epoch(h, lab) == pytest.approx(loss({}), abs=1e-9)
    for key, grad in seen.items():
        k, name = key.split(".")
        w = before[int(k)][name]
        for at in np.ndindex(*w.shape):
            up, down = w.copy(), w.copy()
            up[at] += 1e-6
            down[at] -= 1e-6
            numeric = (loss({(int(k), name): up}) - loss({(int(k), name): down})) / 2e-6
            assert grad[at] == pytest.approx(numeric, abs=1e-6), (key, at)


def test_gated_step_and_metrics(spark):
    g, a, feats, h = dense_graph(spark)
    gates = {k: np.random.default_rng(i).normal(size=(8, 8)) for i, k in enumerate(("Wz", "Uz", "Wr", "Ur", "Wc", "Uc"))}
    sig = lambda x: 1 / (1 + np.exp(-x))
    s = a @ feats
    z, r = sig(gates["Wz"] @ s + gates["Uz"] @ feats), sig(gates["Wr"] @ s + gates["Ur"] @ feats)
    want = (1 - z) * feats + z * np.tanh(gates["Wc"] @ s + gates["Uc"] @ (r * feats))
    assert matrix(gnn.gated_step(h, g, gates)) == pytest.approx(want)
    t = spark.createDataFrame([([0.9, 0.1], [1, 1]), ([0.6, 0.7], [0, 1])], "s array<double>, y array<int>")
    assert gnn.micro_f1(t, "s", "y").first()[0] == pytest.approx(2 * 2 / (2 * 2 + 1 + 1))


def test_factorisation_lowers_the_error(spark):
    r = spark.createDataFrame([(0, 0, 5.0), (0, 1, 3.0), (1, 0, 4.0)], "src long, dst long, w double")
    first = factorization.rmse(r, factorization.factorize(r, 0, 4, step=0.01)).first()[0]
    last = factorization.rmse(r, factorization.factorize(r, 8, 4, step=0.01)).first()[0]
    assert last < first
