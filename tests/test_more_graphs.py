"""Communities, codecs, clustering by size, symmetry of patterns, loops, dropout and minibatches."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.graph import Graph
from sparkloom.operators import clustering, community, components, compression, gnn, mining, spanning, traversal
from sparkloom.session import cut


def graph(spark, pairs, directed=False):
    return Graph.of_edges(spark.createDataFrame(pairs, "src long, dst long"), directed=directed)


def test_components_of_an_ascending_path_take_few_rounds(spark, monkeypatch):
    n, rounds = 20_000, []
    rank = components._rank
    monkeypatch.setattr(components, "_rank", lambda k, x: (rounds.append(k), rank(k, x))[1])
    path = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = components.component_labels(path, finish=2_000)
    assert got.agg(F.count(F.lit(1)), F.max("component")).first()[:2] == (n, 0) and max(rounds) <= 20


def test_components_with_and_without_the_last_task(spark):
    r = random.Random(4)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    a, b = ({tuple(x) for x in components.component_labels(df, finish=f).collect()} for f in (0, 10**6))
    top = list(range(200))

    def find(x):
        return x if top[x] == x else find(top[x])

    for x, y in pairs[:-1]:
        top[max(find(x), find(y))] = min(find(x), find(y))
    assert a == b == {(x, find(x)) for x in {v for p in pairs[:-2] if p[0] != p[1] for v in p}}


def test_stored_estimates_stay_bounded_over_joined_rounds(spark):
    df = spark.range(50).withColumn("v", F.col("id"))
    for _ in range(30):
        df = cut(df.join(df.select("id", F.col("v").alias("w")), "id").select("id", (F.col("v") + F.col("w") * 0).alias("v")))
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < 10**6 and df.count() == 50


def test_forests_with_and_without_the_last_task(spark):
    r = random.Random(2)
    e = spark.createDataFrame([(r.randrange(40), r.randrange(40), r.randrange(5)) for _ in range(200)], "src long, dst long, w long")
    assert {tuple(x) for x in spanning.spanning_forest(e, 0).collect()} == {tuple(x) for x in spanning.spanning_forest(e).collect()}


def test_distances_have_no_cap(spark):
    n = 40
    got = {x["id"]: x["dist"] for x in traversal.bfs(graph(spark, [(i, i + 1) for i in range(n)]), 0).collect()}
    assert got == {i: i for i in range(n + 1)}


def test_strong_components_against_reachability(spark):
    r = random.Random(3)
    for edges in ([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5)], [(r.randrange(25), r.randrange(25)) for _ in range(45)]):
        nodes = {v for e in edges for v in e}
        reach = {v: {v} for v in nodes}
        for _ in nodes:
            for a, b in edges:
                for v in nodes:
                    if a in reach[v]:
                        reach[v].add(b)
        want = {v: min(u for u in nodes if u in reach[v] and v in reach[u]) for v in nodes}
        assert {x["id"]: x["component"] for x in community.strongly_connected(graph(spark, edges, True)).collect()} == want


def test_louvain_finds_cliques_and_gains_modularity(spark):
    pairs = [(a + 10 * c, b + 10 * c) for c in range(4) for a, b in itertools.combinations(range(6), 2)] + [(0, 10), (10, 20), (20, 30)]
    g = graph(spark, pairs)
    for finish in (0, 10**6):
        got = community.louvain(g.edges, finish=finish)
        assert {x["id"]: x["community"] for x in got.collect()} == {a + 10 * c: 10 * c for c in range(4) for a in range(6)}
        assert community.modularity(g.edges, got).first()[0] > 0.6


def test_codes_come_back(spark):
    r = random.Random(6)
    lists = [sorted(r.sample(range(70_000), r.choice((1, 2, 5, 40)))) for _ in range(60)] + [[0], [5, 6, 7], [2**31]]
    for s in compression.SCHEMES:
        for i, n in enumerate(lists):
            assert compression.decoded_list(i * 900, len(n), compression.encoded_list(i * 900, n, s), s) == n
    assert compression.decoded_list(3, 0, compression.encoded_list(3, [], "gamma"), "gamma") == []


def test_compressed_graphs_are_read_back(spark, tmp_path):
    g = graph(spark, [(0, 1), (0, 70), (3, 900), (70, 3)])
    compression.write_compressed(g, f"file://{tmp_path}/g", "vbyte")
    assert {tuple(x) for x in compression.read_compressed(spark, f"file://{tmp_path}/g").collect()} == {tuple(x) for x in g.edges.collect()}
    assert tuple(compression.vertex_info(g, 0).first()) == (2, [1, 70])


def test_average_linkage_against_all_pairs():
    r = random.Random(9)
    edges = [(a, b, float(r.randint(1, 9))) for a, b in itertools.combinations(range(9), 2) if r.random() < 0.6]
    w = {frozenset((a, b)): x for a, b, x in edges}
    groups = {i: {i} for e in edges for i in e[:2]}
    got = list(clustering.merges(edges, "average"))
    for k, (a, b, x) in enumerate(got, 1):
        mean = lambda p, q: sum(w.get(frozenset((i, j)), 0) for i in groups[p] for j in groups[q]) / len(groups[p]) / len(groups[q])  # noqa: B023, E731
        assert x == pytest.approx(mean(a, b)) == pytest.approx(max(mean(p, q) for p, q in itertools.combinations(groups, 2)))
        groups[-k] = groups.pop(a) | groups.pop(b)


def test_completion_joins_all_roots(spark):
    e = spark.createDataFrame([(0, 1, 2.0), (5, 6, 1.0), (6, 7, 3.0)], "src long, dst long, w double")
    v = spark.createDataFrame([(x,) for x in (0, 1, 5, 6, 7, 9)], "id long")
    rows = sorted(tuple(x) for x in clustering.completed(clustering.dendrogram(e), v).collect())
    assert [x[:4] for x in rows] == [(0, 0, -1, 3), (1, 5, -2, 3), (2, 9, 9, 4), (3, -1, -1, 4), (4, -1, -2, None)]


def test_patterns_are_met_once(spark):
    r = random.Random(1)
    pairs = {tuple(sorted(r.sample(range(12), 2))) for _ in range(30)}
    g = graph(spark, sorted(pairs))
    for p in mining.MOTIFS:
        every = mining.matches(g, p).count()
        assert every == mining.matches(g, p, once=True).count() * p.automorphisms()


def test_gradients_with_dropout(spark):
    """Steps of plain descent with and without dropout follow the numeric gradient of the same masks."""
    r = np.random.default_rng(0)
    g = graph(spark, [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)])
    x = spark.createDataFrame([(i, r.normal(size=5).tolist()) for i in range(4)], "id long, h array<double>")
    y = spark.createDataFrame([(i, i % 2) for i in range(4)], "id long, label long")
    net = gnn.Network(g, [5, 4, 2], "gcn", lr=1.0, optimizer="sgd", dropout=0.4)
    loss = lambda: net.loss(net.forward(x, True, 0)[-1]["h"], y)
    before = [layer.w.copy() for layer in net.layers]
    for k, i, j in ((0, 0, 1), (0, 3, 2), (1, 1, 0)):
        w = net.layers[k].w
        w[i, j] += 1e-5
        up = loss()
        w[i, j] -= 2e-5
        down = loss()
        w[i, j] += 1e-5
        before[k][i, j] = (up - down) / 2e-5
    old = [layer.w.copy() for layer in net.layers]
    net.epoch(x, y, 0)
    for k, i, j in ((0, 0, 1), (0, 3, 2), (1, 1, 0)):
        assert old[k][i, j] - net.layers[k].w[i, j] == pytest.approx(before[k][i, j], abs=1e-5)


def test_minibatches_train_the_same_layers(spark):
    r = np.random.default_rng(1)
    g = graph(spark, [(i, (i + 1) % 8) for i in range(8)])
    x = spark.createDataFrame([(i, r.normal(size=3).tolist()) for i in range(8)], "id long, h array<double>")
    y = spark.createDataFrame([(i, i % 2) for i in range(8)], "id long, label long")
    net = gnn.Network(g, [3, 2], "sage", lr=0.1)
    w = net.layers[0].w.copy()
    losses = net.train_batches(x, y, 2, lambda k: spark.range(4 * k, 4 * k + 4))
    assert len(losses) == 2 and not np.allclose(w, net.layers[0].w)
