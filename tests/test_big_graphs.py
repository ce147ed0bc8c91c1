"""Steps that must stay small where the graph is not."""

import tracemalloc
from itertools import combinations

import numpy as np
import pytest
from graphs import neighbours, random_edges

from sparkloom.graph import Graph
from sparkloom.operators import gnn, mining
from sparkloom.queries import QUERIES
from sparkloom.session import table


def graph(spark, edges, vertices):
    return Graph.of_edges(spark.createDataFrame(edges, "src long, dst long"), vertices=spark.createDataFrame([(v,) for v in vertices], "id long"))


def shuffled(spark):
    """Rows that all stages up to now have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_triangles_write_no_paths(spark):
    n = 200
    g = graph(spark, list(combinations(range(n), 2)), range(n))
    before, key = shuffled(spark), "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        assert mining.triangle_count(g).first()[0] == n * (n - 1) * (n - 2) // 6
    finally:
        spark.conf.set(key, held)
    assert shuffled(spark) - before < n * n


def test_triangles_by_cells_and_passes(spark, monkeypatch):
    monkeypatch.setattr(mining, "CELL", 10)
    names = [7 * v - 2**62 if v % 5 else 2**62 - v for v in range(40)]
    edges = random_edges(40, 220, 5)
    adj = neighbours(edges, 40)
    want = [t for t in combinations(range(40), 3) if all(b in adj[a] for a, b in combinations(t, 2))]
    g = graph(spark, [(names[a], names[b]) for a, b in edges], names)
    assert len(want) > 50 and mining.triangle_count(g).first()[0] == len(want)
    assert sorted(tuple(r) for r in mining.triangle_list(g).collect()) == sorted(tuple(sorted(names[v] for v in t)) for t in want)
    assert {r[0]: r[1] for r in mining.triangles_per_vertex(g).collect()} == {names[v]: sum(v in t for t in want) for v in range(40)}


def test_triangles_per_vertex_keep_no_list(spark, monkeypatch):
    n = 60
    monkeypatch.setattr(mining, "triangle_list", None)
    g = graph(spark, list(combinations(range(n), 2)), range(n + 1))
    assert {r[0]: r[1] for r in mining.triangles_per_vertex(g).collect()} == {v: (n - 1) * (n - 2) // 2 if v < n else 0 for v in range(n + 1)}


def test_drawn_gates_are_those_of_the_generator(spark):
    n = 150
    rng = np.random.default_rng(3)
    want = {k: rng.normal(0, 1 / n, (n, n)) for k in gnn.GATES}
    for least in (37, 1_000, 1 << 20):  # segments so short that numbers often reach beyond them, and none
        drawn = gnn.DrawnGates(3, n, 1 / n).located(spark, 4_000, least)
        assert len(drawn.at) == (-(-6 * n * n * 21 // (20 * least)) if least < 6 * n * n else 1)
        for k in gnn.GATES:
            for low, high in ((0, n), (71, 90), (149, 150)):
                assert all(np.array_equal(rows, want[k][r : r + len(rows)]) for r, rows in drawn.rows(k, low, high, 8))
    h = spark.createDataFrame([(v * 3, [float(v % 7), 0.5 * v]) for v in range(n)], "id long, h array<double>")
    g = Graph.of_edges(spark.createDataFrame([(3 * a, 3 * b) for a, b in random_edges(n, 400, 2)], "src long, dst long"), vertices=h.select("id"))
    a, b = ({r["id"]: r["h"] for r in gnn.gated_step(h, g, x).collect()} for x in (want, gnn.DrawnGates(3, n, 1 / n)))
    assert len(a) == n and all(b[v] == pytest.approx(a[v], abs=1e-12) for v in a)


def test_gated_query_holds_no_gate_on_the_driver(spark):
    d = "/root/testdata/sf0.01"
    n = table(spark, d, "embeddings").count()
    tracemalloc.start()
    try:
        assert QUERIES["ggnn_step"](spark, d).count() == 64 * n
        assert tracemalloc.get_traced_memory()[1] < 4 * n * n
    finally:
        tracemalloc.stop()
