import pytest
from graphs import TEST6, TESTER, colours, components, cores, dependencies, forest_weight, hops, lengths, neighbours, random_edges

from sparkloom.graph import Graph
from sparkloom.operators import clustering, compression, mining, partition, ranking, sampling, spanning, transform, traversal
from sparkloom.operators.components import component_labels


def graph(spark, edges, n):
    e = spark.createDataFrame(edges, "src long, dst long") if edges else spark.createDataFrame([], "src long, dst long")
    return Graph.of_edges(e, vertices=spark.range(n))


def by_id(rows):
    return {r[0]: r[1] for r in rows.collect()}


@pytest.mark.parametrize(
    "edges, triangles, wedges, core, score",
    [(TESTER, 4, 26, [2] * 8, [1, 0, 0.714286, 0.214286, 0, 0, 0.214286, 0]), (TEST6, 6, 32, [2, 2, 2, 3, 3, 3, 2, 3], [1, 0, 0.714286, 0.285714, 0, 0, 0.142857, 0])],
)
def test_known_answers(spark, edges, triangles, wedges, core, score):
    g = graph(spark, edges, 8)
    assert mining.triangle_count(g).first()[0] == triangles
    assert mining.wedge_count(g).first()[0] == wedges
    assert by_id(traversal.bfs(g, 0)) == dict(enumerate([0, 1, 1, 2, 3, 3, 2, 3]))
    assert set(by_id(component_labels(g.edges)).values()) == {0}
    assert by_id(ranking.core_numbers(g)) == dict(enumerate(core))
    assert by_id(ranking.greedy_colouring(g)) == dict(enumerate([0, 1, 2, 0, 1, 2, 0, 3]))
    got = by_id(traversal.betweenness(g, 0))
    assert [got[k] for k in range(8)] == pytest.approx(score, abs=1e-5)
    assert transform.oriented(g).count() == len(edges)
    rank = by_id(ranking.pagerank(g, 15, None))
    if edges is TESTER:
        assert [rank[k] for k in range(8)] == pytest.approx([0.094908, 0.094908, 0.168552, 0.121970, 0.120713, 0.156268, 0.121970, 0.120713], abs=1e-6)


def test_random_graph_against_plain_python(spark):
    n = 40
    edges = random_edges(n, 55, 3)
    weighted = [(a, b, (a * 7 + b * 3) % 11 + 1) for a, b in edges]
    adj = neighbours(edges, n)
    g = graph(spark, edges, n)
    w = spark.createDataFrame(weighted, "src long, dst long, w long")
    gw = Graph.of_edges(w, vertices=spark.range(n))
    dist = hops(adj, 0)
    assert by_id(traversal.bfs(g, 0)) == {v: dist.get(v, 1_000_000_000) for v in range(n)}
    far = lengths(weighted, 0)
    want = {v: far.get(v, 2_147_483_647) for v in range(n)}
    assert by_id(traversal.sssp(gw, 0)) == want
    assert by_id(traversal.sssp(gw, 0, delta=5)) == want
    comp = components(edges, n)
    assert by_id(component_labels(g.edges)) == {v: comp[v] for v in range(n) if adj[v]}
    assert by_id(ranking.core_numbers(g)) == cores(adj)
    assert by_id(ranking.greedy_colouring(g)) == colours(adj)
    assert by_id(traversal.betweenness(g, 0)) == pytest.approx(dependencies(adj, 0))
    summary = spanning.forest_summary(w, spark.range(n)).first()
    assert summary["weight"] == forest_weight(weighted, n)
    assert summary["components"] == len(set(comp.values()))
    single = clustering.single_linkage(w).agg({"w": "sum"}).first()[0]
    assert single == -forest_weight([(a, b, -x) for a, b, x in weighted], n)


def test_empty_and_single_vertex(spark):
    g = graph(spark, [], 1)
    assert by_id(traversal.bfs(g, 0)) == {0: 0}
    assert component_labels(g.edges).count() == 0
    assert by_id(ranking.core_numbers(g)) == {0: 0}
    assert by_id(ranking.greedy_colouring(g)) == {0: 0}
    assert mining.triangle_count(g).first()[0] == 0
    assert spanning.forest_summary(g.edges.selectExpr("src", "dst", "1L as w"), g.vertices).first()["components"] == 1
    assert by_id(traversal.betweenness(g, 0)) == {0: 0.0}


def test_cleaning_loops_and_labels(spark):
    raw = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (2, 1)], "src long, dst long")
    assert sorted(map(tuple, transform.cleaned(raw).collect())) == [(0, 1), (2, 1)]
    assert tuple(transform.cleaning_report(raw).first()) == (1, 1, 2)
    assert transform.symmetrized(transform.cleaned(raw)).count() == 4
    v = spark.createDataFrame([(0, 5), (1, 5), (2, 6)], "id long, label long")
    g = Graph(v, transform.symmetrized(transform.cleaned(raw)))
    assert sorted(map(tuple, transform.neighbour_labels(g).collect())) == [(0, 5, 1), (1, 5, 1), (1, 6, 1), (2, 5, 1)]
    assert transform.frequent_labels(v, 1).first()[0] == 1
    assert {r[0] for r in transform.frequent_vertices(v, 2).collect()} == {0, 1}
    assert sorted(map(tuple, transform.induced(g.edges, spark.createDataFrame([(1,), (2,)], "id long")).collect())) == [(0, 1), (1, 0)]


def test_motifs_on_the_complete_graph(spark):
    g = graph(spark, [(a, b) for a in range(5) for b in range(a + 1, 5)], 5)
    got = {r["motif"]: r["n"] for r in mining.motif_counts(g, mining.MOTIFS).collect()}
    assert got == {"wedge": 0, "triangle": 10, "3-star": 0, "4-path": 0, "tailed_triangle": 0, "square": 0, "diamond": 0, "4-clique": 5}
    p = mining.Pattern.parse("3 6 2 0 0\n0 0 1 2\n1 0 0 2\n2 0 0 1")
    assert p.name() == "triangle" and p.automorphisms() == 6 and str(p) == "0(0)-1(0), 0(0)-2(0), 1(0)-2(0)"


def test_agglomeration_of_a_path(spark):
    e = spark.createDataFrame([(0, 1, 9.0), (1, 2, 5.0), (2, 3, 7.0)], "src long, dst long, w double")
    rows = {(r["node"], r["parent"], r["weight"]) for r in clustering.dendrogram(e).collect()}
    assert rows == {(0, -1, 9.0), (1, -1, 9.0), (2, -2, 7.0), (3, -2, 7.0), (-1, -3, 5.0), (-2, -3, 5.0)}


def test_partitions_cover_every_edge(spark):
    g = graph(spark, TESTER, 8)
    assert partition.one_dimensional(g.edges, 8, 3).filter("part between 0 and 2").count() == 24
    assert partition.two_dimensional(g.edges, 8, 3).select("src", "dst").distinct().count() == 24
    halo = partition.with_halo(g.edges, 8, 2)
    assert halo.filter("part = 0 and src < 4").count() == g.edges.filter("src < 4").count()
    assert partition.cells(g.edges, [0], 8, 2).count() == g.edges.filter("src < 4 and dst < 4").count()
    assert partition.balanced_chunks(g.edges, 3).agg({"load": "sum"}).first()[0] > 0


def test_code_lengths(spark):
    g = graph(spark, [(0, 1), (0, 3)], 4)
    # gaps: 0: zigzag(1) = 2, then 1; 1: zigzag(-1) = 1; 3: zigzag(-3) = 5
    got = {r["scheme"]: r["bits"] for r in compression.code_lengths(g).collect()}
    assert got["gamma"] == 3 + 3 + 3 + 5
    assert got["zeta"] == 3 + 3 + 3 + 6
    assert got["vbyte"] == 4 * 8 + 3 * 8


def test_samples_follow_edges(spark):
    g = graph(spark, TESTER, 8)
    adj = neighbours(TESTER, 8)
    rows = sampling.fanout(g, spark.range(2), (3, 2)).collect()
    assert len(rows) == 2 * (3 + 6)
    at = {(r["root"], r["path"]): r["id"] for r in rows}
    for (root, path), v in at.items():
        before = path.rsplit(".", 1)[0] if "." in path else None
        assert v in adj[at[(root, before)] if before else root]
    met = sampling.frontier_members(g.edges, g.vertices, 2, 2, 5).collect()
    assert {r["walk"] for r in met} == {0, 1}
    assert sampling.sampled_subgraph(g.edges, spark.createDataFrame(met).filter("walk = 0")).count() > 0
