import numpy as np

from sparkloom.operators import mining
from sparkloom.graph import Graph
from sparkloom.sources import binary, registry, text


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_matrix_market(spark, tmp_path):
    p = tmp_path / "a.mtx"
    p.write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% note\n8 8 5\n1 2\n2 3\n1 3\n3 3\n1 2\n")
    e, n, m = text.read_mtx(spark, str(p))
    assert (n, m) == (8, 8)
    assert rows(e.select("src", "dst")) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert mining.triangle_count(Graph(spark.range(8), e)).first()[0] == 1
    p.write_text("%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 4.5\n2 1 3\n")
    e, *_ = text.read_mtx(spark, str(p), bipartite=True)
    assert rows(e) == [(0, 2, 4.5), (1, 2, 3.0), (2, 0, 4.5), (2, 1, 3.0)]


def test_text_formats(spark, tmp_path):
    p = tmp_path / "x"
    p.write_text("# c\n1 2 5\n2 2 1\n2 3\n")
    assert rows(text.read_edge_list(spark, str(p))) == [(0, 1, 5.0), (1, 0, 5.0), (1, 2, 1.0), (2, 1, 1.0)]
    p.write_text("t # 0\nv 0 3\nv 1 4\ne 0 1 7\n")
    v, e = text.read_lg(spark, str(p))
    assert rows(v) == [(0, 3), (1, 4)] and rows(e) == [(0, 1, 7), (1, 0, 7)]
    p.write_text("0 9 1 2 2 0\n1 8\n")
    v, e = text.read_labelled_adjacency(spark, str(p))
    assert rows(v) == [(0, 9), (1, 8)] and rows(e) == [(0, 1), (0, 2)]
    p.write_text("c\np sp 2 1\na 1 2 4\n")
    assert rows(text.read_dimacs(spark, str(p))) == [(0, 1, 4.0)]
    p.write_text("3 2\n2 3\n1\n1\n")
    assert rows(text.read_metis(spark, str(p))) == [(0, 1), (0, 2), (1, 0), (2, 0)]
    p.write_text("2 3\n0 1 0\n1 0 0\n")
    assert rows(text.read_one_hot(spark, str(p))) == [(0, 1), (1, 0)]
    assert rows(text.read_one_hot(spark, str(p), single=False)) == [(0, [0, 1, 0]), (1, [1, 0, 0])]
    p.write_text("1 3\n1\n1\n0\n1\n")
    assert rows(text.read_mask(spark, str(p))) == [(1,)]
    p.write_text("2 3\n0 1 2.5\n1 0 1\n")
    assert rows(text.read_features(spark, str(p))) == [(0, [0.0, 2.5, 0.0]), (1, [1.0, 0.0, 0.0])]
    p.write_text("8\n24\n4 8 1 4\n4\n0\n0\n0\n")
    assert text.read_meta(spark, str(p))["max_degree"] == 4


def test_binary_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(0, 2), (1, 0), (2, 1), (3, 1)], "id long, label long")
    e = spark.createDataFrame([(0, 1, 5), (1, 0, 5), (1, 3, 2), (3, 1, 2)], "src long, dst long, w long")
    prefix = str(tmp_path / "g")
    assert binary.write_csr(v, e, prefix, "label", "w") == {"n": 4, "m": 4, "max_degree": 2}
    v2, e2, meta = binary.read_csr(spark, prefix, labels=True, edge_labels=True)
    assert rows(v2) == rows(v) and rows(e2) == rows(e) and meta["edge_classes"] == 6
    registry.register("small", "csr", prefix)
    assert registry.load(spark, "small")[1].count() == 4
    (tmp_path / "f.bin").write_bytes(np.arange(6, dtype="<f4").tobytes())
    assert rows(binary.read_features(spark, str(tmp_path / "f.bin"), 3)) == [(0, [0.0, 1.0, 2.0]), (1, [3.0, 4.0, 5.0])]
    gr = np.array([1, 0, 3, 3], "<u8").tobytes() + np.array([2, 2, 3], "<u8").tobytes() + np.array([1, 2, 0], "<u4").tobytes()
    (tmp_path / "a.gr").write_bytes(gr)
    v3, e3 = binary.read_gr(spark, str(tmp_path / "a.gr"))
    assert v3.count() == 3 and rows(e3) == [(0, 1, 1), (0, 2, 1), (2, 0, 1)]
    assert binary.seeded_labels(v3, 3).filter("label between 0 and 2").count() == 3


def test_text_sinks(spark, tmp_path):
    d = spark.createDataFrame([(0, -1, 2.0)], "node long, parent long, weight double")
    text.write_dendrogram(d, str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).first()[0] == "0 -1 2.0"
    e = spark.createDataFrame([(0, 1)], "src long, dst long")
    text.write_edge_list(e, str(tmp_path / "e"))
    assert rows(text.read_edge_list(spark, str(tmp_path / "e"), both=False)) == [(0, 1, 1.0)]
