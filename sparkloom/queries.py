"""The registered graph queries, each with its DuckDB form where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import sets as S
from sparkloom.functions import vectors as V
from sparkloom.graph import Graph
from sparkloom.operators import clustering, community, compression, factorization, gnn, knn, mining, partition, ranking, sampling, spanning, transform, traversal
from sparkloom.operators.components import component_labels
from sparkloom.plans import projections as P
from sparkloom.session import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL if any."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


CP, CP2 = P.both_sql("g_cp"), P.both_sql("g_cp2")
V2 = "v AS (SELECT DISTINCT src AS id FROM e)"
LAB = "lab AS (SELECT v.id, CAST(p_size AS BIGINT) AS label FROM v JOIN part ON p_partkey = v.id)"
EVT = P.SQL["g_evt"]


def cp(spark: SparkSession, d: str) -> Graph:
    return Graph.of_edges(stored(P.co_purchase(spark, d)))


def cp2(spark: SparkSession, d: str) -> Graph:
    return Graph.of_edges(stored(P.co_purchase(spark, d, 2)))


def labelled(spark: SparkSession, d: str) -> Graph:
    g = cp2(spark, d)
    v = g.vertices.join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("label")), "id")
    return Graph(v, g.edges)


def source_of(g: Graph) -> int:
    return g.vertices.agg(F.min("id")).first()[0]


def _num(*parts: str) -> str:
    """The number that :func:`transform.draw` makes of the same parts."""
    return "CAST('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 15) AS BIGINT)"


# --- structure -----------------------------------------------------------------------------------------------------

TRI = f"WITH {P.SQL['g_cp']} SELECT count(*) AS triangles FROM g_cp a JOIN g_cp b ON a.dst = b.src JOIN g_cp c ON c.src = a.src AND c.dst = b.dst"


@query(TRI)
def triangle_count(spark, d):
    return mining.triangle_count(cp(spark, d))


@query(f"WITH {CP}, {V2}, t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM g_cp a JOIN g_cp b ON a.dst = b.src JOIN g_cp c ON c.src = a.src AND c.dst = b.dst), n AS (SELECT id, count(*) AS n FROM (SELECT x AS id FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY id) SELECT v.id, coalesce(n, 0) AS triangles FROM v LEFT JOIN n USING (id)")
def triangle_per_vertex(spark, d):
    return mining.triangles_per_vertex(cp(spark, d))


@query(f"WITH {CP} SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS wedges FROM (SELECT src, count(*) AS n FROM e GROUP BY src)")
def wedge_count(spark, d):
    return mining.wedge_count(cp(spark, d))


@query(f"WITH {CP} SELECT src AS id, count(*) AS degree FROM e GROUP BY src")
def degree(spark, d):
    return cp(spark, d).degrees()


@query(f"WITH {CP} SELECT max(n) AS max_degree FROM (SELECT src, count(*) AS n FROM e GROUP BY src)")
def max_degree(spark, d):
    return cp(spark, d).max_degree()


@query(f"WITH {CP} SELECT CAST(n // 10 AS BIGINT) AS bin, count(*) AS n FROM (SELECT src, count(*) AS n FROM e GROUP BY src) GROUP BY 1")
def degree_histogram(spark, d):
    return transform.degree_histogram(cp(spark, d))


EV_RAW = "raw AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events)"


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey")
def clean_edges(spark, d):
    return transform.cleaned(table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("WITH r AS (SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT CAST(coalesce(sum(n) FILTER (src = dst), 0) AS BIGINT) AS self_loops, CAST(coalesce(sum(n - 1) FILTER (src <> dst), 0) AS BIGINT) AS repeated, count(*) FILTER (src <> dst) AS kept FROM r")
def cleaning_report(spark, d):
    return transform.cleaning_report(table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query(f"WITH {EVT} SELECT src, dst FROM g_evt UNION SELECT dst, src FROM g_evt")
def symmetrize(spark, d):
    return transform.symmetrized(P.transitions(spark, d))


@query(f"WITH {CP}, d AS (SELECT src AS id, count(*) AS n FROM e GROUP BY src) SELECT e.src, e.dst FROM e JOIN d a ON a.id = e.src JOIN d b ON b.id = e.dst WHERE b.n > a.n OR (b.n = a.n AND e.dst > e.src)")
def orient(spark, d):
    return transform.oriented(cp(spark, d))


@query(f"WITH {EVT} SELECT dst AS src, src AS dst, w FROM g_evt")
def reverse(spark, d):
    return transform.reversed_edges(P.transitions(spark, d))


@query(f"WITH {CP2} SELECT src, dst FROM e WHERE src > dst")
def edge_list_half(spark, d):
    return transform.half(cp2(spark, d).edges.select("src", "dst"), ascend=False)


@query(f"WITH {P.both_sql('g_cp2')}, {EVT} SELECT g.src, g.dst, (x.src IS NOT NULL) AS found FROM g_evt g LEFT JOIN (SELECT DISTINCT src, dst FROM e) x ON x.src = g.src AND x.dst = g.dst")
def edge_exists(spark, d):
    return transform.edges_exist(cp2(spark, d).edges, P.transitions(spark, d))


@query(f"WITH {CP2} SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS nbrs FROM e GROUP BY src")
def adjacency(spark, d):
    return cp2(spark, d).adjacency().select("id", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"))


@query(f"WITH {CP2}, {V2}, {LAB} SELECT label, count(*) AS n FROM lab GROUP BY label")
def label_frequency(spark, d):
    return transform.label_frequency(labelled(spark, d).vertices)


@query(f"WITH {CP2}, {V2}, {LAB} SELECT label, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS ids FROM lab GROUP BY label")
def label_index(spark, d):
    return transform.label_index(labelled(spark, d).vertices).select("label", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query(f"WITH {CP2}, {V2}, {LAB} SELECT count(*) AS n FROM (SELECT label FROM lab GROUP BY label HAVING count(*) > 38)")
def frequent_labels(spark, d):
    return transform.frequent_labels(labelled(spark, d).vertices, 38)


@query(f"WITH {CP2}, {V2}, {LAB} SELECT id FROM lab WHERE label IN (SELECT label FROM lab GROUP BY label HAVING count(*) >= 38)")
def frequent_vertices(spark, d):
    return transform.frequent_vertices(labelled(spark, d).vertices, 38)


@query(f"WITH {CP2}, {V2}, {LAB} SELECT src AS id, label, count(*) AS n FROM e JOIN lab ON lab.id = e.dst GROUP BY 1, 2")
def neighbour_labels(spark, d):
    return transform.neighbour_labels(labelled(spark, d))


@query(f"WITH {CP2}, {V2}, m AS (SELECT id FROM v WHERE id % 3 <> 0) SELECT src, dst FROM e WHERE src IN (SELECT id FROM m) AND dst IN (SELECT id FROM m)")
def masked_subgraph(spark, d):
    g = cp2(spark, d)
    return transform.masked(g.edges.select("src", "dst"), g.vertices.filter("id % 3 <> 0"))


@query(f"WITH {CP2}, {V2}, m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new FROM v WHERE id % 3 <> 0) SELECT a.new AS src, b.new AS dst FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst")
def induced_reindexed(spark, d):
    g = cp2(spark, d)
    return transform.induced(g.edges, g.vertices.filter("id % 3 <> 0"))


@query(f"WITH {CP2}, {V2} SELECT src, dst FROM e UNION SELECT id, id FROM v")
def self_loops(spark, d):
    return transform.with_self_loops(cp2(spark, d))


@query(f"WITH {CP2}, d AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src) SELECT id, degree, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d")
def row_offsets(spark, d):
    return transform.exclusive_scan(cp2(spark, d).degrees(), "id", "degree")


@query(f"WITH {CP2}, {V2} SELECT id FROM v ORDER BY {_num('1', 'id')}, id LIMIT 100")
def select_items(spark, d):
    return transform.sampled(cp2(spark, d).vertices, F.col("id"), 100)


@query(f"WITH {CP2}, d AS (SELECT src AS id, count(*) AS w FROM e GROUP BY src), r AS (SELECT id, CAST(sum(w) OVER (ORDER BY id) - w AS BIGINT) AS a, CAST(sum(w) OVER (ORDER BY id) AS BIGINT) AS z FROM d), x AS (SELECT t.draw, {_num('1', 't.draw')} % (SELECT CAST(sum(w) AS BIGINT) FROM d) AS aim FROM range(200) t(draw)) SELECT draw, id FROM x JOIN r ON aim >= a AND aim < z")
def weighted_items(spark, d):
    return transform.weighted_choice(cp2(spark, d).degrees().select("id", F.col("degree").alias("w")), spark.range(200).withColumnRenamed("id", "draw"))


# --- sorted sets --------------------------------------------------------------------------------------------------------


def _pairs(spark, d) -> DataFrame:
    g = cp2(spark, d)
    a = g.adjacency()
    e = g.edges.filter("src < dst").select("src", "dst")
    return e.join(a.select(F.col("id").alias("src"), F.col("nbrs").alias("x")), "src").join(a.select(F.col("id").alias("dst"), F.col("nbrs").alias("y")), "dst")


def _set_sql(kind: str, where: str = "") -> str:
    return f"WITH {CP2} SELECT p.src AS u, p.dst AS v, count(a.dst) AS n FROM (SELECT src, dst FROM e WHERE src < dst) p LEFT JOIN e a ON a.src = p.src {where} AND {kind} (SELECT 1 FROM e b WHERE b.src = p.dst AND b.dst = a.dst) GROUP BY 1, 2"


@query(_set_sql("EXISTS"))
def set_intersect(spark, d):
    return _pairs(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v"), S.intersect_count(F.col("x"), F.col("y")).alias("n"))


@query(_set_sql("NOT EXISTS", "AND a.dst <> p.dst"))
def set_difference(spark, d):
    return _pairs(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.size(S.difference(F.col("x"), F.col("y"), F.col("dst"))).cast("long").alias("n"))


@query(_set_sql("EXISTS", "AND a.dst < p.src"))
def set_bounded(spark, d):
    return _pairs(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.size(S.intersect_bounded(F.col("x"), F.col("y"), F.col("src"))).cast("long").alias("n"))


@query(_set_sql("NOT EXISTS", "AND a.dst <> p.dst AND a.dst < p.dst"))
def set_difference_bounded(spark, d):
    return _pairs(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.size(S.difference(F.col("x"), F.col("y"), F.col("dst"), F.col("dst"))).cast("long").alias("n"))


@query(_set_sql("EXISTS", "AND a.dst NOT IN (p.src + 1, p.dst - 1)"))
def set_except(spark, d):
    return _pairs(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.size(S.intersect_except(F.col("x"), F.col("y"), F.col("src") + 1, F.col("dst") - 1)).cast("long").alias("n"))


@query(f"WITH {CP2}, {V2}, {LAB} SELECT p.src AS u, p.dst AS v, count(a.dst) AS n FROM (SELECT src, dst FROM e WHERE src < dst) p LEFT JOIN (SELECT e.* FROM e JOIN lab ON lab.id = e.dst WHERE label <= 25) a ON a.src = p.src AND EXISTS (SELECT 1 FROM e b WHERE b.src = p.dst AND b.dst = a.dst) GROUP BY 1, 2")
def label_intersect(spark, d):
    g = labelled(spark, d)
    low = g.edges.join(g.vertices.filter("label <= 25").select(F.col("id").alias("dst")), "dst", "left_semi").groupBy("src").agg(F.collect_list("dst").alias("x"))
    pairs = _pairs(spark, d).drop("x").join(low, "src", "left")
    return pairs.select(F.col("src").alias("u"), F.col("dst").alias("v"), S.intersect_count(F.coalesce("x", F.array().cast("array<bigint>")), F.col("y")).alias("n"))


@query(f"WITH {CP2} SELECT p.src AS u, p.dst AS v, count(a.dst) AS n FROM (SELECT src, dst FROM e WHERE src < dst) p LEFT JOIN e a ON a.src = p.src AND ((a.dst >= p.dst AND a.dst < p.dst + 50) OR (a.dst >= p.dst + 100 AND a.dst < p.dst + 300)) GROUP BY 1, 2")
def interval_intersect(spark, d):
    box = lambda a, b: F.struct((F.col("dst") + a).alias("lo"), (F.col("dst") + b).alias("hi"))
    return _pairs(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v"), S.in_intervals(F.col("x"), F.array(box(0, 50), box(100, 300))).alias("n"))


@query(f"WITH {CP2} SELECT src AS u, dst AS v, greatest(least(src + 40, dst + 10) - greatest(src, dst - 10), 0) + greatest(least(src + 40, dst + 90) - greatest(src, dst + 30), 0) AS n FROM e WHERE src < dst")
def interval_overlap(spark, d):
    box = lambda c, a, b: F.struct((F.col(c) + a).alias("lo"), (F.col(c) + b).alias("hi"))
    return cp2(spark, d).edges.filter("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), S.intervals_overlap(F.array(box("src", 0, 40)), F.array(box("dst", -10, 10), box("dst", 30, 90))).alias("n"))


# --- traversal, components, centrality -------------------------------------------------------------------------------------

SRC = "s AS (SELECT min(src) AS s FROM e)"


@query(f"WITH RECURSIVE {CP}, {V2}, {SRC}, r(id, dist) USING KEY (id) AS (SELECT s, CAST(0 AS BIGINT) FROM s UNION SELECT e.dst, min(r.dist + 1) FROM r JOIN e ON e.src = r.id LEFT JOIN recurring.r AS k ON k.id = e.dst WHERE k.dist IS NULL OR r.dist + 1 < k.dist GROUP BY e.dst) SELECT v.id, coalesce(r.dist, 1000000000) AS dist FROM v LEFT JOIN r USING (id)")
def bfs(spark, d):
    g = cp(spark, d)
    return traversal.bfs(g, source_of(g))


@query(f"WITH RECURSIVE {CP}, {V2}, {SRC}, r(id, dist) USING KEY (id) AS (SELECT s, CAST(0 AS BIGINT) FROM s UNION SELECT e.dst, min(r.dist + e.w) FROM r JOIN e ON e.src = r.id LEFT JOIN recurring.r AS k ON k.id = e.dst WHERE k.dist IS NULL OR r.dist + e.w < k.dist GROUP BY e.dst) SELECT v.id, coalesce(r.dist, 2147483647) AS dist FROM v LEFT JOIN r USING (id)")
def sssp(spark, d):
    g = cp(spark, d)
    return traversal.sssp(g, source_of(g))


@query(f"WITH RECURSIVE {CP2}, {V2}, r(id, c) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT e.dst, min(r.c) FROM r JOIN e ON e.src = r.id JOIN recurring.r AS k ON k.id = e.dst WHERE r.c < k.c GROUP BY e.dst) SELECT id, c AS component FROM r")
def connected_components(spark, d):
    return component_labels(cp2(spark, d).edges)


def _bc_sql(depth: int = 14) -> str:
    parts = [f"WITH {CP2}, {V2}, l0 AS (SELECT min(src) AS id, 1.0::DOUBLE AS sigma FROM e), s0 AS (SELECT id FROM l0)"]
    for k in range(1, depth + 1):
        parts.append(f"l{k} AS MATERIALIZED (SELECT e.dst AS id, sum(sigma) AS sigma FROM l{k - 1} JOIN e ON e.src = l{k - 1}.id WHERE e.dst NOT IN (SELECT id FROM s{k - 1}) GROUP BY 1), s{k} AS MATERIALIZED (SELECT id FROM s{k - 1} UNION SELECT id FROM l{k})")
    parts.append(f"d{depth} AS (SELECT id, sigma, 0.0::DOUBLE AS delta FROM l{depth})")
    for k in range(depth - 1, -1, -1):
        parts.append(f"d{k} AS MATERIALIZED (SELECT l.id, l.sigma, coalesce(sum(l.sigma / b.sigma * (1 + b.delta)), 0.0) AS delta FROM l{k} l LEFT JOIN (SELECT e.src, d.sigma, d.delta FROM e JOIN d{k + 1} d ON e.dst = d.id) b ON b.src = l.id GROUP BY 1, 2)")
    union = " UNION ALL ".join(f"SELECT id, delta FROM d{k}" for k in range(depth + 1))
    return ", ".join(parts) + f", u AS ({union}), m AS (SELECT max(delta) AS m FROM u) SELECT v.id, round(coalesce(u.delta, 0.0) / m.m, 4) + 0.0 AS bc FROM v LEFT JOIN u USING (id), m"


@query(_bc_sql())
def betweenness(spark, d):
    g = cp2(spark, d)
    return traversal.betweenness(g, source_of(g)).select("id", (F.round("bc", 4) + 0.0).alias("bc"))


def _pagerank_sql(rounds: int) -> str:
    parts = [f"WITH {EVT}, v AS (SELECT src AS id FROM g_evt UNION SELECT dst FROM g_evt), n AS (SELECT count(*)::DOUBLE AS n FROM v), deg AS (SELECT src, count(*)::DOUBLE AS k FROM g_evt GROUP BY src), r0 AS (SELECT id, 1 / n.n AS r FROM v, n)"]
    for k in range(1, rounds + 1):
        parts.append(f"r{k} AS MATERIALIZED (SELECT v.id, 0.15 / n.n + 0.85 * coalesce(x.s, 0) AS r FROM v CROSS JOIN n LEFT JOIN (SELECT g.dst, sum(p.r / deg.k) AS s FROM g_evt g JOIN r{k - 1} p ON p.id = g.src JOIN deg ON deg.src = g.src GROUP BY 1) x ON x.dst = v.id)")
    return ", ".join(parts) + f" SELECT id, round(r, 6) AS rank FROM r{rounds}"


@query(_pagerank_sql(10))
def pagerank_10(spark, d):
    g = Graph.of_edges(P.transitions(spark, d), directed=True)
    return ranking.pagerank(g, 10, None).select("id", F.round("rank", 6).alias("rank"))


def _settled_sql(most: int) -> str:
    base = _pagerank_sql(most)
    base = base[: base.index(" SELECT id, round(r, 6)")]
    gaps = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.r - b.r)) AS gap FROM r{k} a JOIN r{k - 1} b USING (id)" for k in range(1, most + 1))
    ranks = " UNION ALL ".join(f"SELECT {k} AS k, id, r FROM r{k}" for k in range(1, most + 1))
    return f"{base}, gaps AS ({gaps}), last AS (SELECT min(k) AS k FROM gaps WHERE gap < {ranking.EPSILON}) SELECT id, round(r, 6) AS rank FROM ({ranks}) JOIN last USING (k)"


@query(_settled_sql(30))
def pagerank(spark, d):
    return ranking.pagerank(Graph.of_edges(P.transitions(spark, d), directed=True)).select("id", F.round("rank", 6).alias("rank"))


def _h_index_sql(rounds: int) -> str:
    parts = [f"WITH {CP2}, {V2}, c0 AS (SELECT src AS id, count(*) AS v FROM e GROUP BY src)"]
    for k in range(1, rounds + 1):
        parts.append(f"c{k} AS MATERIALIZED (SELECT src AS id, max(least(v, n)) AS v FROM (SELECT src, v, row_number() OVER (PARTITION BY src ORDER BY v DESC) AS n FROM e JOIN c{k - 1} c ON c.id = e.dst) GROUP BY src)")
    return ", ".join(parts) + f" SELECT id, CAST(v AS BIGINT) AS core FROM c{rounds}"


@query(_h_index_sql(40))
def kcore(spark, d):
    return ranking.core_numbers(cp2(spark, d))


def _core_sql(k: int, rounds: int) -> str:
    parts = [f"WITH {CP2}, {V2}, a0 AS (SELECT src, dst FROM e)"]
    for r in range(1, rounds + 1):
        parts.append(f"k{r} AS MATERIALIZED (SELECT src AS id FROM a{r - 1} GROUP BY src HAVING count(*) >= {k}), a{r} AS MATERIALIZED (SELECT src, dst FROM a{r - 1} WHERE src IN (SELECT id FROM k{r}) AND dst IN (SELECT id FROM k{r}))")
    return ", ".join(parts) + f" SELECT DISTINCT src AS id FROM a{rounds}"


@query(_core_sql(3, 40))
def core_members(spark, d):
    return ranking.core_members(cp2(spark, d), 3)


def _first_fit_sql(rounds: int) -> str:
    parts = [f"WITH {CP2}, {V2}, low AS (SELECT src, dst FROM e WHERE dst < src), need AS (SELECT src AS id, count(*) AS n FROM low GROUP BY src), k0 AS (SELECT id, CAST(0 AS BIGINT) AS colour FROM v WHERE id NOT IN (SELECT id FROM need))"]
    for k in range(1, rounds + 1):
        parts.append(f"u{k} AS (SELECT src AS id, list(DISTINCT colour) AS used FROM low JOIN k{k - 1} c ON c.id = low.dst WHERE src NOT IN (SELECT id FROM k{k - 1}) GROUP BY src HAVING count(*) = (SELECT n FROM need WHERE need.id = src))")
        parts.append(f"k{k} AS MATERIALIZED (SELECT id, colour FROM k{k - 1} UNION ALL SELECT id, list_min(list_filter(range(0, len(used) + 1), lambda i: NOT list_contains(used, i))) FROM u{k})")
    return ", ".join(parts) + f" SELECT id, colour FROM k{rounds}"


@query(_first_fit_sql(60))
def coloring(spark, d):
    return ranking.greedy_colouring(cp2(spark, d))


# --- mining ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {CP2}, d AS (SELECT src AS id, count(*) AS k FROM e GROUP BY src), c AS (SELECT a.dst AS u, b.dst AS v, count(*) AS n FROM e a JOIN e b ON a.src = b.src AND a.dst < b.dst GROUP BY 1, 2) SELECT u AS src, v AS dst, round(n / (x.k + y.k - n)::DOUBLE, 6) AS jaccard FROM c JOIN d x ON x.id = u JOIN d y ON y.id = v")
def jaccard(spark, d):
    return mining.jaccard(cp2(spark, d))


@query(f"WITH {CP2}, t AS (SELECT count(*) AS n FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND b.src < b.dst), w AS (SELECT CAST(sum(k * (k - 1) // 2) AS BIGINT) AS n FROM (SELECT count(*) AS k FROM e GROUP BY src)) SELECT 'triangle' AS motif, n FROM t UNION ALL SELECT 'wedge', w.n - 3 * t.n FROM w, t")
def motif3(spark, d):
    return mining.motif_counts(cp2(spark, d))


QUADS = "n AS (SELECT src, dst FROM e), p AS (SELECT a.src AS a, a.dst AS b, b.dst AS c, c.dst AS d FROM n a JOIN n b ON b.src = a.dst JOIN n c ON c.src = b.dst WHERE b.dst <> a.src AND c.dst <> a.src AND c.dst <> a.dst UNION ALL SELECT a.src, a.dst, b.dst, c.dst FROM n a JOIN n b ON b.src = a.src JOIN n c ON c.src = a.src WHERE a.dst < b.dst AND b.dst < c.dst), s AS (SELECT DISTINCT list_sort([a, b, c, d]) AS q FROM p), m AS (SELECT q, unnest(q) AS v FROM s), deg AS (SELECT x.q, x.v, count(*) AS k FROM m x JOIN m y ON y.q = x.q JOIN n ON n.src = x.v AND n.dst = y.v GROUP BY 1, 2), kind AS (SELECT q, list_sort(list(k)) AS ks FROM deg GROUP BY q)"


@query(f"WITH {CP2}, {QUADS}, t(motif, ks) AS (VALUES ('3-star', [1, 1, 1, 3]), ('4-path', [1, 1, 2, 2]), ('tailed_triangle', [1, 2, 2, 3]), ('square', [2, 2, 2, 2]), ('diamond', [2, 2, 3, 3]), ('4-clique', [3, 3, 3, 3])) SELECT motif, count(q) AS n FROM t LEFT JOIN kind ON kind.ks = t.ks GROUP BY motif")
def motif4(spark, d):
    return mining.motif_counts(cp2(spark, d), mining.MOTIFS[2:])


@query(f"WITH {CP2} SELECT count(*) AS n FROM g_cp2 ab JOIN g_cp2 bc ON bc.src = ab.dst JOIN g_cp2 ac ON ac.src = ab.src AND ac.dst = bc.dst JOIN g_cp2 cd ON cd.src = bc.dst JOIN g_cp2 ad ON ad.src = ab.src AND ad.dst = cd.dst JOIN g_cp2 bd ON bd.src = ab.dst AND bd.dst = cd.dst")
def four_cliques(spark, d):
    return mining.motif_counts(cp2(spark, d), mining.MOTIFS[7:]).select("n")


# --- factorisation -------------------------------------------------------------------------------------------------------------

CF_K, CF_STEP, CF_LAM = 4, 1e-5, 0.001


def _cf_sql(rounds: int, tail: str) -> str:
    b = f"WITH {P.SQL['g_ps']}, e AS (SELECT '0_' || src AS src, '1_' || dst AS dst, w FROM g_ps UNION ALL SELECT '1_' || dst, '0_' || src, w FROM g_ps), p0 AS (SELECT DISTINCT src AS id, pos, 0.5::DOUBLE AS x FROM e, range({CF_K}) t(pos))"
    for k in range(1, rounds + 1):
        b += f", e{k} AS MATERIALIZED (SELECT e.src, e.dst, w - d.dot AS err FROM e JOIN (SELECT e.src, e.dst, sum(a.x * b.x) AS dot FROM e JOIN p{k - 1} a ON a.id = e.src JOIN p{k - 1} b ON b.id = e.dst AND b.pos = a.pos GROUP BY 1, 2) d ON d.src = e.src AND d.dst = e.dst), p{k} AS MATERIALIZED (SELECT p.id, p.pos, p.x + {CF_STEP} * (g.g - {CF_LAM} * p.x) AS x FROM p{k - 1} p JOIN (SELECT e{k}.src, b.pos, sum(err * b.x) AS g FROM e{k} JOIN p{k - 1} b ON b.id = e{k}.dst GROUP BY 1, 2) g ON g.src = p.id AND g.pos = p.pos)"
    return b + tail


@query(_cf_sql(2, " SELECT id, pos, round(x, 6) AS value FROM p2"))
def cf_rounds(spark, d):
    state = factorization.factorize(P.part_supplier(spark, d), 2, CF_K, CF_LAM, CF_STEP)
    return state.select(F.concat_ws("_", F.col("id.side").cast("string"), F.col("id.id").cast("string")).alias("id"), F.posexplode("p").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("value"))


@query(_cf_sql(1, ", z AS (SELECT e.w, sum(a.x * b.x) AS dot FROM e JOIN p1 a ON a.id = e.src JOIN p1 b ON b.id = e.dst AND b.pos = a.pos GROUP BY e.src, e.dst, e.w) SELECT round(sqrt(avg((w - dot) * (w - dot))), 6) AS rmse FROM z"))
def cf_rmse(spark, d):
    r = P.part_supplier(spark, d)
    return factorization.rmse(r, factorization.factorize(r, 1, CF_K, CF_LAM, CF_STEP)).select(F.round("rmse", 6).alias("rmse"))


@query(f"WITH {P.SQL['g_trade']} SELECT src, dst, round(w, 6) AS w FROM g_trade")
def bipartite_trade(spark, d):
    return P.trade(spark, d).select("src", "dst", F.round("w", 6).alias("w"))


# --- sampling -------------------------------------------------------------------------------------------------------------------


NEAR = "near AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos FROM e), d AS (SELECT src AS id, count(*) AS n FROM e GROUP BY src)"


def _fanout_sql(roots: str, sizes: tuple[int, ...]) -> str:
    parts = [f"WITH {CP2}, {V2}, {NEAR}, f0 AS (SELECT id AS root, '' AS path, id FROM ({roots}))"]
    for hop, k in enumerate(sizes, 1):
        aim = _num("1", "root", "path", "j")
        parts.append(f"x{hop} AS (SELECT root, path, f.id AS src, j, {aim} % d.n AS pos FROM f{hop - 1} f JOIN d ON d.id = f.id, range({k}) t(j)), f{hop} AS MATERIALIZED (SELECT root, CASE WHEN path = '' THEN '' ELSE path || '.' END || j AS path, dst AS id FROM x{hop} x JOIN near ON near.src = x.src AND near.pos = x.pos)")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT root, {hop} AS hop, path, id FROM f{hop}" for hop in range(1, len(sizes) + 1))


@query(_fanout_sql(f"SELECT id FROM v ORDER BY {_num('1', 'id')}, id LIMIT 5", (15, 10, 10)))
def fanout_sample(spark, d):
    g = cp2(spark, d)
    return sampling.fanout(g, transform.sampled(g.vertices, F.col("id"), 5), (15, 10, 10))


@query(_fanout_sql("SELECT id FROM v", (1,) * 5))
def random_walk(spark, d):
    g = cp2(spark, d)
    return sampling.random_walk(g, g.vertices, 5)


@query()
def frontier_sample(spark, d):
    g = cp2(spark, d)
    return sampling.frontier_members(g.edges, g.vertices, 4, 8, 12)


# --- neighbour graph and neural networks ------------------------------------------------------------------------------------------

KNN = """q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT a.id AS q, b.id AS id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score FROM q a JOIN q b ON a.id <> b.id),
top AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM near)"""
G_KNN = f"{KNN}, e AS (SELECT q AS src, id AS dst FROM top WHERE rank <= 5 UNION SELECT id, q FROM top WHERE rank <= 5)"
FEAT = 64
H = f"h AS (SELECT id, pos, v[CAST(pos AS INTEGER) + 1] AS x FROM q, range({FEAT}) t(pos))"


def vecs(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def knn_graph(spark, d) -> Graph:
    v = vecs(spark, d)
    return Graph(v.select("id"), stored(knn.knn_edges(v)))


def features(spark, d) -> DataFrame:
    return vecs(spark, d).select("id", F.transform(F.slice("v", 1, FEAT), lambda x: x.cast("double")).alias("h"))


def _long(rows: DataFrame, digits: int = 5) -> DataFrame:
    return rows.select("id", F.posexplode("h").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), (F.round("x", digits) + 0.0).alias("value"))


@query(f"WITH {KNN} SELECT q, id, rank, score FROM top WHERE rank <= 10 AND q % 20 = 0")
def knn_exact(spark, d):
    v = vecs(spark, d)
    return knn.top_k(v, v.filter("id % 20 = 0").select(F.col("id").alias("q"), "v"), 10)


@query(f"WITH {G_KNN}, d AS (SELECT src AS id, count(*) AS k FROM e GROUP BY src) SELECT src, dst, round(1 / (sqrt(a.k) * sqrt(b.k)), 6) AS norm FROM e JOIN d a ON a.id = src JOIN d b ON b.id = dst")
def gcn_norm(spark, d):
    return gnn.edge_norms(knn_graph(spark, d)).select("src", "dst", F.round("norm", 6).alias("norm"))


@query(f"WITH {G_KNN}, l AS (SELECT src, dst FROM e UNION SELECT id, id FROM q), d AS (SELECT src AS id, count(*) AS k FROM l GROUP BY src), {H} SELECT l.src AS id, h.pos, round(sum(h.x / (sqrt(a.k) * sqrt(b.k))), 5) + 0.0 AS value FROM l JOIN d a ON a.id = l.src JOIN d b ON b.id = l.dst JOIN h ON h.id = l.dst GROUP BY 1, 2")
def gcn_aggregate(spark, d):
    return _long(gnn.gcn_aggregate(gnn.with_loops(knn_graph(spark, d)), features(spark, d), FEAT))


@query(f"WITH {G_KNN}, d AS (SELECT src AS id, count(*) AS k FROM e GROUP BY src), {H} SELECT e.src AS id, h.pos, round(sum(h.x / a.k), 5) + 0.0 AS value FROM e JOIN d a ON a.id = e.src JOIN h ON h.id = e.dst GROUP BY 1, 2")
def sage_aggregate(spark, d):
    return _long(gnn.sage_aggregate(knn_graph(spark, d), features(spark, d), FEAT))


ATT_L, ATT_R = [round(0.5 - 0.015 * k, 3) for k in range(FEAT)], [round(-0.3 + 0.01 * k, 3) for k in range(FEAT)]
_att = lambda v: " + ".join(f"v[{k + 1}] * ({x!r}::DOUBLE)" for k, x in enumerate(v))


@query(f"WITH {G_KNN}, l AS (SELECT src, dst FROM e UNION SELECT id, id FROM q), s AS (SELECT id, {_att(ATT_L)} AS l, {_att(ATT_R)} AS r FROM q), a AS (SELECT src, dst, CASE WHEN x.l + y.r > 0 THEN x.l + y.r ELSE 0.2::DOUBLE * (x.l + y.r) END AS s FROM l JOIN s x ON x.id = src JOIN s y ON y.id = dst), w AS (SELECT src, dst, exp(s) / sum(exp(s)) OVER (PARTITION BY src) AS w FROM a), {H} SELECT w.src AS id, h.pos, round(sum(w.w * h.x), 5) + 0.0 AS value FROM w JOIN h ON h.id = w.dst GROUP BY 1, 2")
def gat_aggregate(spark, d):
    return _long(gnn.gat_aggregate(gnn.with_loops(knn_graph(spark, d)), features(spark, d), ATT_L, ATT_R, FEAT))


@query("SELECT vec_id AS id, pos, round(embedding[CAST(pos AS INTEGER) + 1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) + 0.0 AS value FROM embeddings, range(64) t(pos)")
def l2norm(spark, d):
    return _long(vecs(spark, d).select("id", V.l2_normalized(F.col("v")).alias("h")))


LOGITS = "x AS (SELECT vec_id AS id, label, list_transform(embedding[1:10], lambda z: z::DOUBLE * 5) AS s FROM embeddings)"


def _logits(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 5).alias("s"))


@query(f"WITH {LOGITS} SELECT id, round(ln(list_sum(list_transform(s, lambda z: exp(z)))) - s[label + 1], 5) + 0.0 AS loss FROM x")
def softmax_xent(spark, d):
    return _logits(spark, d).select("id", (F.round(V.cross_entropy(V.softmax(F.col("s")), F.col("label")), 5) + 0.0).alias("loss"))


@query(f"WITH {LOGITS}, t AS (SELECT id, s, list_transform(range(10), lambda i: CASE WHEN i = label OR i = (label + 3) % 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS y FROM x) SELECT id, round(list_sum(list_transform(range(1, 11), lambda i: greatest(s[i], 0) - s[i] * y[i] + ln(1 + exp(-abs(s[i]))))), 5) + 0.0 AS loss FROM t")
def sigmoid_xent(spark, d):
    y = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when((i == F.col("label")) | (i == (F.col("label") + 3) % 10), 1.0).otherwise(0.0))
    return _logits(spark, d).select("id", (F.round(V.sigmoid_cross_entropy(F.col("s"), y), 5) + 0.0).alias("loss"))


@query(f"WITH {LOGITS} SELECT round(avg(CASE WHEN list_position(s, list_max(s)) - 1 = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM x")
def accuracy(spark, d):
    return gnn.accuracy(_logits(spark, d), "s", "label").select(F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {LOGITS}, t AS (SELECT unnest(s) AS s, unnest(list_transform(range(10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END)) AS y FROM x) SELECT round(2.0::DOUBLE * count(*) FILTER (s > 0.5 AND y = 1) / (2 * count(*) FILTER (s > 0.5 AND y = 1) + count(*) FILTER (s > 0.5 AND y = 0) + count(*) FILTER (s <= 0.5 AND y = 1)), 6) AS f1 FROM t")
def micro_f1(spark, d):
    y = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 1).otherwise(0))
    return gnn.micro_f1(_logits(spark, d).withColumn("y", y), "s", "y").select(F.round("f1", 6).alias("f1"))


def _trained(spark, d, arch: str) -> DataFrame:
    g = knn_graph(spark, d)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 4).cast("long").alias("label")).filter("id % 5 < 3")
    losses = gnn.Network(g, [FEAT, 6, 4], arch, lr=0.05).train(features(spark, d), labels, 2)
    return spark.createDataFrame([(k, round(x, 5)) for k, x in enumerate(losses)], "epoch long, loss double")


@query()
def gnn_train_loss(spark, d):
    return _trained(spark, d, "gcn")


@query()
def sage_train_loss(spark, d):
    return _trained(spark, d, "sage")


@query()
def gat_train_loss(spark, d):
    return _trained(spark, d, "gat")


@query()
def ggnn_step(spark, d):
    g = knn_graph(spark, d)
    n = g.vertices.count()
    return _long(gnn.gated_step(features(spark, d), g, gnn.DrawnGates(3, n, 1 / n)))


# --- clustering, forests, partitions, codes --------------------------------------------------------------------------------------


@query()
def hac(spark, d):
    return clustering.dendrogram(cp2(spark, d).edges)


@query(f"WITH {CP2}, d AS (SELECT src AS id, count(*) AS k FROM e GROUP BY src) SELECT src, dst, CAST(1 + ceil(log2(1 + a.k + b.k)) AS BIGINT) AS w FROM e JOIN d a ON a.id = src JOIN d b ON b.id = dst")
def unweighted_rule(spark, d):
    return clustering.unweighted_rule(cp2(spark, d).edges)


def _forest_sql(most: int) -> str:
    """The weight by counting components: each whole weight t adds as many edges above t as there are components of lighter edges beyond the last."""
    parts = [f"WITH RECURSIVE {CP2}, {V2}"]
    for t in range(2, most + 1):
        parts.append(f"r{t}(id, c) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT e.dst, min(r.c) FROM r{t} r JOIN e ON e.src = r.id AND e.w <= {t} JOIN recurring.r{t} AS k ON k.id = e.dst WHERE r.c < k.c GROUP BY e.dst)")
    counts = " UNION ALL ".join([f"SELECT {t} AS t, count(*) AS c FROM v" for t in (0, 1)] + [f"SELECT {t}, count(DISTINCT c) FROM r{t}" for t in range(2, most + 1)])
    return ", ".join(parts) + f", k AS MATERIALIZED ({counts}), z AS (SELECT min(c) AS c FROM k) SELECT CAST(sum(k.c - z.c) AS BIGINT) AS weight, (SELECT count(*) FROM v) - min(z.c) AS edges, min(z.c) AS components FROM k, z"


@query(_forest_sql(9))
def mst_weight(spark, d):
    g = cp2(spark, d)
    return spanning.forest_summary(g.edges, g.vertices)


@query()
def single_linkage(spark, d):
    return clustering.single_linkage(cp2(spark, d).edges)


N = "n AS (SELECT max(src) + 1 AS n FROM e)"
PARTS = 4
_size = f"(n.n + {PARTS - 1}) // {PARTS}"


def _n(g: Graph) -> int:
    return g.edges.agg(F.max("src")).first()[0] + 1


@query(f"WITH {CP2}, {N} SELECT CAST(src // ({_size}) AS BIGINT) AS part, src, dst FROM e, n")
def partition_1d(spark, d):
    g = cp2(spark, d)
    return partition.one_dimensional(g.edges, _n(g), PARTS)


@query(f"WITH {CP2}, {N} SELECT CAST(dst // ({_size}) AS BIGINT) AS part, src, dst FROM e, n")
def partition_segments(spark, d):
    g = cp2(spark, d)
    return partition.by_destination(g.edges, _n(g), PARTS)


@query(f"WITH {CP2}, {N} SELECT CAST((src // ({_size})) * {PARTS} + dst // ({_size}) AS BIGINT) AS part, src, dst FROM e, n")
def partition_2d(spark, d):
    g = cp2(spark, d)
    return partition.two_dimensional(g.edges, _n(g), PARTS)


@query(f"WITH {CP2}, {N}, m AS (SELECT CAST(src // ({_size}) AS BIGINT) AS part, src AS id FROM e, n UNION SELECT CAST(src // ({_size}) AS BIGINT), dst FROM e, n) SELECT a.part, e.src, e.dst FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst AND b.part = a.part")
def partition_induced(spark, d):
    g = cp2(spark, d)
    return partition.with_halo(g.edges, _n(g), PARTS)


@query(f"WITH {CP2}, {N} SELECT src, dst FROM e, n WHERE src // ({_size}) IN (1, 3) AND dst // ({_size}) IN (1, 3)")
def partition_fetch(spark, d):
    g = cp2(spark, d)
    return partition.cells(g.edges, [1, 3], _n(g), PARTS)


_z = "(CASE WHEN dst - src >= 0 THEN 2 * (dst - src) ELSE -(2 * (dst - src) + 1) END)"


@query(f"WITH {CP}, g AS (SELECT src, CASE WHEN p IS NULL THEN {_z} ELSE dst - p - 1 END AS x FROM (SELECT src, dst, lag(dst) OVER (PARTITION BY src ORDER BY dst) AS p FROM e)), s AS (SELECT src, sum(2 * (length(format('{{:b}}', x + 1)) - 1) + 1) AS gamma, sum(((length(format('{{:b}}', x + 1)) - 1) // 2 + 1) * 3) AS zeta, 8 * sum(CASE WHEN x < 256 THEN 1 WHEN x < 65536 THEN 2 WHEN x < 16777216 THEN 3 ELSE 4 END) + 8 * ((count(*) + 3) // 4) AS vbyte, count(*) AS deg FROM g GROUP BY src) SELECT 'gamma' AS scheme, CAST(sum(gamma) AS BIGINT) AS bits FROM s UNION ALL SELECT 'zeta', CAST(sum(zeta) AS BIGINT) FROM s UNION ALL SELECT 'vbyte', CAST(sum(vbyte) AS BIGINT) FROM s UNION ALL SELECT 'hybrid', CAST(sum(CASE WHEN deg > 32 THEN vbyte ELSE zeta END) AS BIGINT) FROM s")
def code_lengths(spark, d):
    return compression.code_lengths(cp(spark, d))


# --- further operators ---------------------------------------------------------------------------------------------------------


def _label_difference_sql(induced: bool) -> str:
    free = "AND NOT EXISTS (SELECT 1 FROM e b WHERE b.src = p.dst AND b.dst = a.dst)" if induced else ""
    return f"WITH {CP2}, {V2}, {LAB} SELECT p.src AS u, p.dst AS v, count(a.dst) AS n FROM (SELECT src, dst FROM e WHERE src < dst) p LEFT JOIN (SELECT e.src, e.dst FROM e JOIN lab ON lab.id = e.dst WHERE label = 7) a ON a.src = p.src AND a.dst <> p.dst {free} GROUP BY 1, 2"


def _labelled_pairs(spark, d) -> DataFrame:
    g = labelled(spark, d)
    lab = g.edges.join(g.vertices.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "label"))).alias("x"))
    y = g.adjacency().select(F.col("id").alias("dst"), F.col("nbrs").alias("y"))
    return g.edges.filter("src < dst").select("src", "dst").join(lab, "src").join(y, "dst")


@query(_label_difference_sql(True))
def label_difference(spark, d):
    n = F.size(S.labelled_difference(F.col("x.dst"), F.col("y"), F.col("dst"), F.col("x.label"), 7)).cast("long")
    return _labelled_pairs(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v"), n.alias("n"))


@query(_label_difference_sql(False))
def edge_label_difference(spark, d):
    n = F.size(S.edge_difference(F.col("x.dst"), F.col("dst"), F.col("x.label"), 7)).cast("long")
    return _labelled_pairs(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v"), n.alias("n"))


SCC = f"WITH RECURSIVE {EVT}, f AS (SELECT src, dst FROM g_evt WHERE w >= 2), v AS (SELECT src AS id FROM g_evt UNION SELECT dst FROM g_evt), r AS (SELECT src, dst FROM f UNION SELECT r.src, f.dst FROM r JOIN f ON f.src = r.dst)"


@query(f"{SCC} SELECT v.id, least(v.id, coalesce(min(b.src), v.id)) AS component FROM v LEFT JOIN r a ON a.src = v.id LEFT JOIN r b ON b.src = a.dst AND b.dst = v.id GROUP BY v.id")
def strongly_connected(spark, d):
    e = stored(P.transitions(spark, d))
    v = Graph.of_edges(e, directed=True).vertices
    return community.strongly_connected(Graph(v, e.filter("w >= 2"), directed=True))


@query()
def louvain(spark, d):
    return community.louvain(cp2(spark, d).edges)


@query(f"WITH {CP2}, g AS (SELECT src % 5 AS c, dst % 5 AS d, w::DOUBLE AS w FROM e), k AS (SELECT c, sum(w) FILTER (c = d) AS inside, sum(w) AS every FROM g GROUP BY c) SELECT round(sum(coalesce(inside, 0)) / sum(every) - sum(every * every) / (sum(every) * sum(every)), 6) AS modularity FROM k")
def modularity(spark, d):
    g = cp2(spark, d)
    return community.modularity(g.edges, g.vertices.select("id", (F.col("id") % 5).alias("community"))).select(F.round("modularity", 6).alias("modularity"))


_g = "g AS (SELECT src, CASE WHEN p IS NULL THEN (CASE WHEN dst - src >= 0 THEN 2 * (dst - src) ELSE -(2 * (dst - src) + 1) END) ELSE dst - p - 1 END AS x FROM (SELECT src, dst, lag(dst) OVER (PARTITION BY src ORDER BY dst) AS p FROM e))"
_c = "c AS (SELECT src, count(*) AS deg, (sum(2 * (length(format('{:b}', x + 1)) - 1) + 1) + 7) // 8 AS gamma, (sum(((length(format('{:b}', x + 1)) - 1) // 2 + 1) * 3) + 7) // 8 AS zeta, sum(CASE WHEN x < 256 THEN 1 WHEN x < 65536 THEN 2 WHEN x < 16777216 THEN 3 ELSE 4 END) + (count(*) + 3) // 4 AS vbyte FROM g GROUP BY src)"


@query(f"WITH {CP2}, {_g}, {_c}, t AS (SELECT sum(gamma) AS gamma, sum(zeta) AS zeta, sum(vbyte) AS vbyte, sum(CASE WHEN deg > 32 THEN vbyte ELSE zeta END) AS hybrid, sum(deg) AS n FROM c) " + " UNION ALL ".join(f"SELECT '{x}' AS scheme, CAST({x} AS BIGINT) AS bytes, CAST(n AS BIGINT) AS edges, CAST(0 AS BIGINT) AS wrong FROM t" for x in compression.SCHEMES))
def codec_round_trip(spark, d):
    return compression.round_trip(cp2(spark, d))


_members = f"m AS (SELECT CAST(src // ({_size}) AS BIGINT) AS part, src AS id FROM e, n UNION SELECT CAST(src // ({_size}) AS BIGINT), dst FROM e, n), l AS (SELECT part, id, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS local FROM m)"


@query(f"WITH {CP2}, {N}, {_members} SELECT a.part, a.local AS src, b.local AS dst FROM e JOIN l a ON a.id = e.src JOIN l b ON b.id = e.dst AND b.part = a.part")
def partition_local(spark, d):
    g = cp2(spark, d)
    return partition.with_halo_local(g.edges, _n(g), PARTS)[0]


@query(f"WITH {CP2}, {N}, {_members} SELECT part, id, local FROM l")
def partition_map(spark, d):
    g = cp2(spark, d)
    return partition.with_halo_local(g.edges, _n(g), PARTS)[1]


@query(f"WITH {CP2} SELECT (row_number() OVER (ORDER BY src, dst) - 1) % {PARTS} AS part, src, dst FROM e")
def split_round_robin(spark, d):
    return partition.round_robin(cp2(spark, d).edges, PARTS)


@query(f"WITH {CP2} SELECT CAST(src // 64 AS BIGINT) % {PARTS} AS part, src, dst FROM e")
def split_chunks(spark, d):
    g = cp2(spark, d)
    return partition.vertex_chunks(g.edges, _n(g), 64, PARTS)


@query()
def hac_average(spark, d):
    return clustering.dendrogram(cp2(spark, d).edges, "average")


@query(f"WITH RECURSIVE {CP2}, {V2}, r(id, c) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT e.dst, min(r.c) FROM r JOIN e ON e.src = r.id JOIN recurring.r AS k ON k.id = e.dst WHERE r.c < k.c GROUP BY e.dst), t AS (SELECT c AS component, 1 - count(*) AS node, row_number() OVER (ORDER BY c) - 1 AS pos, count(*) OVER () AS n FROM r GROUP BY c), every AS (SELECT pos, component, node, n FROM t UNION ALL SELECT n + i, -1, -1 - i, n FROM (SELECT max(n) AS n FROM t), range(n - 1) x(i)) SELECT pos, component, CAST(node AS BIGINT) AS node, CASE WHEN pos < 2 * n - 2 THEN n + pos // 2 ELSE -1 END AS parent, 0.0::DOUBLE AS weight FROM every")
def hac_completed(spark, d):
    g = cp2(spark, d)
    return clustering.completed(stored(clustering.dendrogram(g.edges)), g.vertices).fillna(-1, ["parent"])


#: Queries that bench.py times.
HEADLINE = ["triangle_count", "pagerank_10", "connected_components", "bfs", "sssp", "cf_rounds", "knn_exact", "gcn_aggregate", "orient", "core_members"]
