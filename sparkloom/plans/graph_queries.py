"""Graph operators as registered queries over the driver tables, each with an equivalent SQL text where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering, components, covering, graph, ranking, substructure, traversal
from ..sources.tables import directed, undirected
from .loops import cut

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

GRAPH = """k AS (SELECT max(c_custkey) + 1 AS k FROM customer),
 raw AS (SELECT o_custkey AS u, CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey * 7 + o_orderkey * 13) % k ELSE (o_custkey - o_custkey % 20 + o_orderkey % 20) % k END AS t,
           o_orderkey * 7919 % 50 + 1 AS w FROM orders, k),
 d AS MATERIALIZED (SELECT u AS src, t AS dst, min(w) AS w FROM raw WHERE u <> t GROUP BY ALL),
 e AS MATERIALIZED (SELECT src, dst, min(w) AS w FROM (SELECT * FROM d UNION ALL SELECT dst, src, w FROM d) GROUP BY ALL),
 v AS (SELECT c_custkey AS id FROM customer)"""


def sql(final: str, *more: str) -> str:
    return f"WITH {', '.join([GRAPH, *more])} {final}"


def unrolled(init: str, step: str, n: int, final: str, *more: str) -> str:
    """n rounds of `step` over {prev} from `init`; `final` reads {last}."""
    parts = [f"s0 AS MATERIALIZED ({init})", *(f"s{i + 1} AS MATERIALIZED ({step.format(prev=f's{i}', i=i + 1)})" for i in range(n))]
    return sql(final.format(last=f"s{n}"), *more, *parts)


def query(oracle: str | None = None):
    def register(f):
        name = f.__name__
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return register


def one(spark, **values):
    """A row of numbers."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(x, float) else 'long'}" for k, x in values.items()))


MIN_STEP = "SELECT id, min(x) AS x FROM (SELECT id, x FROM {{prev}} UNION ALL SELECT {e}.dst, {m} FROM {{prev}} p JOIN {e} ON {e}.src = p.id WHERE p.x IS NOT NULL) GROUP BY id"


@query(sql("SELECT v.id, (SELECT count(*) FROM d WHERE src = v.id) AS out_degree, (SELECT count(*) FROM d WHERE dst = v.id) AS in_degree FROM v"))
def graph_degrees(spark, sf_dir):
    return graph.degrees(*directed(spark, sf_dir))


@query(sql("SELECT src, count(*) AS n, max(dst) AS last, min(w) AS least FROM e GROUP BY src"))
def graph_symmetrize(spark, sf_dir):
    _, e = undirected(spark, sf_dir)
    return e.groupBy("src").agg(F.count("*").alias("n"), F.max("dst").alias("last"), F.min("w").alias("least"))


@query(sql("SELECT src AS id, array_to_string(list_sort(list(dst)), ',') AS neighbours FROM e GROUP BY src"))
def graph_adjacency(spark, sf_dir):
    return graph.adjacency(undirected(spark, sf_dir)[1]).select("id", F.array_join("neighbours", ",").alias("neighbours"))


@query(sql("SELECT dst AS id, min(src) AS data FROM d WHERE src % 10 = 0 AND dst % 3 <> 0 GROUP BY dst"))
def edge_map(spark, sf_dir):
    v, e = directed(spark, sf_dir)
    return graph.edge_map(v.filter("id % 10 = 0"), e, v.filter("id % 3 <> 0"))


@query(sql("SELECT v.id, coalesce(sum(d.w), 0)::BIGINT AS data FROM v LEFT JOIN d ON d.dst = v.id AND d.src % 2 = 0 GROUP BY v.id"))
def edge_map_reduce_dense(spark, sf_dir):
    v, e = directed(spark, sf_dir)
    return graph.edge_map_reduce(v.filter("id % 2 = 0"), e, F.col("w"), F.sum, v, F.lit(0).cast("long"))


@query(sql("SELECT dst AS id, count(*) AS data FROM d WHERE src % 5 = 0 GROUP BY dst"))
def edge_map_count(spark, sf_dir):
    v, e = directed(spark, sf_dir)
    return graph.edge_map_count(v.filter("id % 5 = 0"), e)


@query(sql("SELECT v.id, count(d.dst) AS data FROM v LEFT JOIN d ON d.src = v.id AND d.w > 20 WHERE v.id % 4 = 0 GROUP BY v.id"))
def edge_map_filter(spark, sf_dir):
    v, e = directed(spark, sf_dir)
    return graph.edge_map_filter(v.filter("id % 4 = 0"), e, F.col("w") > 20)


@query(sql("SELECT src, dst FROM d WHERE src % 50 = 0"))
def edge_map_induced(spark, sf_dir):
    v, e = directed(spark, sf_dir)
    return graph.edge_map_induced(v.filter("id % 50 = 0"), e).select("src", "dst")


@query(sql("SELECT src AS id, count(*) AS degree FROM d WHERE dst > src GROUP BY src"))
def pack_edges(spark, sf_dir):
    return graph.pack_edges(directed(spark, sf_dir)[1], F.col("dst") > F.col("src"))[1]


@query(sql("SELECT id, id * 2 AS data FROM v WHERE id % 3 = 0"))
def vertex_map_filter(spark, sf_dir):
    v, _ = directed(spark, sf_dir)
    return graph.vertex_map(graph.vertex_filter(v, F.col("id") % 3 == 0), F.col("id") * 2)


@query(sql("SELECT sum(id % 7)::BIGINT AS total FROM v WHERE id % 2 = 0"))
def process_vertices(spark, sf_dir):
    v, _ = directed(spark, sf_dir)
    return graph.process_vertices(v.filter("id % 2 = 0"), F.col("id") % 7)


@query(sql("SELECT src % 20 AS src, dst % 20 AS dst, min(w) AS w FROM d WHERE src % 20 <> dst % 20 GROUP BY ALL"))
def contract_graph(spark, sf_dir):
    v, e = directed(spark, sf_dir)
    return graph.contract(e, v.select("id", (F.col("id") % 20).alias("name")))


@query(sql("SELECT v.id, row_number() OVER (ORDER BY count(e.dst), v.id) - 1 AS rank FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id"))
def degree_rank(spark, sf_dir):
    return graph.degree_rank(*undirected(spark, sf_dir))


@query(unrolled("SELECT id, CASE WHEN id = 0 THEN 0 END AS x FROM v", MIN_STEP.format(e="e", m="x + 1"), 24, "SELECT id, x AS level FROM {last}"))
def bfs(spark, sf_dir):
    return traversal.bfs_levels(*undirected(spark, sf_dir), 0)


@query(unrolled("SELECT id, CASE WHEN id = 0 THEN 0 END AS x FROM v", MIN_STEP.format(e="d", m="x + 1"), 40, "SELECT a.id, a.x AS level, CASE WHEN a.id = 0 THEN 0 ELSE min(b.id) END AS parent FROM {last} a LEFT JOIN d ON d.dst = a.id LEFT JOIN {last} b ON b.id = d.src AND b.x + 1 = a.x GROUP BY a.id, a.x"))
def bfs_parents(spark, sf_dir):
    return traversal.bfs_parents(*directed(spark, sf_dir), 0)


@query(unrolled("SELECT id, CASE WHEN id = 5 THEN 0 END AS x FROM v", MIN_STEP.format(e="e", m="x + 1"), 24, "SELECT x AS level, count(*) AS size FROM {last} WHERE x IS NOT NULL GROUP BY x"))
def bfs_frontiers(spark, sf_dir):
    return traversal.bfs_frontiers(*undirected(spark, sf_dir), 5)


_SSSP = unrolled("SELECT id, CASE WHEN id = 0 THEN 0 END AS x FROM v", MIN_STEP.format(e="e", m="x + e.w"), 60, "SELECT id, x::BIGINT AS distance FROM {last}")


@query(_SSSP)
def bellman_ford(spark, sf_dir):
    return traversal.shortest_paths(*undirected(spark, sf_dir), 0, kind="long")


@query(_SSSP)
def delta_stepping(spark, sf_dir):
    return traversal.shortest_paths(*undirected(spark, sf_dir), 0, delta=40.0, kind="long")


@query(unrolled("SELECT id, CASE WHEN id = 0 THEN 0 END AS x FROM v", MIN_STEP.format(e="b", m="x + b.w"), 60, "SELECT id, x::BIGINT AS distance FROM {last}", "b AS MATERIALIZED (SELECT src, dst, w % 4 + 1 AS w FROM e)"))
def weighted_bfs(spark, sf_dir):
    v, e = undirected(spark, sf_dir)
    return traversal.shortest_paths(v, e.withColumn("w", F.col("w") % 4 + 1), 0, delta=1.0, kind="long")


@query(unrolled("SELECT id, CASE WHEN id = 0 THEN 2147483647 ELSE 0 END AS x FROM v", "SELECT id, max(x) AS x FROM (SELECT * FROM {prev} UNION ALL SELECT e.dst, least(p.x, e.w) FROM {prev} p JOIN e ON e.src = p.id) GROUP BY id", 60, "SELECT id, x::BIGINT AS width FROM {last}"))
def widest_path(spark, sf_dir):
    return traversal.widest_paths(*undirected(spark, sf_dir), 0)


def _brandes(levels: int = 24) -> str:
    bfs_ = unrolled("SELECT id, CASE WHEN id = 0 THEN 0 END AS x FROM v", MIN_STEP.format(e="e", m="x + 1"), levels, "")
    parts = [bfs_.rstrip(), f", l AS MATERIALIZED (SELECT id, x FROM s{levels}), g AS MATERIALIZED (SELECT src, dst, b.x AS lv FROM e JOIN l a ON a.id = src JOIN l b ON b.id = dst WHERE a.x + 1 = b.x), p0 AS (SELECT id, 1.0::DOUBLE AS n FROM l WHERE x = 0)"]
    for i in range(1, levels):
        parts.append(f", p{i} AS MATERIALIZED (SELECT * FROM p{i - 1} UNION ALL SELECT dst, sum(n) FROM g JOIN p{i - 1} ON src = id WHERE lv = {i} GROUP BY dst)")
    parts.append(f", q{levels} AS (SELECT id, 0.0::DOUBLE AS dep FROM l WHERE x >= {levels - 1})")
    for i in range(levels - 1, 0, -1):
        parts.append(f", q{i} AS MATERIALIZED (SELECT * FROM q{i + 1} UNION ALL SELECT l.id, coalesce(sum(a.n / b.n * (1 + q.dep)), 0) FROM l LEFT JOIN g ON g.src = l.id AND lv = {i} LEFT JOIN p{levels - 1} a ON a.id = g.src LEFT JOIN p{levels - 1} b ON b.id = g.dst LEFT JOIN q{i + 1} q ON q.id = g.dst WHERE l.x = {i - 1} GROUP BY l.id)")
    parts.append(f" SELECT l.id, l.x AS level, p.n AS paths, round(q.dep, 6) AS dependency FROM l LEFT JOIN p{levels - 1} p USING (id) LEFT JOIN q1 q USING (id)")
    return "".join(parts)


@query(_brandes())
def betweenness(spark, sf_dir):
    return traversal.betweenness(*undirected(spark, sf_dir), 0).withColumn("dependency", F.round("dependency", 6))


_CC = unrolled("SELECT id, id AS x FROM v", MIN_STEP.format(e="e", m="x"), 30, "SELECT id, x AS label FROM {last}")


@query(_CC)
def connected_components(spark, sf_dir):
    return components.connected_components(*undirected(spark, sf_dir))


@query(_CC)
def label_propagation(spark, sf_dir):
    return components.label_propagation_components(*undirected(spark, sf_dir))


@query(unrolled("SELECT id, id AS x FROM v", MIN_STEP.format(e="h", m="x"), 80, "SELECT x AS label, count(*) AS size FROM {last} GROUP BY x", "h AS MATERIALIZED (SELECT src, dst FROM e WHERE w > 35)"))
def component_sizes_of_heavy_edges(spark, sf_dir):
    v, e = undirected(spark, sf_dir)
    return components.component_sizes(components.components_of_predicate(v, e, F.col("w") > 35))


@query(unrolled("SELECT id, id AS x FROM v", MIN_STEP.format(e="e", m="x"), 30, "SELECT count(*) - count(DISTINCT x) AS edges, count(*) - count(DISTINCT x) AS children FROM {last}"))
def spanning_forest(spark, sf_dir):
    f = components.spanning_forest(*undirected(spark, sf_dir))
    return f.agg(F.count("*").alias("edges"), F.countDistinct("child").alias("children"))


@query()
def minimum_spanning_forest(spark, sf_dir):
    return components.minimum_spanning_forest(*undirected(spark, sf_dir))


@query("WITH RECURSIVE " + GRAPH + """, r(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, d.dst FROM r JOIN d ON d.src = r.b)
 SELECT x.a AS id, min(x.b) AS label FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def strong_components(spark, sf_dir):
    return components.strong_components(*directed(spark, sf_dir))


@query()
def biconnectivity(spark, sf_dir):
    return components.biconnected_components(*undirected(spark, sf_dir))


@query()
def low_diameter_decomposition(spark, sf_dir):
    return components.low_diameter_decomposition(*undirected(spark, sf_dir)).select("id", "label")


@query()
def graph_spanner(spark, sf_dir):
    return components.spanner(*undirected(spark, sf_dir))


_PR = "SELECT v.id, {c} + 0.85 * coalesce(sum(p.x / o.n), 0) AS x FROM v LEFT JOIN d ON d.dst = v.id LEFT JOIN {{prev}} p ON p.id = d.src LEFT JOIN o ON o.src = d.src GROUP BY v.id"
_OUT = "o AS MATERIALIZED (SELECT src, count(*) AS n FROM d GROUP BY src)"


@query(unrolled("SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM v", _PR.format(c="0.15 / (SELECT count(*) FROM v)"), 10, "SELECT id, round(x * (SELECT count(*) FROM v), 9) AS rank FROM {last}", _OUT))
def pagerank(spark, sf_dir):
    v, e = directed(spark, sf_dir)
    n = v.count()
    return ranking.pagerank(v, e, tolerance=None, most=10).withColumn("rank", F.round(F.col("rank") * n, 9))


@query(unrolled("SELECT id, 1.0::DOUBLE AS x FROM v", _PR.format(c="0.15"), 8, "SELECT id, round(x, 9) AS rank FROM {last}", _OUT))
def pagerank_unnormalised(spark, sf_dir):
    return ranking.pagerank_unnormalised(*directed(spark, sf_dir), iterations=8).withColumn("rank", F.round("rank", 9))


@query(unrolled("SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM v", "SELECT v.id, 0.15 / (SELECT count(*) FROM v) + 0.85 * coalesce(sum(p.x * d.w / 200.0), 0) AS x FROM v LEFT JOIN d ON d.dst = v.id LEFT JOIN {prev} p ON p.id = d.src GROUP BY v.id", 6, "SELECT id, round(x * 1000, 9) AS rank FROM {last}"))
def pagerank_matrix(spark, sf_dir):
    v, e = directed(spark, sf_dir)
    return ranking.pagerank_matrix(v, e.withColumn("w", F.col("w") / 200.0), iterations=6).withColumn("rank", F.round(F.col("rank") * 1000, 9))


@query()
def pagerank_converged(spark, sf_dir):
    return ranking.pagerank(*directed(spark, sf_dir))


@query()
def pagerank_delta(spark, sf_dir):
    return ranking.pagerank_delta(*directed(spark, sf_dir))


@query(sql("SELECT round(c, 9) AS similarity FROM t", "o AS MATERIALIZED (SELECT src, count(*) AS n FROM d GROUP BY src)", "a0 AS (SELECT 's' AS s, 1::BIGINT AS id, 1.0::DOUBLE AS p UNION ALL SELECT 't', 8, 1.0)", *[f"a{i} AS MATERIALIZED (SELECT s, d.dst AS id, sum(p / o.n) AS p FROM a{i - 1} JOIN d ON d.src = id JOIN o ON o.src = d.src GROUP BY ALL)" for i in range(1, 6)], "t AS (SELECT " + " + ".join(f"coalesce(0.85 ** {i} * (SELECT sum(x.p * y.p) FROM a{i} x JOIN a{i} y USING (id) WHERE x.s = 's' AND y.s = 't'), 0)" for i in range(1, 6)) + " AS c)"))
def cosimrank(spark, sf_dir):
    v, e = directed(spark, sf_dir)
    return one(spark, similarity=round(float(ranking.cosimrank(v, e, 1, 8, tolerance=0.0, most=5)), 9))


@query(unrolled("SELECT v.id, count(e.dst) AS x FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id", "SELECT v.id, coalesce(h.x, 0) AS x FROM v LEFT JOIN (SELECT src AS id, max(least(n, x)) AS x FROM (SELECT src, x, row_number() OVER (PARTITION BY src ORDER BY x DESC) AS n FROM e JOIN {prev} ON dst = id) GROUP BY src) h USING (id)", 40, "SELECT id, x::BIGINT AS core FROM {last}"))
def core_numbers(spark, sf_dir):
    return substructure.core_numbers(*undirected(spark, sf_dir)).select("id", "core")


@query()
def degeneracy_order(spark, sf_dir):
    return substructure.degeneracy_order(*undirected(spark, sf_dir))


@query()
def goodrich_pszona_order(spark, sf_dir):
    return substructure.goodrich_pszona_order(*undirected(spark, sf_dir), 1.0)


@query()
def barenboim_elkin_order(spark, sf_dir):
    return substructure.barenboim_elkin_order(*undirected(spark, sf_dir))


_PEEL = "SELECT y.id, y.x, avg(y.x) OVER () AS m FROM (SELECT p.id, (SELECT count(*) FROM e JOIN {prev} q ON q.id = e.dst WHERE e.src = p.id AND q.x > 1.001 * q.m) AS x FROM {prev} p WHERE p.x > 1.001 * p.m) y"


@query(unrolled("SELECT id, x, avg(x) OVER () AS m FROM (SELECT v.id, count(e.dst) AS x FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id)", _PEEL, 16, "SELECT round(max(m), 9) AS density FROM (" + " UNION ALL ".join(f"SELECT m FROM s{i}" for i in range(17)) + ")"))
def densest_subgraph(spark, sf_dir):
    return one(spark, density=round(float(substructure.densest_peeling(*undirected(spark, sf_dir))), 9))


@query()
def densest_charikar(spark, sf_dir):
    return one(spark, density=float(substructure.densest_charikar(*undirected(spark, sf_dir))))


@query()
def densest_greedy_pp(spark, sf_dir):
    return one(spark, density=float(substructure.densest_greedy_pp(*undirected(spark, sf_dir), 2)))


@query(sql("SELECT count(*) AS triangles FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND b.src < b.dst"))
def triangle_count(spark, sf_dir):
    return substructure.triangles(*undirected(spark, sf_dir)).agg(F.count("*").alias("triangles"))


@query(sql("SELECT count(*) AS cliques FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = a.src AND c.dst = b.dst JOIN e f ON f.src = b.dst JOIN e g ON g.src = a.src AND g.dst = f.dst JOIN e h ON h.src = a.dst AND h.dst = f.dst WHERE a.src < a.dst AND b.src < b.dst AND f.src < f.dst"))
def four_clique_count(spark, sf_dir):
    return substructure.cliques(*undirected(spark, sf_dir), 4).agg(F.count("*").alias("cliques"))


@query(sql("SELECT v.id, coalesce(n, 0) AS cliques FROM v LEFT JOIN (SELECT x AS id, count(*) AS n FROM (SELECT unnest([a.src, a.dst, b.dst]) AS x FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND b.src < b.dst) GROUP BY x) USING (id)"))
def triangles_per_vertex(spark, sf_dir):
    return substructure.clique_counts(*undirected(spark, sf_dir), 3)


@query()
def clique_core_numbers(spark, sf_dir):
    return substructure.clique_core_numbers(*undirected(spark, sf_dir), 3)


@query()
def clique_peeling_density(spark, sf_dir):
    return one(spark, density=float(substructure.clique_peeling_density(*undirected(spark, sf_dir), 3)))


@query()
def approximate_clique_count(spark, sf_dir):
    return one(spark, cliques=substructure.approximate_clique_count(*undirected(spark, sf_dir), 3))


@query(sql("SELECT count(*) // 10 AS cycles FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst JOIN e f ON f.src = c.dst JOIN e g ON g.src = f.dst AND g.dst = a.src WHERE a.src <> b.dst AND a.src <> c.dst AND a.dst <> c.dst AND a.dst <> f.dst AND b.dst <> f.dst"))
def five_cycle_count(spark, sf_dir):
    return one(spark, cycles=substructure.five_cycles(*undirected(spark, sf_dir)))


_MIS = "SELECT p.id, p.h, CASE WHEN p.x IS NOT NULL THEN p.x WHEN EXISTS (SELECT 1 FROM e JOIN {{prev}} q ON q.id = e.dst WHERE e.src = p.id AND q.x = 1) THEN 0 WHEN NOT EXISTS (SELECT 1 FROM e JOIN {{prev}} q ON q.id = e.dst WHERE e.src = p.id AND q.x IS NULL AND (q.h, q.id) < (p.h, p.id)) THEN 1 END AS x FROM {{prev}} p".replace("{{", "{").replace("}}", "}")


@query(unrolled("SELECT id, 0::BIGINT AS h, NULL::INT AS x FROM v", _MIS, 60, "SELECT id, x = 1 AS chosen FROM {last}"))
def independent_set_first(spark, sf_dir):
    return covering.independent_set(*undirected(spark, sf_dir))


@query(unrolled("SELECT id, id * 7919 % 10007 AS h, NULL::INT AS x FROM v", _MIS, 40, "SELECT id, x = 1 AS chosen FROM {last}"))
def independent_set_permuted(spark, sf_dir):
    return covering.independent_set(*undirected(spark, sf_dir), F.struct((F.col("id") * 7919 % 10007).alias("h"), F.col("id").alias("id")))


@query()
def maximal_matching(spark, sf_dir):
    _, e = undirected(spark, sf_dir)
    return covering.maximal_matching(e, F.struct(((F.col("src") * 31 + F.col("dst") * 7919) % 10007).alias("h"), "src", "dst"))


@query()
def graph_colouring_largest_first(spark, sf_dir):
    return covering.colouring(*undirected(spark, sf_dir))


@query()
def graph_colouring_log_degree(spark, sf_dir):
    return covering.colouring(*undirected(spark, sf_dir), log_degrees=True, seed=3)


@query(sql("SELECT 0 AS conflicts"))
def graph_colouring_conflicts(spark, sf_dir):
    v, e = undirected(spark, sf_dir)
    return covering.colouring_conflicts(e, covering.colouring(v, e, seed=1)).agg(F.count("*").alias("conflicts"))


@query("SELECT 0 AS uncovered, count(DISTINCT l_partkey) AS elements FROM lineitem")
def set_cover_coverage(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    m = cut(m)
    cover = covering.set_cover(m)
    covered = m.join(cover, "src", "left_semi").select("dst").distinct().withColumn("hit", F.lit(1))
    return m.select("dst").distinct().join(covered, "dst", "left").agg(F.count(F.when(F.col("hit").isNull(), 1)).alias("uncovered"), F.count("*").alias("elements"))


_SIM = """c AS MATERIALIZED (SELECT a.src, a.dst, count(z.dst) AS n FROM e a LEFT JOIN e b ON b.src = a.src LEFT JOIN e z ON z.src = a.dst AND z.dst = b.dst GROUP BY ALL),
 g AS (SELECT src, count(*) AS n FROM e GROUP BY src),
 sim AS MATERIALIZED (SELECT c.src, c.dst, (c.n + 2) / sqrt((x.n + 1)::DOUBLE * (y.n + 1)) AS cosine, (c.n + 2)::DOUBLE / (x.n + y.n + 2 - c.n - 2) AS jaccard FROM c JOIN g x ON x.src = c.src JOIN g y ON y.src = c.dst)"""


@query(sql("SELECT src, dst, round(cosine, 9) AS similarity FROM sim", _SIM))
def scan_cosine(spark, sf_dir):
    v, e = undirected(spark, sf_dir)
    return clustering.similarities(v, e.select("src", "dst")).withColumn("similarity", F.round("similarity", 9))


@query(sql("SELECT src, dst, round(jaccard, 9) AS similarity FROM sim", _SIM))
def scan_jaccard(spark, sf_dir):
    v, e = undirected(spark, sf_dir)
    return clustering.similarities(v, e, "jaccard").withColumn("similarity", F.round("similarity", 9))


@query(sql("SELECT a.src, a.dst, round((2 * any_value(a.w) + coalesce(sum(b.w * z.w), 0)) / sqrt((any_value(x.s) + 1)::DOUBLE * (any_value(y.s) + 1)), 9) AS similarity FROM e a LEFT JOIN e b ON b.src = a.src LEFT JOIN e z ON z.src = a.dst AND z.dst = b.dst JOIN q x ON x.src = a.src JOIN q y ON y.src = a.dst GROUP BY a.src, a.dst".replace("coalesce(sum(b.w * z.w), 0)", "coalesce(sum(CASE WHEN z.dst IS NOT NULL THEN b.w * z.w END), 0)"), "q AS (SELECT src, sum(w * w) AS s FROM e GROUP BY src)"))
def scan_weighted_cosine(spark, sf_dir):
    v, e = undirected(spark, sf_dir)
    return clustering.similarities(v, e).withColumn("similarity", F.round("similarity", 9))


@query()
def scan_approximate_jaccard(spark, sf_dir):
    return clustering.approximate_similarities(*undirected(spark, sf_dir), samples=64)


@query()
def scan_approximate_cosine(spark, sf_dir):
    return clustering.approximate_similarities(*undirected(spark, sf_dir), "cosine", samples=64)


@query(sql("SELECT src AS id, row_number() OVER (PARTITION BY src ORDER BY jaccard DESC, dst) + 1 AS mu, round(jaccard, 9) AS threshold FROM sim", _SIM))
def scan_index(spark, sf_dir):
    v, e = undirected(spark, sf_dir)
    return clustering.scan_index(clustering.similarities(v, e, "jaccard")).withColumn("threshold", F.round("threshold", 9))


_CORE = "core AS MATERIALIZED (SELECT v.id FROM v LEFT JOIN sim ON sim.src = v.id AND jaccard >= 0.3 GROUP BY v.id HAVING count(sim.dst) + 1 >= 3), strong AS MATERIALIZED (SELECT * FROM sim WHERE jaccard >= 0.3), ce AS MATERIALIZED (SELECT src, dst FROM strong WHERE src IN (FROM core) AND dst IN (FROM core))"
_SCAN = "lab AS MATERIALIZED (SELECT id, x AS label FROM s60), bord AS (SELECT src AS id, arg_max(dst, (jaccard, -dst)) AS core FROM strong WHERE dst IN (FROM core) AND src NOT IN (FROM core) GROUP BY src), cl AS MATERIALIZED (SELECT v.id, coalesce(lab.label, l2.label) AS cluster FROM v LEFT JOIN lab USING (id) LEFT JOIN bord ON bord.id = v.id LEFT JOIN lab l2 ON l2.id = bord.core)"
_CLUSTER = ("SELECT id, id AS x FROM core", MIN_STEP.format(e="ce", m="x"), 60)


def _scan(final: str) -> str:
    text = unrolled(*_CLUSTER, "@", _SIM, _CORE)
    return text.replace(" @", f", {_SCAN} {final}")


@query(_scan("SELECT id, cluster FROM cl"))
def scan_clusters(spark, sf_dir):
    v, e = undirected(spark, sf_dir)
    return clustering.scan_clusters(v, clustering.similarities(v, e, "jaccard"), 3, 0.3)


@query(_scan("SELECT cl.id, CASE WHEN count(DISTINCT b.cluster) >= 2 THEN 'hub' ELSE 'outlier' END AS kind FROM cl LEFT JOIN e ON e.src = cl.id LEFT JOIN cl b ON b.id = e.dst WHERE cl.cluster IS NULL GROUP BY cl.id"))
def scan_hubs_and_outliers(spark, sf_dir):
    v, e = undirected(spark, sf_dir)
    return clustering.hubs_and_outliers(e, cut(clustering.scan_clusters(v, clustering.similarities(v, e, "jaccard"), 3, 0.3)))


@query(_scan("SELECT DISTINCT id, cluster FROM (SELECT id, label AS cluster FROM lab UNION ALL SELECT strong.src, lab.label FROM strong JOIN lab ON lab.id = strong.dst)"))
def scan_memberships(spark, sf_dir):
    v, e = undirected(spark, sf_dir)
    return clustering.scan_memberships(v, clustering.similarities(v, e, "jaccard"), 3, 0.3)


@query(sql("SELECT round((SELECT count(*) FROM e WHERE src // 100 = dst // 100) / (SELECT count(*) FROM e)::DOUBLE - (SELECT sum(n * n) FROM (SELECT src // 100 AS c, count(*)::DOUBLE AS n FROM e GROUP BY c)) / ((SELECT count(*) FROM e)::DOUBLE ** 2), 9) AS modularity"))
def modularity(spark, sf_dir):
    v, e = undirected(spark, sf_dir)
    return one(spark, modularity=round(float(clustering.modularity(v, e, v.select("id", F.floor(F.col("id") / 100).alias("cluster")))), 9))


@query(sql("SELECT id, dense_rank() OVER (ORDER BY id // 7) - 1 AS cluster FROM v WHERE id % 2 = 0 UNION ALL SELECT id, NULL FROM v WHERE id % 2 = 1"))
def compact_labels(spark, sf_dir):
    v, _ = undirected(spark, sf_dir)
    return clustering.compact_labels(v.select("id", F.when(F.col("id") % 2 == 0, F.floor(F.col("id") / 7)).alias("cluster")))
