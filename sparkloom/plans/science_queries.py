"""Vector search, grids, trees, particles, strings and textbook algorithms as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ann, heat, nbody, strings, textbook, tree_search
from ..sources.tables import bodies, directed, points, table
from .graph_queries import one, sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


P = "p AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
L2 = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(f"WITH {P} SELECT qid, id, round(d, 5) AS distance, rank FROM (SELECT a.id AS qid, b.id, {L2} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {L2}, b.id) AS rank FROM p a, p b WHERE a.id % 25 = 0) WHERE rank <= 10")
def exact_knn(spark, sf_dir):
    p = points(spark, sf_dir)
    return ann.exact_knn(p, p.filter("id % 25 = 0"), 10).withColumn("distance", F.round("distance", 5)).select("qid", "id", "distance", "rank")


@query(f"WITH {P} SELECT qid, id, round(d, 5) AS distance, rank FROM (SELECT a.id AS qid, b.id, -list_inner_product(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY -list_inner_product(a.v, b.v), b.id) AS rank FROM p a, p b WHERE a.id % 25 = 0) WHERE rank <= 10")
def exact_mips(spark, sf_dir):
    p = points(spark, sf_dir)
    return ann.exact_knn(p, p.filter("id % 25 = 0"), 10, "ip").withColumn("distance", F.round("distance", 5)).select("qid", "id", "distance", "rank")


@query(f"WITH {P} SELECT a.id AS qid, count(*) AS n FROM p a, p b WHERE a.id % 25 = 0 AND 1 - list_cosine_similarity(a.v, b.v) <= 0.9 GROUP BY a.id")
def range_search(spark, sf_dir):
    p = points(spark, sf_dir)
    return ann.range_search(p, p.filter("id % 25 = 0"), 0.9, "angular").groupBy("qid").agg(F.count("*").alias("n"))


def _truth(spark, sf_dir):
    p = points(spark, sf_dir).coalesce(4)
    q = p.filter("id % 50 = 0")
    return p, q, ann.exact_knn(p, q, 10)


@query()
def lsh_search(spark, sf_dir):
    p, q, _ = _truth(spark, sf_dir)
    return ann.lsh_search(p, q, 10)


@query()
def vamana_search(spark, sf_dir):
    p, q, _ = _truth(spark, sf_dir)
    return ann.graph_search(p, q, 10, "vamana")


@query()
def hcnng_search(spark, sf_dir):
    p, q, _ = _truth(spark, sf_dir)
    return ann.graph_search(p, q, 10, "hcnng")


@query()
def nn_descent_search(spark, sf_dir):
    p, q, _ = _truth(spark, sf_dir)
    return ann.graph_search(p, q, 10, "nn_descent")


@query()
def hnsw_search(spark, sf_dir):
    p, q, _ = _truth(spark, sf_dir)
    return ann.graph_search(p, q, 10, "hnsw")


@query()
def ann_recall(spark, sf_dir):
    p, q, truth = _truth(spark, sf_dir)
    return ann.sweep(p, q, truth, "hnsw", [16, 64])


@query()
def ann_graph_degrees(spark, sf_dir):
    return ann.degree_statistics(ann.graph_edges(points(spark, sf_dir).coalesce(4), "hcnng"))


@query("SELECT 21 * 21 AS cells, true AS close")
def heat_diffusion(spark, sf_dir):
    u = heat.heat(spark, 21, 21, 10)
    return heat.heat_errors(u, 21, 21).crossJoin(u.agg(F.count("*").alias("cells"))).select("cells", (F.col("max_abs") < 1e-5).alias("close"))


@query()
def unbalanced_tree_search(spark, sf_dir):
    return tree_search.tree_search(spark, depth=7)


@query("SELECT 9 AS depth, 1023 AS nodes, 512 AS leaves")
def balanced_tree_search(spark, sf_dir):
    return tree_search.tree_search(spark, "balanced", b0=2, depth=9, levels=3)


@query()
def stored_tree_traversal(spark, sf_dir):
    return tree_search.traverse(tree_search.stored_tree(spark, depth=5))


_B = "b AS (SELECT c_custkey AS id, (c_custkey * 7919 % 1009) / 1009.0::DOUBLE AS x, (c_custkey * 104729 % 2003) / 2003.0::DOUBLE AS y, (c_custkey * 1299709 % 3001) / 3001.0::DOUBLE AS z, c_acctbal / 10000.0 AS q FROM customer)"


@query(f"WITH {_B}, r AS (SELECT t.id, b.q, t.x - b.x AS dx, t.y - b.y AS dy, t.z - b.z AS dz, sqrt((t.x - b.x) ** 2 + (t.y - b.y) ** 2 + (t.z - b.z) ** 2) AS r FROM b t, b) SELECT id, round(sum(q / r), 5) AS p, round(sum(-q * dx / r ** 3), 3) AS fx FROM r WHERE r > 0 GROUP BY id")
def direct_nbody(spark, sf_dir):
    b = bodies(spark, sf_dir)
    return nbody.direct_sum(b).select("id", F.round("p", 5).alias("p"), F.round("fx", 3).alias("fx"))


@query("SELECT true AS close")
def multipole_nbody(spark, sf_dir):
    b = bodies(spark, sf_dir)
    fast, slow = nbody.multipole_sum(b), nbody.direct_sum(b).withColumnRenamed("p", "exact").select("id", "exact")
    e = fast.join(slow, "id").agg(F.sqrt(F.sum((F.col("p") - F.col("exact")) ** 2) / F.sum(F.col("exact") ** 2)).alias("e"))
    return e.select((F.col("e") < 1e-3).alias("close"))


@query(f"WITH {_B} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM b")
def bounding_box(spark, sf_dir):
    return nbody.bounding_box(bodies(spark, sf_dir))


@query(f"WITH {_B} SELECT a.id AS a, c.id AS b FROM b a JOIN b c ON a.id < c.id WHERE (a.x - c.x) ** 2 + (a.y - c.y) ** 2 + (a.z - c.z) ** 2 < 0.15::DOUBLE * 0.15")
def range_pairs_3d(spark, sf_dir):
    return ann.pairs_within(bodies(spark, sf_dir), 0.15, ["x", "y", "z"])


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+')) AS w FROM benchmark) WHERE w <> '' GROUP BY w")
def word_counts(spark, sf_dir):
    return strings.word_counts(table(spark, sf_dir, "benchmark"), "text")


@query("SELECT item_id AS id, i - 1 AS at FROM (SELECT item_id, text, unnest(range(1, length(text) - 1)) AS i FROM benchmark) WHERE substr(text, i, 2) = 'en'")
def pattern_matches(spark, sf_dir):
    return strings.matches(table(spark, sf_dir, "benchmark"), "item_id", "text", "en")


@query()
def insert_delete_distance(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("s"))
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("t"))
    return b.join(n, "item_id").select("item_id", strings.insert_delete_distance(F.col("s"), F.col("t")).alias("distance"))


@query("SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY encode(substr(text, i)::VARCHAR)) - 1 AS rank, i - 1 AS at FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark)")
def suffix_array(spark, sf_dir):
    return strings.suffix_arrays(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("id", "item_id")


@query()
def longest_repeated_substring(spark, sf_dir):
    return strings.longest_repeated_substrings(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("id", "item_id")


@query()
def huffman_cost(spark, sf_dir):
    return one(spark, bits=strings.huffman_cost(table(spark, sf_dir, "benchmark"), "text"))


@query()
def cartesian_tree(spark, sf_dir):
    return strings.nearest_smaller(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("idx"), "value"))


@query("SELECT q.range AS qid, min(value) AS value FROM range(50) q JOIN events ON event_id BETWEEN q.range * 3 AND q.range * 3 + q.range * 7 GROUP BY q.range")
def range_min(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "value")
    i = F.col("id")
    return strings.range_min(s, spark.range(50).select(i.alias("qid"), (i * 3).alias("lo"), (i * 10).alias("hi")))


@query()
def kmeans_plus_plus(spark, sf_dir):
    return textbook.kmeans(points(spark, sf_dir), 5, 8).select("cluster", "size")


@query()
def lasso_regression(spark, sf_dir):
    w = textbook.lasso(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 10.0)
    return spark.createDataFrame([(k, round(v, 4)) for k, v in w.items()], "feature string, weight double")


@query()
def decision_tree(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", (F.col("l_extendedprice") > 40000).cast("int").alias("y"))
    return spark.createDataFrame(textbook.decision_tree(rows, ["l_quantity", "l_discount"], "y", 2, 8), "node int, label int, rows long, feature string, cut double")


@query()
def upper_hull(spark, sf_dir):
    return textbook.upper_hull(bodies(spark, sf_dir))


@query(f"WITH {_B}, r AS (SELECT id, x AS x1, y AS y1, x + z / 20 AS x2, y + z / 30 AS y2 FROM b) SELECT p.id AS a, s.id AS b FROM r p JOIN r s ON p.id < s.id AND p.x1 < s.x2 AND s.x1 < p.x2 AND p.y1 < s.y2 AND s.y1 < p.y2")
def rectangle_overlaps(spark, sf_dir):
    b = bodies(spark, sf_dir)
    return textbook.rectangle_overlaps(b.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("z") / 20).alias("x2"), (F.col("y") + F.col("z") / 30).alias("y2")), 0.05)


@query()
def ray_first_hits(spark, sf_dir):
    b = bodies(spark, sf_dir)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    t = b.select("id", x.alias("ax"), y.alias("ay"), z.alias("az"), (x + 0.3).alias("bx"), y.alias("by"), z.alias("bz"), x.alias("cx"), (y + 0.3).alias("cy"), z.alias("cz"))
    r = b.select("id", x.alias("ox"), y.alias("oy"), F.lit(-1.0).alias("oz"), F.lit(0.05).alias("dx"), F.lit(0.02).alias("dy"), F.lit(1.0).alias("dz"))
    return textbook.first_hits(r, t)


@query()
def max_flow(spark, sf_dir):
    return one(spark, flow=textbook.max_flow(directed(spark, sf_dir)[1], 0, 17))


@query("SELECT range AS idx, (range = 40)::BIGINT AS digit FROM range(41)")
def big_number_sum(spark, sf_dir):
    a = spark.range(40).select(F.col("id").alias("idx"), F.lit((1 << 32) - 1).alias("digit"))
    return textbook.big_add(a, spark.createDataFrame([(0, 1)], "idx long, digit long"))


@query()
def fourier_transform(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("idx"), "value")
    return textbook.fourier(e).select("key", "idx", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


@query(sql("SELECT count(*) AS edges FROM d"))
def edge_count(spark, sf_dir):
    return directed(spark, sf_dir)[1].agg(F.count("*").alias("edges"))
