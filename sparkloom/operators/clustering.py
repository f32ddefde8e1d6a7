"""Structural clustering of graphs (SCAN) and its similarity measures, on closed neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import cut, dense_index
from .components import connected_components
from .graph import degrees


def similarities(vertices: DataFrame, edges: DataFrame, measure: str = "cosine") -> DataFrame:
    """(src, dst, similarity) for each edge in both directions: cosine (by weights where edges have w; a vertex's own weight is 1)
    or jaccard of the ends' closed neighbourhoods. Common neighbours come from a join of each edge with the two lists, by the
    source that has the shorter one."""
    weighted = "w" in edges.columns and measure == "cosine"
    e = cut(edges.select("src", "dst", (F.col("w").cast("double") if weighted else F.lit(1.0)).alias("w")))
    lists = cut(e.groupBy(F.col("src").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("dst", "w"))).alias("m"), F.sum(F.col("w") * F.col("w")).alias("s"), F.count("*").alias("n")))
    a = lists.select(F.col("id").alias("src"), F.col("m").alias("ma"), F.col("s").alias("sa"), F.col("n").alias("na"))
    b = lists.select(F.col("id").alias("dst"), F.col("m").alias("mb"), F.col("s").alias("sb"), F.col("n").alias("nb"))
    j = e.filter("src < dst").join(a, "src").join(b, "dst")
    common_keys = F.array_intersect(F.map_keys("ma"), F.map_keys("mb"))
    if measure == "jaccard":
        both = F.size(common_keys) + 2
        value = both / (F.col("na") + F.col("nb") + 2 - both)
    else:
        dot = F.aggregate(common_keys, F.lit(0.0), lambda acc, k: acc + F.element_at("ma", k) * F.element_at("mb", k)) + 2 * F.col("w")
        value = dot / F.sqrt((F.col("sa") + 1) * (F.col("sb") + 1))
    one = cut(j.select("src", "dst", value.alias("similarity")))
    return one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "similarity"))


def approximate_similarities(vertices: DataFrame, edges: DataFrame, measure: str = "jaccard", samples: int = 400, seed: int = 1) -> DataFrame:
    """(src, dst, similarity): jaccard by the share of equal minima of `samples` hashes; cosine by the share of equal signs of sums
    of hashed signs over the closed neighbourhoods."""
    closed = edges.select("src", "dst").union(vertices.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    numbers = F.sequence(F.lit(0), F.lit(samples - 1))
    if measure == "jaccard":
        sketch = closed.groupBy(F.col("src").alias("id")).agg(*[F.min(F.xxhash64("dst", F.lit(seed * samples + i))).alias(f"h{i}") for i in range(samples)]).select("id", F.array(*[f"h{i}" for i in range(samples)]).alias("s"))
    else:
        sketch = closed.groupBy(F.col("src").alias("id")).agg(*[F.sum(F.when(F.xxhash64("dst", F.lit(seed * samples + i)) > 0, 1).otherwise(-1)).alias(f"h{i}") for i in range(samples)]).select("id", F.array(*[F.col(f"h{i}") for i in range(samples)]).alias("s"))
        sketch = sketch.select("id", F.transform("s", lambda x: (x > 0).cast("int")).alias("s"))
    sketch = cut(sketch)
    a, b = sketch.select(F.col("id").alias("src"), F.col("s").alias("a")), sketch.select(F.col("id").alias("dst"), F.col("s").alias("b"))
    same = F.aggregate(F.zip_with("a", "b", lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda acc, x: acc + x) / samples
    value = same if measure == "jaccard" else F.cos(F.lit(3.141592653589793) * (1 - same))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", value.alias("similarity"))


def scan_cores(vertices: DataFrame, similar: DataFrame, mu: int, epsilon: float) -> DataFrame:
    """(id): vertices with at least mu members (themselves included) of similarity epsilon in their closed neighbourhood."""
    n = similar.filter(F.col("similarity") >= epsilon).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return vertices.select("id").join(n, "id", "left").filter(F.coalesce("n", F.lit(0)) + 1 >= mu).select("id")


def scan_index(similar: DataFrame) -> DataFrame:
    """(id, mu, threshold): the greatest epsilon at which a vertex is a core for mu."""
    return similar.select(F.col("src").alias("id"), (F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")) + 1).alias("mu"), F.col("similarity").alias("threshold"))


def scan_clusters(vertices: DataFrame, similar: DataFrame, mu: int, epsilon: float) -> DataFrame:
    """(id, cluster): clusters are the components of cores over similar edges, named by their least core; other vertices join their
    most similar core (then the least), or get null."""
    cores = cut(scan_cores(vertices, similar, mu, epsilon))
    strong = similar.filter(F.col("similarity") >= epsilon)
    a, b = cores.withColumnRenamed("id", "src"), cores.withColumnRenamed("id", "dst")
    labels = cut(connected_components(cores, strong.join(a, "src", "left_semi").join(b, "dst", "left_semi")))
    border = strong.join(b, "dst", "left_semi").join(a, "src", "left_anti").groupBy(F.col("src").alias("id")).agg(F.max(F.struct("similarity", (-F.col("dst")).alias("x"))).alias("m")).select("id", (-F.col("m.x")).alias("core"))
    joined = border.join(labels.select(F.col("id").alias("core"), "label"), "core").select("id", "label")
    return vertices.select("id").join(labels.union(joined), "id", "left").select("id", F.col("label").alias("cluster"))


def scan_memberships(vertices: DataFrame, similar: DataFrame, mu: int, epsilon: float) -> DataFrame:
    """(id, cluster), a row for each cluster that a vertex is in: a border vertex is in those of all its similar cores."""
    cores = cut(scan_cores(vertices, similar, mu, epsilon))
    strong = similar.filter(F.col("similarity") >= epsilon)
    a, b = cores.withColumnRenamed("id", "src"), cores.withColumnRenamed("id", "dst")
    labels = cut(connected_components(cores, strong.join(a, "src", "left_semi").join(b, "dst", "left_semi")))
    border = strong.join(labels.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label")
    return labels.select("id", "label").union(border).distinct().select("id", F.col("label").alias("cluster"))


def hubs_and_outliers(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, kind) of vertices without cluster: hub if their neighbours are in two clusters or more, else outlier."""
    near = edges.join(clusters.select(F.col("id").alias("dst"), "cluster"), "dst").groupBy(F.col("src").alias("id")).agg(F.countDistinct("cluster").alias("n"))
    return clusters.filter("cluster is null").join(near, "id", "left").select("id", F.when(F.coalesce("n", F.lit(0)) >= 2, "hub").otherwise("outlier").alias("kind"))


def modularity(vertices: DataFrame, edges: DataFrame, clusters: DataFrame) -> float:
    """Modularity of (id, cluster); vertices without cluster are alone. Both directions of an edge count; 0 without edges."""
    own = clusters.select("id", F.coalesce(F.col("cluster"), -F.col("id") - 1).alias("c"))
    m = edges.count()
    if not m:
        return 0.0
    a, b = own.select(F.col("id").alias("src"), F.col("c").alias("a")), own.select(F.col("id").alias("dst"), F.col("c").alias("b"))
    inside = edges.join(a, "src").join(b, "dst").filter("a = b").count()
    d = degrees(vertices, edges).join(own, "id").groupBy("c").agg(F.sum("out_degree").alias("d")).agg(F.sum(F.col("d").cast("double") * F.col("d"))).first()[0]
    return inside / m - (d or 0.0) / (m * m)


def compact_labels(clusters: DataFrame) -> DataFrame:
    """(id, cluster) with clusters numbered from 0 in order; null stays null."""
    names = dense_index(clusters.filter("cluster is not null").select("cluster").distinct(), ["cluster"], "name")
    return clusters.join(names, "cluster", "left").select("id", F.col("name").alias("cluster"))
