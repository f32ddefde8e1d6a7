"""Searches from a source: levels, parents, distances, widths, betweenness. Every vertex has a row; unreached ones have null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.loops import Unstable, cut, less, more, propagate


def _start(vertices: DataFrame, source: int, value: Column, kind: str) -> DataFrame:
    at = F.col("id") == source
    return vertices.select("id", F.when(at, value).cast(kind).alias("value"), at.alias("active"))


def bfs_levels(vertices: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """(id, level)"""
    found = propagate(_start(vertices, source, F.lit(0), "long"), edges.select("src", "dst"), F.col("value") + 1, F.min, less)
    return found.select("id", F.col("value").alias("level"))


def bfs_parents(vertices: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """(id, level, parent): the parent is the least neighbour one level below; the source is its own."""
    level = cut(bfs_levels(vertices, edges, source))
    below = level.select(F.col("id").alias("src"), F.col("level").alias("l"))
    up = edges.select("src", "dst").join(below, "src").join(level.select(F.col("id").alias("dst"), "level"), "dst").filter("l + 1 = level").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("p"))
    return level.join(up, "id", "left").select("id", "level", F.when(F.col("id") == source, F.col("id")).otherwise(F.col("p")).alias("parent"))


def bfs_frontiers(vertices: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """(level, size) of the frontiers."""
    return bfs_levels(vertices, edges, source).filter("level is not null").groupBy("level").agg(F.count("*").alias("size"))


def shortest_paths(vertices: DataFrame, edges: DataFrame, source: int, delta: float | None = None, kind: str = "double") -> DataFrame:
    """(id, distance). With delta, vertices are settled by buckets of that width (delta-stepping; with delta 1 and whole weights,
    bucketed Dijkstra); without, all changed vertices send (Bellman-Ford). Edges without w weigh 1. Weights may be negative only
    without delta; a negative cycle that the source reaches raises ValueError."""
    e = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1))
    rounds = vertices.count()
    state = _start(vertices, source, F.lit(0), kind)
    bucket = None if delta is None else F.floor(F.col("value") / F.lit(delta))
    try:
        found = propagate(state, e.select("src", "dst", "w"), (F.col("value") + F.col("w")).cast(kind), F.min, less, bucket, rounds + 1 if delta is None else 1_000_000)
    except Unstable as error:
        if delta is not None:
            raise
        raise ValueError("a negative cycle") from error
    return found.select("id", F.col("value").alias("distance"))


def widest_paths(vertices: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """(id, width): the greatest least weight of a path; the source's own is the greatest whole number, unreached 0."""
    widest = (1 << 31) - 1
    found = propagate(_start(vertices, source, F.lit(widest), "long"), edges.select("src", "dst", "w"), F.least(F.col("value"), F.col("w").cast("long")), F.max, more)
    return found.select("id", F.coalesce("value", F.lit(0).cast("long")).alias("width"))


def betweenness(vertices: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """(id, level, paths, dependency) of shortest paths from one source (Brandes). Unreached vertices have nulls."""
    level = cut(bfs_levels(vertices, edges, source))
    top = level.agg(F.max("level")).first()[0] or 0
    l1, l2 = level.select(F.col("id").alias("src"), F.col("level").alias("a")), level.select(F.col("id").alias("dst"), F.col("level").alias("b"))
    dag = cut(edges.select("src", "dst").join(l1, "src").join(l2, "dst").filter("a + 1 = b").select("src", "dst", "b"))
    paths = cut(level.filter("level = 0").select("id", F.lit(1.0).alias("paths")))
    for k in range(1, top + 1):
        here = dag.filter(F.col("b") == k).join(paths.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        paths = cut(paths.unionByName(here))
    own = paths.select("id", "paths")
    dep = cut(level.filter(F.col("level") == top).select("id", F.lit(0.0).alias("dep")))
    for k in range(top, 0, -1):
        up = (
            dag.filter(F.col("b") == k).join(own.select(F.col("id").alias("src"), F.col("paths").alias("ps")), "src").join(own.select(F.col("id").alias("dst"), F.col("paths").alias("pd")), "dst")
            .join(dep.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("ps") / F.col("pd") * (1 + F.col("dep"))).alias("d"))
        )
        here = level.filter(F.col("level") == k - 1).select("id").join(up, "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("dep"))
        dep = cut(dep.unionByName(here))
    return level.join(own, "id", "left").join(dep, "id", "left").select("id", "level", "paths", F.col("dep").alias("dependency"))


def least_element_lists(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, source, distance): for each vertex those sources, in id order, that are nearer to it than every source before."""
    found = vertices.select("id", F.col("id").alias("source"), F.lit(0).cast("long").alias("distance"))
    new = cut(found)
    found = new
    while new.limit(1).count():
        sent = new.join(edges.select("src", "dst"), new["id"] == F.col("src")).select(F.col("dst").alias("id"), "source", (F.col("distance") + 1).alias("distance"))
        both = found.unionByName(sent).groupBy("id", "source").agg(F.min("distance").alias("distance"))
        from pyspark.sql import Window

        before = Window.partitionBy("id").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
        kept = cut(both.withColumn("m", F.min("distance").over(before)).filter("m is null or distance < m").drop("m"))
        new = cut(kept.join(found, ["id", "source", "distance"], "left_anti"))
        found = kept
    return found
