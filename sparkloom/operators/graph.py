"""Graphs as DataFrames: edges(src, dst[, w]), vertices(id); frontier and edge operators.

Undirected graphs hold both directions of an edge. A frontier is a DataFrame (id[, data]); whether it is joined by broadcast or
shuffle is the planner's choice, which is what a sparse or dense frontier comes to here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import dense_index


def from_edges(edges: DataFrame, symmetric: bool = False) -> DataFrame:
    """Edges without loops and duplicates, the least weight of duplicates kept; symmetric adds the reverse ones. Null ends go."""
    w = "w" in edges.columns
    cols = ["src", "dst", *(["w"] if w else [])]
    e = edges.select(*cols).filter("src <> dst")
    if symmetric:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["w"] if w else [])))
    return e.groupBy("src", "dst").agg(F.min("w").alias("w")) if w else e.distinct()


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree), 0 for vertices without edges."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    zero = F.lit(0).cast("long")
    return vertices.join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("o", zero).alias("out_degree"), F.coalesce("i", zero).alias("in_degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbours): sorted arrays."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def vertex_map(frontier: DataFrame, data: Column) -> DataFrame:
    return frontier.select("id", data.alias("data"))


def vertex_filter(frontier: DataFrame, keep: Column) -> DataFrame:
    return frontier.filter(keep)


def add_to_frontier(frontier: DataFrame, more: DataFrame) -> DataFrame:
    return frontier.unionByName(more)


def edge_map(frontier: DataFrame, edges: DataFrame, allowed: DataFrame | None = None, message: Column | None = None, combine: Callable = F.min) -> DataFrame:
    """(id, data) of the vertices that the frontier's edges reach, once each, with the combined messages (by default the least
    source). Only targets in `allowed` (id) count."""
    sent = frontier.join(edges, frontier["id"] == edges["src"]).groupBy("dst").agg(combine(F.col("src") if message is None else message).alias("data"))
    out = sent.select(F.col("dst").alias("id"), "data")
    return out if allowed is None else out.join(allowed.select("id"), "id", "left_semi")


def edge_map_reduce(frontier: DataFrame, edges: DataFrame, message: Column, combine: Callable, vertices: DataFrame | None = None, identity: Column | None = None) -> DataFrame:
    """(id, data): messages of the frontier's edges combined by target. With vertices every vertex has a row (the dense form),
    those without messages the identity."""
    out = edge_map(frontier, edges, None, message, combine)
    return out if vertices is None else vertices.join(out, "id", "left").select("id", F.coalesce("data", identity).alias("data"))


def edge_map_count(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, data): how many of the frontier's edges reach each vertex."""
    return edge_map(frontier, edges, None, F.lit(1), F.count)


def edge_map_induced(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Every (src, dst) edge of the frontier."""
    return edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi")


def edge_map_filter(frontier: DataFrame, edges: DataFrame, keep: Column) -> DataFrame:
    """(id, data): how many edges of each frontier vertex satisfy keep, 0 included."""
    kept = edges.filter(keep).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return frontier.select("id").join(kept, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("data"))


def pack_edges(edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The edges that satisfy keep, and (id, degree) of what remains."""
    left = edges.filter(keep)
    return left, left.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def sample_edges(edges: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Edges kept by a hash of their ends, the same for both directions."""
    h = F.pmod(F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"), F.lit(seed)), F.lit(1_000_000))
    return edges.filter(h < int(share * 1_000_000))


def relabel(edges: DataFrame, names: DataFrame) -> DataFrame:
    """edges under new names: (id, name)."""
    a, b = names.select(F.col("id").alias("src"), F.col("name").alias("__s")), names.select(F.col("id").alias("dst"), F.col("name").alias("__d"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(a, "src").join(b, "dst").select(F.col("__s").alias("src"), F.col("__d").alias("dst"), *rest)


def contract(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges between clusters (id, name), without loops and duplicates."""
    return from_edges(relabel(edges, clusters))


def dense_names(labels: DataFrame) -> DataFrame:
    """(label, name): labels numbered from 0 in order."""
    return dense_index(labels.select("label").distinct(), ["label"], "name")


def degree_rank(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rank): vertices numbered by (degree, id)."""
    return dense_index(degrees(vertices, edges).select("id", F.col("out_degree").alias("degree")), ["degree", "id"], "rank").select("id", "rank")


def orient(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Each undirected edge once, from the end of lower rank: bounds the fan-out of joins on a common neighbour."""
    a, b = ranks.select(F.col("id").alias("src"), F.col("rank").alias("ra")), ranks.select(F.col("id").alias("dst"), F.col("rank").alias("rb"))
    return edges.join(a, "src").join(b, "dst").filter("ra < rb").select("src", "dst")


def colour_sparsify(edges: DataFrame, colours: int, seed: int = 0) -> DataFrame:
    """Edges whose ends have the same hash colour."""
    c = lambda x: F.pmod(F.xxhash64(x, F.lit(seed)), F.lit(colours))
    return edges.filter(c("src") == c("dst"))


def process_vertices(frontier: DataFrame, value: Column) -> DataFrame:
    """One row: the sum of value over the frontier."""
    return frontier.agg(F.sum(value).alias("total"))


def first_of(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")
