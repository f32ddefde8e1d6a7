"""Graphs and sequences as text: edge lists, and adjacency files of one number a line after a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import degrees, from_edges
from ..plans.loops import cut, dense_index, global_scan


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False, symmetric: bool = False, clean: bool = True) -> DataFrame:
    """(src, dst[, w]) of lines `src dst [w]`; lines that begin with # are comments. clean: no loops, no duplicates."""
    parts = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).filter("trim(value) <> '' and not trim(value) like '#%'")
    e = rows.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"), *([parts[2].cast("double").alias("w")] if weighted else []))
    return from_edges(e, symmetric) if clean or symmetric else e


def write_edge_list(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", *[c for c in ("src", "dst", "w") if c in edges.columns]).alias("value")).write.text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, value): the lines of one text file, numbered from 0; files' blocks and places in them keep the order."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value")
    return dense_index(cut(rows), ["at"]).select("idx", "value")


def read_adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of an adjacency file, weighted or not by its header. Offsets are turned into sources by a running count: the
    source of an edge is the last vertex whose offset is not after it."""
    lines = cut(numbered_lines(spark, path).select("idx", F.trim("value").alias("value")).filter("value <> ''"))
    head = {r["idx"]: r["value"] for r in lines.filter("idx < 3").collect()}
    weighted = head[0].startswith("Weighted")
    n, m = int(head[1]), int(head[2])
    if lines.count() != 3 + n + m * (2 if weighted else 1):
        raise ValueError(f"{path}: the length does not fit the header")
    offsets = lines.filter((F.col("idx") >= 3) & (F.col("idx") < 3 + n)).select(F.col("value").cast("long").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("dst"))
    targets = lines.filter((F.col("idx") >= 3 + n) & (F.col("idx") < 3 + n + m)).select((F.col("idx") - 3 - n).alias("at"), F.lit(1).alias("kind"), F.col("value").cast("long").alias("dst"))
    both = global_scan(offsets.union(targets), (F.col("kind") == 0).cast("long"), ["at", "kind"], "seen").filter("kind = 1")
    edges = both.select((F.col("seen") - 1).alias("src"), "dst", "at")
    if weighted:
        w = lines.filter(F.col("idx") >= 3 + n + m).select((F.col("idx") - 3 - n - m).alias("at"), F.col("value").cast("double").alias("w"))
        edges = edges.join(w, "at")
    return spark.range(n), edges.drop("at")


def write_adjacency(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """An adjacency file as a folder of ordered text parts; vertices are 0 .. n - 1."""
    spark = edges.sparkSession
    weighted = "w" in edges.columns
    n, m = vertices.count(), edges.count()
    offsets = global_scan(degrees(vertices, edges).select("id", "out_degree"), F.col("out_degree"), ["id"], "o", inclusive=False)
    placed = cut(dense_index(edges, ["src", "dst"], "at"))
    head = spark.createDataFrame([(0, "WeightedAdjacencyGraph" if weighted else "AdjacencyGraph"), (1, str(n)), (2, str(m))], "k long, value string")
    out = head.union(offsets.select(F.col("id") + 3, F.col("o").cast("string"))).union(placed.select(F.col("at") + 3 + n, F.col("dst").cast("string")))
    if weighted:
        out = out.union(placed.select(F.col("at") + 3 + n + m, F.col("w").cast("string")))
    out.repartitionByRange("k").sortWithinPartitions("k").select("value").write.text(path)


def read_sequence(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(idx, value) of a file with one value a line, after a header line `sequence...` if there is one."""
    lines = numbered_lines(spark, path)
    skip = lines.filter("idx = 0 and lower(value) like 'sequence%'").count()
    return lines.filter(F.col("idx") >= skip).select((F.col("idx") - skip).alias("idx"), F.trim("value").cast(kind).alias("value"))
