"""PageRank and its relatives. Mass at vertices without out-edges is not given back: all variants share this."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import cut


def _pull(ranks: DataFrame, weighted: DataFrame, vertices: DataFrame, damping: float, rest: float) -> DataFrame:
    sent = ranks.select(F.col("id").alias("src"), "rank").join(weighted, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("s"))
    return vertices.join(sent, "id", "left").select("id", (damping * F.coalesce("s", F.lit(0.0)) + rest).alias("rank"))


def _shares(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("src").agg(F.count("*").alias("n"))
    return cut(edges.select("src", "dst").join(out, "src").select("src", "dst", (1.0 / F.col("n")).alias("share")).repartition("src"))


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float | None = 1e-6, most: int = 100) -> DataFrame:
    """(id, rank), from 1/n: until the sum of changes is below tolerance, or `most` rounds."""
    vertices = cut(vertices.select("id").repartition("id"))
    n = vertices.count()
    weighted = _shares(edges)
    ranks = cut(vertices.select("id", F.lit(1.0 / max(n, 1)).alias("rank")))
    for _ in range(most):
        new = cut(_pull(ranks, weighted, vertices, damping, (1 - damping) / n))
        if tolerance is not None:
            change = new.join(ranks.withColumnRenamed("rank", "old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if change < tolerance:
                return new
        ranks = new
    return ranks


def pagerank_unnormalised(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """(id, rank): 1 - d + d * sum, from 1; a fixed number of rounds."""
    vertices = cut(vertices.select("id").repartition("id"))
    weighted = _shares(edges)
    ranks = vertices.select("id", F.lit(1.0).alias("rank"))
    for _ in range(iterations):
        ranks = cut(_pull(ranks, weighted, vertices, damping, 1 - damping))
    return ranks


def pagerank_matrix(vertices: DataFrame, entries: DataFrame, damping: float = 0.85, iterations: int = 10) -> DataFrame:
    """(id, rank) with the given weights w of (src, dst, w) as they are."""
    vertices = cut(vertices.select("id").repartition("id"))
    n = vertices.count()
    weighted = cut(entries.select("src", "dst", F.col("w").cast("double").alias("share")).repartition("src"))
    ranks = vertices.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(iterations):
        ranks = cut(_pull(ranks, weighted, vertices, damping, (1 - damping) / n))
    return ranks


def pagerank_delta(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, threshold: float = 0.01, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """(id, rank): only changes above threshold times the rank travel on, and only these are added. The first round tests the size
    of the change too, not its sign."""
    vertices = cut(vertices.select("id").repartition("id"))
    n = vertices.count()
    weighted = _shares(edges)
    state = cut(vertices.select("id", F.lit(0.0).alias("rank"), F.lit(1.0 / max(n, 1)).alias("delta"), F.lit(True).alias("active")))
    for k in range(most):
        sent = state.filter("active").select(F.col("id").alias("src"), "delta").join(weighted, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("delta") * F.col("share")).alias("s"))
        s = damping * F.coalesce("s", F.lit(0.0))
        new = s + (1 - damping) / n - 1.0 / n if k == 0 else s
        base = F.col("rank") + (F.lit(1.0 / n) if k == 0 else F.lit(0.0))
        moved = state.join(sent, "id", "left").select("id", base.alias("rank"), new.alias("d"))
        on = F.abs("d") > threshold * F.abs("rank")
        state = cut(moved.select("id", F.when(on, F.col("rank") + F.col("d")).otherwise(F.col("rank")).alias("rank"), F.col("d").alias("delta"), on.alias("active")))
        if (state.filter("active").agg(F.sum(F.abs("delta"))).first()[0] or 0.0) < tolerance:
            break
    return state.select("id", "rank")


def cosimrank(vertices: DataFrame, edges: DataFrame, u: int, v: int, decay: float = 0.85, tolerance: float = 1e-6, most: int = 20) -> float:
    """[u = v] + sum over t of decay**t <p_u, p_v>, p the distributions of walks of t steps."""
    weighted = _shares(edges)
    spark = edges.sparkSession
    walk = cut(spark.createDataFrame([("u", u, 1.0), ("v", v, 1.0)], "side string, id long, p double"))
    total = 1.0 if u == v else 0.0
    for t in range(1, most + 1):
        new = cut(walk.withColumnRenamed("id", "src").join(weighted, "src").groupBy("side", F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("share")).alias("p")))
        row = new.groupBy("id").agg(F.sum(F.when(F.col("side") == "u", F.col("p"))).alias("a"), F.sum(F.when(F.col("side") == "v", F.col("p"))).alias("b")).agg(F.sum(F.col("a") * F.col("b")))
        total += decay**t * (row.first()[0] or 0.0)
        change = new.join(walk.withColumnRenamed("p", "q"), ["side", "id"], "full").groupBy("side").agg(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))).alias("c")).agg(F.max("c")).first()[0]
        walk = new
        if change is None or change < tolerance:
            break
    return total
