"""Unbalanced tree search: an implicit tree whose shape comes from splittable SHA-1 states."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import sha1_state, state_value
from ..plans.loops import cut

#: Children of a node at most, but for the root of a binomial tree.
MOST = 100


def root_state(seed: int) -> bytes:
    return hashlib.sha1(bytes(16) + seed.to_bytes(4, "big")).digest()


def expected(shape: str, b0: float, height: int, depth: int) -> float:
    """The mean number of children of a geometric node by the documented shapes."""
    if shape == "fixed":
        return b0 if height < depth else 0.0
    if shape == "linear":
        return b0 * (1 - height / depth)
    if shape == "cyclic":
        return 0.0 if height > 5 * depth else b0 ** math.sin(2 * math.pi * height / depth)
    if shape == "expdec":
        return b0 * max(height, 1) ** (-math.log(b0) / math.log(depth)) if height else b0
    raise ValueError(shape)


def children_column(kind: str, state: Column, height: int, b0: float, depth: int, shape: str, q: float, m: int) -> Column:
    u = state_value(state)
    if kind == "balanced":
        return F.lit(int(b0) if height < depth else 0)
    if kind == "binomial":
        return F.lit(int(b0)) if height == 0 else F.when(u < q, m).otherwise(0)
    b = expected(shape, b0, height, depth)
    if b <= 0:
        return F.lit(0)
    p = 1 / (1 + b)
    return F.least(F.floor(F.log(1 - u) / F.lit(math.log(1 - p))), F.lit(MOST)).cast("int")


def tree_search(spark: SparkSession, kind: str = "geometric", b0: float = 4, depth: int = 10, seed: int = 19, shape: str = "fixed", q: float = 0.124875, m: int = 8, levels: int = 6, switch: float = 0.5) -> DataFrame:
    """One row: depth, nodes, leaves. The first levels are made together, a table a level; below them each task searches the
    subtrees of its nodes depth first, so trees of a thousand levels cost no job a level. hybrid: geometric above `switch` of the
    depth, binomial below."""

    def kind_at(h: int) -> str:
        return ("geometric" if h < switch * depth else "binomial") if kind == "hybrid" else kind

    level = spark.createDataFrame([(bytearray(root_state(seed)),)], "state binary")
    nodes = leaves = 0
    for h in range(levels):
        level = cut(level.withColumn("n", children_column(kind_at(h), F.col("state"), h, b0, depth, shape, q, m)))
        row = level.agg(F.count("*").alias("a"), F.count(F.when(F.col("n") == 0, 1)).alias("b")).first()
        nodes, leaves = nodes + row.a, leaves + row.b
        grown = level.filter("n > 0").select("state", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select(sha1_state(F.col("state"), F.col("i")).alias("state"))
        level = cut(grown.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, "state"))
        if row.a == row.b:
            return spark.createDataFrame([(h, nodes, leaves)], "depth long, nodes long, leaves long")

    def children(state: bytes, h: int) -> int:
        k = kind_at(h)
        if k == "balanced":
            return int(b0) if h < depth else 0
        u = (int.from_bytes(state[16:], "big") & 0x7FFFFFFF) / 2147483648.0
        if k == "binomial":
            return m if u < q else 0
        b = expected(shape, b0, h, depth)
        return min(int(math.log(1 - u) / math.log(1 - 1 / (1 + b))), MOST) if b > 0 else 0

    def below(batches):
        sha1 = hashlib.sha1
        suffix = [i.to_bytes(4, "big") for i in range(max(MOST, m) + 1)]
        top = n_nodes = n_leaves = 0
        for b in batches:
            for state in b["state"]:
                stack = [(bytes(state), levels)]
                while stack:
                    s, h = stack.pop()
                    n_nodes += 1
                    top = max(top, h)
                    n = children(s, h)
                    if n:
                        stack += [(sha1(s + suffix[i]).digest(), h + 1) for i in range(n)]
                    else:
                        n_leaves += 1
        yield pd.DataFrame({"depth": [top], "nodes": [n_nodes], "leaves": [n_leaves]})

    found = level.mapInPandas(below, "depth long, nodes long, leaves long")
    return found.agg(F.max("depth").alias("depth"), (F.sum("nodes") + nodes).alias("nodes"), (F.sum("leaves") + leaves).alias("leaves"))


def stored_tree(spark: SparkSession, b0: float = 4, depth: int = 4, seed: int = 19) -> DataFrame:
    """(id, parent, height) of a geometric tree: built once, to be traversed again."""
    level = spark.createDataFrame([("r", None, 0, bytearray(root_state(seed)))], "id string, parent string, height int, state binary")
    all_ = level.select("id", "parent", "height")
    for h in range(depth):
        n = children_column("geometric", F.col("state"), h, b0, depth, "fixed", 0, 0)
        level = cut(level.withColumn("n", n).filter("n > 0").select(F.col("id").alias("parent"), "state", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select(F.concat_ws(".", "parent", "i").alias("id"), "parent", F.lit(h + 1).alias("height"), sha1_state(F.col("state"), F.col("i")).alias("state")))
        all_ = cut(all_.union(level.select("id", "parent", "height")))
    return all_


def traverse(tree: DataFrame) -> DataFrame:
    """One row of a stored tree: depth, nodes, leaves."""
    inner = tree.select(F.col("parent").alias("id")).distinct()
    return tree.agg(F.max("height").cast("long").alias("depth"), F.count("*").alias("nodes")).crossJoin(tree.join(inner, "id", "left_anti").agg(F.count("*").alias("leaves")))
