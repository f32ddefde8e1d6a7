"""Seeded inputs: R-MAT and preferential-attachment graphs, number sequences, particle sets. Every row is a function of its number
and the seed, so generation is a map and repeats exactly."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import hash_unit


def rmat(spark: SparkSession, scale: int, edges: int, a: float = 0.5, b: float = 0.1, c: float = 0.1, seed: int = 0) -> DataFrame:
    """(src, dst) of 2**scale vertices: each bit of both ends is drawn by a hash of edge, bit and seed."""
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(scale):
        u = hash_unit(F.col("id"), F.lit(k), F.lit(seed))
        src = src * 2 + (u >= a + b).cast("long")
        dst = dst * 2 + (((u >= a) & (u < a + b)) | (u >= a + b + c)).cast("long")
    return spark.range(edges).select(src.alias("src"), dst.alias("dst"))


def preferential_attachment(spark: SparkSession, vertices: int, each: int, seed: int = 0) -> DataFrame:
    """(src, dst): vertex v > 0 has `each` edges to the ends of hashed earlier edge slots; a slot that is an edge's copying end is
    followed by a hash again, so no state is needed: at most 64 times, then vertex 0."""
    slot = F.floor(hash_unit(F.col("slot"), F.lit(seed)) * F.col("slot")).cast("long")
    rows = spark.range(each, vertices * each).select((F.col("id") * 2 + 1).alias("slot"), F.floor(F.col("id") / each).cast("long").alias("src"))
    follow = F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), slot,
        lambda s, _: F.when(s % 2 == 0, s).otherwise(F.floor(hash_unit(s, F.lit(seed)) * s).cast("long")),
    )
    end = F.when(follow % 2 == 0, F.floor(follow / 2 / each)).otherwise(0)
    return rows.select("src", end.cast("long").alias("dst")).filter("src <> dst")


def random_sequence(spark: SparkSession, n: int, seed: int = 0, most: int | None = None, gaussian: bool = False) -> DataFrame:
    """(idx, value): whole numbers from 0 to most, or numbers in (0, 1), or normal ones."""
    u = hash_unit(F.col("id"), F.lit(seed))
    if gaussian:
        value = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * hash_unit(F.col("id"), F.lit(seed + 1)))
    else:
        value = u if most is None else F.floor(u * (most + 1)).cast("long")
    return spark.range(n).select(F.col("id").alias("idx"), value.alias("value"))


def particles(spark: SparkSession, n: int, kind: str = "cube", seed: int = 0) -> DataFrame:
    """(id, x, y, z, q): in a cube of half-width pi, on a sphere, or a Plummer cluster; charges in +-0.5 whose sum is 0, over n."""
    h = lambda k: hash_unit(F.col("id"), F.lit(seed * 16 + k))
    if kind == "cube":
        x, y, z = [(2 * h(k) - 1) * math.pi for k in range(3)]
    elif kind in ("sphere", "plummer"):
        r = F.lit(math.pi) if kind == "sphere" else 1 / F.sqrt(F.pow(h(3), -2.0 / 3) - 1 + 1e-9)
        cos, phi = 2 * h(0) - 1, 2 * math.pi * h(1)
        sin = F.sqrt(1 - cos * cos)
        x, y, z = r * sin * F.cos(phi), r * sin * F.sin(phi), r * cos
    else:
        raise ValueError(kind)
    rows = spark.range(n).select("id", x.alias("x"), y.alias("y"), z.alias("z"), (h(4) - 0.5).alias("c"))
    mean = rows.agg(F.avg("c").alias("mean"))
    return rows.crossJoin(F.broadcast(mean)).select("id", "x", "y", "z", ((F.col("c") - F.col("mean")) / n).alias("q"))  # the mean is one row
