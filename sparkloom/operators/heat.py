"""Explicit 2-D heat diffusion on a grid (i, j, u), and its error against the closed form exp(-2t) sin x sin y."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.loops import cut


def _at_edges(x: Column, y: Column, nx: int, ny: int, t: float, inside: Column) -> Column:
    i, j, decay = F.col("i"), F.col("j"), math.exp(-2 * t)
    return F.when((i == 0) | (j == 0), 0.0).when(j == ny - 1, decay * F.sin(x)).when(i == nx - 1, decay * F.sin(y)).otherwise(inside)


def heat(spark: SparkSession, nx: int, ny: int, nt: int, x1: float = math.pi / 2, y1: float = math.pi / 2, t1: float = 1e-3) -> DataFrame:
    """(i, j, u) after nt steps from time 0 to t1 over [0, x1] x [0, y1]. A step sends each cell's value to its four neighbours and
    sums what meets (one shuffle of partial sums), so no grid row or column is ever ordered in one place."""
    dx, dy, dt = x1 / (nx - 1), y1 / (ny - 1), t1 / nt
    a, b = dt / dx**2, dt / dy**2
    x, y = F.col("i") * dx, F.col("j") * dy
    base = spark.range(nx * ny).select(F.floor(F.col("id") / ny).cast("int").alias("i"), (F.col("id") % ny).cast("int").alias("j"))
    u = base.select("i", "j", _at_edges(x, y, nx, ny, 0.0, F.sin(x) * F.sin(y)).alias("u"))
    for n in range(1, nt + 1):
        move = lambda di, dj, w: F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), (F.col("u") * w).alias("u"))
        sent = u.select(F.explode(F.array(move(0, 0, 1 - 2 * a - 2 * b), move(-1, 0, a), move(1, 0, a), move(0, -1, b), move(0, 1, b))).alias("m")).select("m.*")
        summed = sent.filter((F.col("i") >= 0) & (F.col("i") < nx) & (F.col("j") >= 0) & (F.col("j") < ny)).groupBy("i", "j").agg(F.sum("u").alias("u"))
        u = summed.select("i", "j", _at_edges(x, y, nx, ny, n * dt, F.col("u")).alias("u"))
        if n % 8 == 0:
            u = cut(u)
    return u


def heat_errors(u: DataFrame, nx: int, ny: int, x1: float = math.pi / 2, y1: float = math.pi / 2, t1: float = 1e-3) -> DataFrame:
    """One row: greatest and mean absolute, greatest relative difference from the closed form at t1."""
    exact = math.exp(-2 * t1) * F.sin(F.col("i") * (x1 / (nx - 1))) * F.sin(F.col("j") * (y1 / (ny - 1)))
    gap = F.abs(F.col("u") - exact)
    return u.agg(F.max(gap).alias("max_abs"), F.avg(gap).alias("mean_abs"), F.max(F.when(exact != 0, gap / F.abs(exact))).alias("max_rel"))
