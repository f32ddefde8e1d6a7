"""Graphs, sequences, vectors and bodies from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import from_edges
from ..plans.loops import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w), one row for every order: its customer, and by the order's number one of the 20 customers of the same block or,
    for a third of the orders, one anywhere."""
    k = F.lit(table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] + 1)
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    v = F.when(o % 3 == 0, (c * 7 + o * 13) % k).otherwise((c - c % 20 + o % 20) % k)
    return table(spark, sf_dir, "orders").select(c.alias("src"), v.alias("dst"), (o * 7919 % 50 + 1).alias("w"))


def customer_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


def directed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return cut(customer_vertices(spark, sf_dir)), cut(from_edges(customer_edges(spark, sf_dir)))


def undirected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return cut(customer_vertices(spark, sf_dir)), cut(from_edges(customer_edges(spark, sf_dir), symmetric=True))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence (idx, value, user_id, event_type)."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "value", "user_id", "event_type")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z, q) from customers: places by arithmetic on the key, charges by the balance."""
    k = F.col("c_custkey")
    part = lambda a, m: (k * a % m) / F.lit(float(m))
    return table(spark, sf_dir, "customer").select(k.alias("id"), part(7919, 1009).alias("x"), part(104729, 2003).alias("y"), part(1299709, 3001).alias("z"), (F.col("c_acctbal") / 10000.0).alias("q"))
