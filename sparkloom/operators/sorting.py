"""Sorting: range-partitioned sample sort, its splitters, and the check of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import dense_index
from .sequence import is_sorted


def sort(seq: DataFrame) -> DataFrame:
    """(idx, value) in rising order, nulls last, equal values in their old order; idx is the new place. Splitters are sampled over
    (value, place), so one value of many copies still spreads over partitions."""
    order = [F.col("value").asc_nulls_last(), F.col("old").asc_nulls_last()]
    return dense_index(seq.select("value", F.col("idx").alias("old")), order).select("idx", "value")


def counting_sort(seq: DataFrame, buckets: int) -> DataFrame:
    """Stable, for whole values. Those below 0, from buckets on and null keep their place in the order as well: buckets are ranges
    of a sort, so their number bounds nothing."""
    return sort(seq)


def splitters(seq: DataFrame, parts: int) -> list[float]:
    """parts - 1 values that cut the sequence into about equal parts."""
    return seq.approxQuantile("value", [i / parts for i in range(1, parts)], 0.001)


def weighted_parts(seq: DataFrame, weight: str, parts: int) -> DataFrame:
    """seq with part: runs of neighbours of about equal weight."""
    from ..plans.loops import global_scan

    total = seq.agg(F.sum(weight)).first()[0] or 1
    summed = global_scan(seq, F.col(weight), ["idx"], "__s", inclusive=False)
    return summed.withColumn("part", F.least(F.floor(F.col("__s") * parts / total), F.lit(parts - 1)).cast("int")).drop("__s")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sorted sequences as one; of equal values those of a come first."""
    both = a.select("value", F.lit(0).alias("s"), F.col("idx").alias("old")).union(b.select("value", F.lit(1), "idx"))
    return dense_index(both, ["value", "s", "old"]).select("idx", "value")


def verify(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether `after` is sorted, and how many values differ between the two as multisets."""
    c = lambda d, n: d.groupBy("value").agg(F.count("*").alias(n))
    differ = c(before, "x").join(c(after, "y"), "value", "full").filter(~F.col("x").eqNullSafe(F.col("y"))).agg(F.count("*").alias("differ"))
    return is_sorted(after).select("sorted").crossJoin(differ)
