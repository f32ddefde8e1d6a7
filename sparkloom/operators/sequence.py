"""Sequence primitives on (idx, value) rows: idx is the place, from 0. Nothing relies on the order of rows, and nothing but the
rows of a partition is ordered at a time: running sums and ranks go through plans.loops.global_scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.loops import cut, dense_index, global_scan


def tabulate(spark: SparkSession, n: int, value: Column) -> DataFrame:
    """value, an expression of idx, for 0 <= idx < n."""
    return spark.range(n).select(F.col("id").alias("idx")).select("idx", value.alias("value"))


def iota(spark: SparkSession, n: int) -> DataFrame:
    return tabulate(spark, n, F.col("idx"))


def pack(seq: DataFrame, flag: Column) -> DataFrame:
    """The values whose flag is true, renumbered."""
    return dense_index(seq.filter(flag).select(F.col("idx").alias("at"), "value"), ["at"]).select("idx", "value")


def pack_index(seq: DataFrame, flag: Column) -> DataFrame:
    return seq.filter(flag).select("idx")


def map_maybe(seq: DataFrame, value: Column) -> DataFrame:
    """value where it is not null."""
    return seq.select("idx", value.alias("value")).filter("value is not null")


def zip_with(a: DataFrame, b: DataFrame, value: Column) -> DataFrame:
    """value, of columns value and other, where both sequences have a place."""
    return a.join(b.select("idx", F.col("value").alias("other")), "idx").select("idx", value.alias("value"))


def reverse(seq: DataFrame) -> DataFrame:
    n = seq.count()
    return seq.select((F.lit(n - 1) - F.col("idx")).alias("idx"), "value")


def rotate(seq: DataFrame, places: int) -> DataFrame:
    """Starts with the element at `places`."""
    n = max(seq.count(), 1)
    return seq.select(F.pmod(F.col("idx") - places, F.lit(n)).alias("idx"), "value")


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    n = a.count()
    return a.select("idx", "value").union(b.select(F.col("idx") + n, "value"))


def flatten(nested: DataFrame) -> DataFrame:
    """(idx, values) to the values of all arrays in order."""
    return dense_index(nested.select(F.col("idx").alias("i"), F.posexplode("values").alias("j", "value")), ["i", "j"]).select("idx", "value")


def partition(seq: DataFrame, flag: Column) -> DataFrame:
    """Stable: values with a true flag first."""
    return dense_index(seq.select((~flag).alias("f"), F.col("idx").alias("at"), "value"), ["f", "at"]).select("idx", "value")


def scan(seq: DataFrame, inclusive: bool = False) -> DataFrame:
    """(idx, value, scan): running sums."""
    return global_scan(seq, F.col("value"), ["idx"], "scan", inclusive)


def scan_max(seq: DataFrame) -> DataFrame:
    """(idx, value, scan): running maxima, by partition and then over the partitions before."""
    spark = seq.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(seq.repartitionByRange(n, "idx").withColumn("__part", F.spark_partition_id()))
    tops = sorted((r["__part"], r["m"]) for r in dealt.groupBy("__part").agg(F.max("value").alias("m")).collect())
    best, rows = None, []
    for part, m in tops:
        rows.append((part, best))
        best = m if best is None else max(best, m)
    before = spark.createDataFrame(rows, f"__part int, __before {dict(seq.dtypes)['value']}")
    upto = Window.partitionBy("__part").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(before), "__part").select("idx", "value", F.greatest("__before", F.max("value").over(upto)).alias("scan"))


def rank(seq: DataFrame) -> DataFrame:
    """(idx, rank): the stable place of each element in sorted order."""
    return dense_index(seq, ["value", "idx"], "rank").select("idx", "rank")


def neighbours(seq: DataFrame) -> DataFrame:
    """(idx, value, before): each element with the one before it, by a join on the place."""
    return seq.select("idx", "value").join(seq.select((F.col("idx") + 1).alias("idx"), F.col("value").alias("before")), "idx", "left")


def unique(seq: DataFrame) -> DataFrame:
    """The first of each run of equal values."""
    return neighbours(seq).filter(F.col("before").isNull() | (F.col("value") != F.col("before"))).select("idx", "value")


def is_sorted(seq: DataFrame) -> DataFrame:
    """One row: sorted, and the first place that is out of order (the length if none)."""
    bad = neighbours(seq).filter("value < before")
    return bad.agg(F.count("*").alias("n"), F.min("idx").alias("at")).crossJoin(seq.agg(F.count("*").alias("length"))).select((F.col("n") == 0).alias("sorted"), F.coalesce("at", "length").alias("until"))


def is_partitioned(seq: DataFrame, flag: Column) -> DataFrame:
    """One row: whether no true flag comes after a false one."""
    return seq.agg(F.coalesce(F.max(F.when(flag, F.col("idx"))) < F.min(F.when(~flag, F.col("idx"))), F.lit(True)).alias("partitioned"))


def find_if(seq: DataFrame, flag: Column) -> DataFrame:
    return seq.filter(flag).agg(F.min("idx").alias("at"))


def adjacent_find(seq: DataFrame) -> DataFrame:
    """One row: the first place whose next value is equal."""
    return neighbours(seq).filter("value = before").agg((F.min("idx") - 1).alias("at"))


def mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the first place where the sequences differ or one ends; null if they are equal."""
    j = a.join(b.select("idx", F.col("value").alias("other")), "idx", "full")
    return j.filter(~F.col("value").eqNullSafe(F.col("other"))).agg(F.min("idx").alias("at"))


def lexicographical_less(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.join(b.select("idx", F.col("value").alias("other")), "idx", "full").filter(~F.col("value").eqNullSafe(F.col("other")))
    first = j.agg(F.min(F.struct("idx", "value", "other")).alias("m"))
    return first.select(F.when(F.col("m").isNull(), False).when(F.col("m.other").isNull(), False).when(F.col("m.value").isNull(), True).otherwise(F.col("m.value") < F.col("m.other")).alias("less"))


def search(seq: DataFrame, pattern: list) -> DataFrame:
    """(idx): all places where the values of pattern follow each other."""
    spark = seq.sparkSession
    kind = dict(seq.dtypes)["value"]
    p = spark.createDataFrame([(i, x) for i, x in enumerate(pattern)], f"off long, value {kind}")
    hits = seq.join(F.broadcast(p), "value").select((F.col("idx") - F.col("off")).alias("idx")).groupBy("idx").agg(F.count("*").alias("n"))
    return hits.filter(F.col("n") == len(pattern)).select("idx")


def extremes(seq: DataFrame) -> DataFrame:
    """One row: the first places and values of the least and the greatest element."""
    low, high = F.min(F.struct("value", "idx")), F.max(F.struct("value", (-F.col("idx")).alias("i")))
    return seq.agg(low.alias("a"), high.alias("b")).select(F.col("a.idx").alias("min_at"), F.col("a.value").alias("min"), (-F.col("b.i")).alias("max_at"), F.col("b.value").alias("max"))


def by_index(pairs: DataFrame, buckets: int, aggregate: Column, identity: Column) -> DataFrame:
    """(key, result) for every key below buckets, empty ones with the identity."""
    keys = pairs.sparkSession.range(buckets).select(F.col("id").alias("key"))
    return keys.join(pairs.groupBy("key").agg(aggregate.alias("r")), "key", "left").select("key", F.coalesce("r", identity).alias("result"))


def group_by_key(pairs: DataFrame) -> DataFrame:
    """(key, values): arrays in order of place."""
    return pairs.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("values"))


def kth_smallest(seq: DataFrame, k: int) -> DataFrame:
    """One row: the k-th smallest value, from 0."""
    return seq.orderBy("value", "idx").limit(k + 1).agg(F.max("value").alias("value"))


def top_k(df: DataFrame, by: list[str], order: list, k: int, ties: bool = False) -> DataFrame:
    """The first k rows of each group; with ties, also those equal to the k-th."""
    f = F.rank() if ties else F.row_number()
    return df.withColumn("__n", f.over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


def shuffle(seq: DataFrame, seed: int = 0) -> DataFrame:
    """A permutation by a hash of the place and the seed."""
    return dense_index(seq.select(F.xxhash64("idx", F.lit(seed)).alias("h"), F.col("idx").alias("from"), "value"), ["h", "from"]).select("idx", "value")


def tail(seq: DataFrame, shares: list[float]) -> DataFrame:
    """(share, value): the element at floor(share * n) of the sorted sequence."""
    n = seq.count()
    ranked = dense_index(seq, ["value", "idx"], "rank")
    wanted = seq.sparkSession.createDataFrame([(s, int(s * n)) for s in shares], "share double, rank long")
    return ranked.join(F.broadcast(wanted), "rank").select("share", "value")


def split_at(seq: DataFrame, flag: Column) -> DataFrame:
    """(idx, value, part): a part ends with each flagged element."""
    return global_scan(seq.withColumn("__f", flag.cast("long")), F.col("__f"), ["idx"], "part", inclusive=False).drop("__f")


def max_contiguous_sum(seq: DataFrame) -> DataFrame:
    """One row: the greatest sum of a run of neighbours, 0 for none."""
    sums = scan(seq, inclusive=True).select("idx", F.col("scan").alias("s"))
    low = scan_max(sums.select((F.col("idx") + 1).alias("idx"), (-F.col("s")).alias("value"))).select("idx", F.col("scan").alias("m"))
    best = sums.join(low, "idx", "left").select(F.greatest(F.col("s"), F.col("s") + F.coalesce("m", F.lit(0.0))).alias("b"))
    return best.agg(F.greatest(F.max("b"), F.lit(0.0)).alias("best"))


def line_fit(points: DataFrame) -> DataFrame:
    """One row: intercept and slope of y on x by least squares."""
    return points.agg(F.regr_intercept("y", "x").alias("intercept"), F.regr_slope("y", "x").alias("slope"))


def primes(spark: SparkSession, n: int) -> DataFrame:
    """(prime) up to n: numbers that are no multiple of a prime up to their root."""
    root = int(n**0.5)
    small = [p for p in range(2, root + 1) if all(p % q for q in range(2, int(p**0.5) + 1))]
    steps = spark.createDataFrame([(p,) for p in small], "p long") if small else spark.createDataFrame([], "p long")
    multiples = steps.select(F.explode(F.sequence(F.col("p") * F.col("p"), F.lit(n), F.col("p"))).alias("prime"))
    return spark.range(2, n + 1).select(F.col("id").alias("prime")).join(multiples, "prime", "left_anti")


def cycle_count(permutation: DataFrame) -> int:
    """The number of cycles of (idx, value), value the place that idx goes to."""
    from .components import connected_components

    e = permutation.select(F.col("idx").alias("src"), F.col("value").alias("dst"))
    v = permutation.select(F.col("idx").alias("id"))
    both = cut(e.union(e.select("dst", "src")))
    return connected_components(v, both).select("label").distinct().count()
