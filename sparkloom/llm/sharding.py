"""Hilbert-curve ordering of several metadata columns, cut into shards of equal row counts. Built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.loops import global_scan
from . import common


def curve_table(dims: int) -> list[int]:
    """The curve as a state machine: entry state * 2**dims + corner is next state * 2**dims + digit.

    A state is (entry corner, direction), numbered entry * dims + direction, after the usual construction: reflected Gray codes,
    rotated so that each cell's exit meets the next cell's entry.
    """
    n, mask = dims, (1 << dims) - 1

    def turn(x: int, k: int) -> int:
        k %= n
        return ((x << k) | (x >> (n - k))) & mask

    def entry(w: int) -> int:
        return 0 if w == 0 else ((k := 2 * ((w - 1) // 2)) ^ (k >> 1))

    def ones(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1

    def direction(w: int) -> int:
        return 0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % n

    rank = {w ^ (w >> 1): w for w in range(1 << n)}
    table = []
    for state in range((1 << n) * n):
        e, d = divmod(state, n)
        for corner in range(1 << n):
            w = rank[turn(corner ^ e, -(d + 1))]
            table.append(((e ^ turn(entry(w), d + 1)) * n + (d + direction(w) + 1) % n) * (1 << n) + w)
    return table


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """The place of a cell on the curve through the grid of 2**bits cells in each of the given dimensions (long)."""
    n = len(cells)
    table = F.array(*[F.lit(x) for x in curve_table(n)])
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("state"))
    point = F.array(*[c.cast("int") for c in cells])

    def step(acc: Column, half: Column) -> Column:
        corner = sum((F.floor(F.get(point, F.lit(i)) / half) % 2 * (1 << i) for i in range(n)), F.lit(0))
        found = F.get(table, (acc["state"] * (1 << n) + corner).cast("int"))
        return F.struct((acc["at"] * (1 << n) + found % (1 << n)).cast("long").alias("at"), F.floor(found / (1 << n)).cast("int").alias("state"))

    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(bits))]), zero, step)["at"]


def number_of(column: Column, kind: T.DataType) -> Column:
    """What a dimension is quantised by: whole strings and bytes as they are, the rest as double."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return column
    return (F.unix_date(column) if isinstance(kind, T.DateType) else column).cast("double")


def edges_of(base: DataFrame, column: str, cells: int) -> list:
    """At most cells - 1 values that cut the column's rows into runs of about equal weight, over all rows: exact for strings and bytes, by
    running sums of the distinct values' counts, and by approximate quantiles for numbers. Nulls weigh nothing."""
    if dict(base.dtypes)[column] not in ("string", "binary"):
        shares = [k / cells for k in range(1, cells)]
        return sorted(set(base.agg(F.percentile_approx(column, shares, 10_000)).first()[0] or []))
    counts = base.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    upto = common.cut(global_scan(counts, F.col("n"), [column], "upto"))
    total = upto.agg(F.max("upto")).first()[0] or 1
    step = lambda x: F.floor(x * cells / total)
    cuts = upto.filter((step(F.col("upto")) > step(F.col("upto") - F.col("n"))) & (F.col("upto") - F.col("n") > 0))
    return sorted(r[0] for r in cuts.select(column).collect())  # one for each of the cells at most


def hilbert_shards(df: DataFrame, dims: Sequence[str], shards: int, keep: Sequence[Column], ties: Sequence[str], bits: int = 5) -> DataFrame:
    """The `keep` columns with curve (long), shard (int) and slot (long): rows in curve order, cut into `shards` runs whose
    counts differ by at most one. An empty df gives no rows.

    Each of `dims` is cut into 2**bits cells of about equal weight by its values' order; nulls share the lowest cell. Rows of a cell are ordered by the `ties` columns of the output. The order is a range-partitioned sort on
    curve and ties, so a cell or group of equal rows of any size spreads over partitions; a row's rank is its place in the
    partition after the counts of the partitions before. No window or sort sees more than a partition.
    """
    spark = df.sparkSession
    kinds = {f.name: f.dataType for f in df.schema}
    base = df.select(*keep, *[number_of(F.col(d), kinds[d]).alias(f"__{i}") for i, d in enumerate(dims)])
    base = common.cut(base)
    cells = 1 << bits
    cell = []
    for i in range(len(dims)):
        edges, value = edges_of(base, f"__{i}", cells), F.col(f"__{i}")
        cell.append(F.when(value.isNull(), 0).otherwise(F.array_size(F.filter(F.array(*[F.lit(x) for x in edges]), lambda edge: edge <= value))) if edges else F.lit(0))
    out = [c for c in base.columns if not c.startswith("__")]
    placed = base.select(*out, hilbert_index(cell, bits).alias("curve"))
    n = common.shuffle_partitions(spark)
    order = [F.col("curve"), *[F.col(t) for t in ties]]
    dealt = common.cut(placed.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    sizes = {r["__part"]: r["n"] for r in counts.collect()}  # a number for each partition
    total, before, rows = sum(sizes.values()), 0, []
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    starts = spark.createDataFrame(rows, "__part int, __before long")
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    ranked = dealt.join(F.broadcast(starts), "__part").withColumn("__rank", rank.cast("long"))
    size, more = divmod(total, shards)
    wide = more * (size + 1)
    shard = F.when(F.col("__rank") < wide, F.floor(F.col("__rank") / (size + 1))).otherwise(more + F.floor((F.col("__rank") - wide) / max(size, 1)))
    first = F.when(F.col("shard") <= more, F.col("shard") * (size + 1)).otherwise(wide + (F.col("shard") - more) * size)
    return ranked.withColumn("shard", shard.cast("int")).select(*out, "curve", "shard", (F.col("__rank") - first).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, dims: Sequence[str], path: str) -> DataFrame:
    """Writes the rows of hilbert_shards, whose `keep` holds all that is to be written, as one folder a shard in the order of their
    slots, and returns the zone map: shard, rows, and the least and greatest value of each of dims. A reader of a range of values
    needs the shards whose zones meet it."""
    n = common.shuffle_partitions(sharded.sparkSession)
    sharded.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    back = sharded.sparkSession.read.parquet(path)
    return back.groupBy("shard").agg(F.count("*").alias("rows"), *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)])
