"""Driver loops over DataFrames: what every iterative operator shares."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder of a local master;
    on a cluster that is an error, as executors would not see it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="sparkloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to spark.checkpoint.dir: a loop's plan stays short, and lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return sized(df.checkpoint(eager=True))


def sized(df: DataFrame) -> DataFrame:
    """A written table without the size that Spark foretold for its plan, where that is beyond all sizes. A join's is the product of
    its sides', and the written table keeps it: its digits tripled each round of a loop until the driver was full."""
    plan = df._jdf.queryExecution().analyzed()
    try:
        if plan.stats().sizeInBytes() < 1 << 62:
            return df
    except ValueError:  # more digits than Python reads
        pass
    spark, none = df.sparkSession, plan.stream()
    plan = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, spark._jsparkSession, none, none)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


class Unstable(RuntimeError):
    """A loop has used up its rounds."""


def until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 10_000, active: str = "active") -> DataFrame:
    """Repeats state = step(state) while any row's `active` column is true; one written table and one short action a round.
    A state that is not stable after `most` rounds raises an error."""
    state = cut(state)
    for _ in range(most):
        if state.filter(active).limit(1).count() == 0:
            return state
        state = cut(step(state))
    if state.filter(active).limit(1).count():
        raise Unstable(f"not stable after {most} rounds")
    return state


def rounds(state: DataFrame, step: Callable[[DataFrame], DataFrame], n: int) -> DataFrame:
    """state after n steps."""
    for _ in range(n):
        state = cut(step(state))
    return state


def propagate(state: DataFrame, edges: DataFrame, message: Column, combine: Callable[[Column], Column], better: Callable[[Column, Column], Column], bucket: Column | None = None, most: int = 10_000) -> DataFrame:
    """Values along edges to a fixed point.

    state: (id, value, active). A round sends `message` (of value and the edge's columns) from the active rows along edges
    (src, dst, ...), combines what meets at a vertex, and takes it where better(new, old); these rows are active next. With
    `bucket`, only active rows of the least bucket send, and the others wait. Messages are combined before they are shuffled.
    """
    edges = cut(edges.repartition("src"))

    def step(s: DataFrame) -> DataFrame:
        sending = s.filter("active")
        now = F.lit(True)
        if bucket is not None:
            least = sending.agg(F.min(bucket)).first()[0]
            now = bucket <= F.lit(least)
            sending = sending.filter(now)
        sent = sending.select(F.col("id").alias("src"), "value").join(edges, "src").groupBy("dst").agg(combine(message).alias("new"))
        joined = s.join(sent, s["id"] == sent["dst"], "left")
        taken = F.coalesce(better(F.col("new"), F.col("value")), F.lit(False))
        waiting = F.col("active") & ~now if bucket is not None else F.lit(False)
        return joined.select("id", F.when(taken, F.col("new")).otherwise(F.col("value")).alias("value"), (taken | waiting).alias("active"))

    return until_stable(state, step, most)


def less(new: Column, old: Column) -> Column:
    """Whether new is a value and less than old; null is infinite."""
    return new.isNotNull() & (old.isNull() | (new < old))


def more(new: Column, old: Column) -> Column:
    return new.isNotNull() & (old.isNull() | (new > old))


def global_scan(df: DataFrame, value: Column, order: list[str], name: str = "scan", inclusive: bool = True) -> DataFrame:
    """df with the running sum of value in the given order, without a window over all rows.

    Rows are range-partitioned by the order and summed within their partition; the sums of the partitions before, one number for
    each partition, are added. Exclusive sums start with 0."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    dealt = cut(df.withColumn("__v", value).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    sums = sorted((r["__part"], r["s"]) for r in dealt.groupBy("__part").agg(F.sum("__v").alias("s")).collect())
    real = dict(dealt.dtypes)["__v"] in ("double", "float")
    before, rows = 0.0 if real else 0, []
    for part, s in sums:
        rows.append((part, before))
        before += s or 0
    starts = spark.createDataFrame(rows, "__part int, __before " + ("double" if real else "long"))
    upto = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return dealt.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.coalesce(F.sum("__v").over(upto), F.lit(0))).select(*cols, name)


def dense_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """df with its rows numbered from 0 in the given order, without a window over all rows."""
    return global_scan(df, F.lit(1).cast("long"), order, name, inclusive=False)
