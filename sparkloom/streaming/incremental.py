"""Batches of updates on kept results: connectivity under edge insertions with queries, as a foreachBatch sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.loops import cut


class IncrementalComponents:
    """Labels (id, label) under batches of (kind, src, dst): `insert` edges first, then answers to `query` pairs.

    A batch contracts its edges to labels and finds components of these alone; only rows whose label moves change. State is a
    table in the shared folder, replaced as a whole after each batch."""

    def __init__(self, spark: SparkSession):
        self.labels = spark.createDataFrame([], "id long, label long")

    def apply(self, batch: DataFrame) -> DataFrame:
        """(src, dst, connected) of the batch's queries, after its insertions."""
        batch = cut(batch)
        new = batch.filter("kind = 'insert'").select("src", "dst")
        ids = new.select(F.col("src").alias("id")).union(new.select("dst")).distinct()
        known = ids.join(self.labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
        known = cut(known)
        a, b = known.select(F.col("id").alias("src"), F.col("label").alias("a")), known.select(F.col("id").alias("dst"), F.col("label").alias("b"))
        links = new.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        both = cut(links.union(links.select("dst", "src")).distinct())
        moved = connected_components(known.select(F.col("label").alias("id")).distinct(), both).select(F.col("id").alias("label"), F.col("label").alias("new"))
        all_ = self.labels.union(known.join(self.labels, "id", "left_anti").select("id", "label"))
        self.labels = cut(all_.join(moved, "label", "left").select("id", F.coalesce("new", "label").alias("label")))
        q = batch.filter("kind = 'query'").select("src", "dst")
        x, y = self.labels.select(F.col("id").alias("src"), F.col("label").alias("a")), self.labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
        answer = q.join(x, "src", "left").join(y, "dst", "left")
        return answer.select("src", "dst", (F.coalesce("a", "src") == F.coalesce("b", "dst")).alias("connected"))

    def sink(self, answers: str):
        """A function for writeStream.foreachBatch: answers are appended to the Parquet folder."""

        def f(batch: DataFrame, number: int) -> None:
            self.apply(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(answers)

        return f
