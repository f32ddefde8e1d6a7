"""Independent sets, matchings, colourings and covers. Priorities are ids or hashes of ids, so results are functions of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.loops import cut, until_stable


def hash_priority(seed: int = 0) -> Column:
    return F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), F.col("id").alias("id"))


def independent_set(vertices: DataFrame, edges: DataFrame, priority: Column | None = None) -> DataFrame:
    """(id, chosen): the greedy maximal independent set by rising priority (default: id, the lexicographically first set).

    A round takes the open vertices that come before all their open neighbours and closes the neighbours."""
    p = F.struct(F.col("id").alias("id")) if priority is None else priority
    edges = cut(edges.select("src", "dst").repartition("src"))
    state = vertices.select("id", p.alias("p"), F.lit(None).cast("boolean").alias("chosen"), F.lit(True).alias("active"))

    def step(s: DataFrame) -> DataFrame:
        open_ = s.filter("chosen is null")
        near = open_.select(F.col("id").alias("src"), F.col("p").alias("q")).join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.min("q").alias("q"))
        take = cut(open_.join(near, "id", "left").filter("q is null or p < q").select("id", F.lit(True).alias("take")))
        shut = take.select(F.col("id").alias("src")).join(edges, "src").select(F.col("dst").alias("id"), F.lit(True).alias("shut")).distinct()
        new = s.join(take, "id", "left").join(shut, "id", "left")
        chosen = F.when(F.col("chosen").isNotNull(), F.col("chosen")).when(F.col("take"), True).when(F.col("shut"), False)
        return new.select("id", "p", chosen.alias("chosen")).withColumn("active", F.col("chosen").isNull())

    return until_stable(state, step).select("id", "chosen")


def maximal_matching(edges: DataFrame, priority: Column | None = None) -> DataFrame:
    """(src, dst), src < dst: the greedy maximal matching by rising priority of edges (default: (src, dst)). A round takes the open
    edges that come first at both their ends, and drops the edges that meet them."""
    p = F.struct("src", "dst") if priority is None else priority
    left = cut(edges.filter("src < dst").select("src", "dst").distinct().withColumn("p", p))
    found = left.select("src", "dst").limit(0)
    while left.limit(1).count():
        best = left.select(F.explode(F.array("src", "dst")).alias("id"), "p").groupBy("id").agg(F.min("p").alias("b"))
        a, b = best.select(F.col("id").alias("src"), F.col("b").alias("pa")), best.select(F.col("id").alias("dst"), F.col("b").alias("pb"))
        take = cut(left.join(a, "src").join(b, "dst").filter("p = pa and p = pb").select("src", "dst"))
        found = cut(found.union(take))
        used = take.select(F.explode(F.array("src", "dst")).alias("x"))
        left = cut(left.join(used, left["src"] == used["x"], "left_anti").join(used, left["dst"] == used["x"], "left_anti"))
    return found


def colouring(vertices: DataFrame, edges: DataFrame, log_degrees: bool = False, seed: int | None = None) -> DataFrame:
    """(id, colour): greedy colouring, largest degree first (or largest ceil(log2 degree)), ties by id or by a hash of it. A vertex
    takes the least colour that no neighbour before it has; isolated ones 0."""
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    key = F.ceil(F.log2(F.col("d"))) if log_degrees else F.col("d")
    tie = F.col("id") if seed is None else F.xxhash64("id", F.lit(seed))
    ranks = cut(vertices.select("id").join(degree, "id", "left").withColumn("d", F.coalesce("d", F.lit(1))).select("id", F.struct((-key).alias("k"), tie.alias("t"), F.col("id").alias("i")).alias("p")))
    a, b = ranks.select(F.col("id").alias("src"), F.col("p").alias("pa")), ranks.select(F.col("id").alias("dst"), F.col("p").alias("pb"))
    after = cut(edges.select("src", "dst").join(a, "src").join(b, "dst").filter("pa < pb").select("src", "dst").repartition("src"))
    waits = after.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    state = vertices.select("id").join(waits, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("int").alias("colour"), F.array().cast("array<int>").alias("seen"), F.lit(True).alias("active"))

    def step(s: DataFrame) -> DataFrame:
        ready = F.col("colour").isNull() & (F.col("n") == 0)
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("seen")), F.col("seen")))
        done = cut(s.withColumn("now", ready).withColumn("colour", F.when(ready, free).otherwise(F.col("colour"))))
        told = done.filter("now").select(F.col("id").alias("src"), F.col("colour").alias("c")).join(after, "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("m"), F.collect_set("c").alias("more"))
        new = done.join(told, "id", "left")
        return new.select("id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n"), "colour", F.when(F.col("more").isNull(), F.col("seen")).otherwise(F.array_union("seen", "more")).alias("seen"), F.col("colour").isNull().alias("active"))

    return until_stable(state, step).select("id", "colour")


def colouring_conflicts(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """Edges whose ends share a colour: none in a valid colouring."""
    a, b = colours.select(F.col("id").alias("src"), F.col("colour").alias("a")), colours.select(F.col("id").alias("dst"), F.col("colour").alias("b"))
    return edges.join(a, "src").join(b, "dst").filter("a = b").select("src", "dst")


def set_cover(memberships: DataFrame, epsilon: float = 0.01) -> DataFrame:
    """(src) of memberships (src: set, dst: element): a cover by falling buckets of floor(log_{1+epsilon}) of uncovered elements.

    In a round the sets of the highest bucket bid for their uncovered elements by a hash of set and round; a set that wins at least
    1 / (1 + epsilon) of its bucket's least size joins the cover, and its elements are covered."""
    left = cut(memberships.select("src", "dst").distinct())
    cover, number = left.select("src").limit(0), 0
    while True:
        size = cut(left.groupBy("src").agg(F.count("*").alias("n")).withColumn("b", F.floor(F.log("n") / F.log(F.lit(1 + epsilon)) + 1e-9)))
        top = size.agg(F.max("b")).first()[0]
        if top is None:
            return cover.distinct()
        number += 1
        bids = left.join(size.filter(F.col("b") == top), "src").withColumn("h", F.struct(F.xxhash64("src", F.lit(number)), F.col("src")))
        won = bids.groupBy("dst").agg(F.min("h").alias("h")).select("dst", "h.src").groupBy("src").agg(F.count("*").alias("won"))
        need = (1 + epsilon) ** (top - 1)
        take = cut(won.filter(F.col("won") >= need).select("src"))
        if take.limit(1).count() == 0:
            take = cut(won.orderBy(F.desc("won"), "src").limit(1).select("src"))
        cover = cut(cover.union(take))
        covered = left.join(take, "src", "left_semi").select("dst").distinct()
        left = cut(left.join(covered, "dst", "left_anti").select("src", "dst"))
