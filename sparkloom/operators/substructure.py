"""Cores, dense subgraphs, triangles, cliques and cycles of undirected graphs (both directions of an edge present)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import cut, dense_index
from .graph import degree_rank, degrees, orient


def core_numbers(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, core, round): vertices of degree at most k are peeled, round by round, k rising to the least degree left. A round writes the
    vertices once; edges stay as they are dealt, as only those of peeled vertices are joined and each vertex is peeled once."""
    e = cut(edges.select("src", "dst").repartition("src"))
    none = F.lit(None)
    state = cut(degrees(vertices, e).select("id", F.col("out_degree").alias("d"), none.cast("long").alias("core"), none.cast("int").alias("round")))
    k, number = 0, 0
    while True:
        least = state.filter("core is null").agg(F.min("d")).first()[0]
        if least is None:
            return state.select("id", "core", "round")
        k, number = max(k, least), number + 1
        now = F.col("core").isNull() & (F.col("d") <= k)
        lost = state.filter(now).select(F.col("id").alias("src")).join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
        state = cut(state.join(lost, "id", "left").select(
            "id", F.when(F.col("core").isNull() & ~now, F.col("d") - F.coalesce("n", F.lit(0))).otherwise(F.col("d")).alias("d"),
            F.when(now, F.lit(k)).otherwise(F.col("core")).cast("long").alias("core"), F.when(now, F.lit(number)).otherwise(F.col("round")).alias("round"),
        ))


def degeneracy_order(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rank): by the rounds of core peeling, then id."""
    return dense_index(core_numbers(vertices, edges), ["round", "id"], "rank").select("id", "rank")


def _peel(vertices: DataFrame, edges: DataFrame, choose) -> DataFrame:
    """(id, round): choose(left, n) gives the rows of left (id, d) that a round removes."""
    e = cut(edges.select("src", "dst").repartition("src"))
    state = cut(degrees(vertices, e).select("id", F.col("out_degree").alias("d"), F.lit(None).cast("int").alias("round")))
    n, number = state.count(), 0
    while state.filter("round is null").limit(1).count():
        number += 1
        gone = cut(choose(state.filter("round is null").select("id", "d"), n).select("id", F.lit(number).alias("now")))
        lost = gone.select(F.col("id").alias("src")).join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
        state = cut(state.join(gone, "id", "left").join(lost, "id", "left").select("id", (F.col("d") - F.coalesce("n", F.lit(0))).alias("d"), F.coalesce("round", "now").alias("round")))
    return state.select("id", "round")


def goodrich_pszona_order(vertices: DataFrame, edges: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """(id, rank): each round peels the n e/(2+e) vertices of least (degree, id) of those left."""

    def choose(left: DataFrame, n: int) -> DataFrame:
        now = left.count()
        import math

        return left.orderBy("d", "id").limit(max(1, math.ceil(now * epsilon / (2 + epsilon))))

    return dense_index(_peel(vertices, edges, choose), ["round", "id"], "rank").select("id", "rank")


def barenboim_elkin_order(vertices: DataFrame, edges: DataFrame, epsilon: float = 2.5) -> DataFrame:
    """(id, rank): each round peels the vertices of degree below ceil(density * epsilon), or those of least degree."""
    import math

    alpha = densest_peeling(vertices, edges)
    cutoff = max(1, math.ceil(alpha * epsilon))

    def choose(left: DataFrame, n: int) -> DataFrame:
        low = left.filter(F.col("d") < cutoff)
        return low if low.limit(1).count() else left.filter(F.col("d") == left.agg(F.min("d")).first()[0])

    return dense_index(_peel(vertices, edges, choose), ["round", "id"], "rank").select("id", "rank")


def densest_peeling(vertices: DataFrame, edges: DataFrame, epsilon: float = 0.001) -> float:
    """The greatest density (sum of degrees over vertices, an edge counted twice) met when each round removes the vertices of
    degree at most (1 + epsilon) times the density."""
    e, left, best = cut(edges.select("src", "dst")), cut(vertices.select("id")), 0.0
    while True:
        d = cut(degrees(left, e).select("id", F.col("out_degree").alias("d")))
        row = d.agg(F.count("*"), F.sum("d")).first()
        if not row[0]:
            return best
        density = row[1] / row[0]
        best = max(best, density)
        left = cut(d.filter(F.col("d") > (1 + epsilon) * density).select("id"))
        x = left.withColumnRenamed("id", "x")
        e = cut(e.join(x, e["src"] == x["x"], "left_semi").join(x, e["dst"] == x["x"], "left_semi"))


def densest_charikar(vertices: DataFrame, edges: DataFrame, order: DataFrame | None = None) -> float:
    """The greatest of 2 * edges among the vertices from i on / (n - i) over a peel order (id, rank), by default that of the cores."""
    order = cut(order if order is not None else degeneracy_order(vertices, edges))
    n = order.count()
    a, b = order.select(F.col("id").alias("src"), F.col("rank").alias("a")), order.select(F.col("id").alias("dst"), F.col("rank").alias("b"))
    later = edges.join(a, "src").join(b, "dst").filter("a < b").groupBy(F.col("a").alias("rank")).agg((F.count("*") * 2).alias("n"))
    from ..plans.loops import global_scan

    rows = order.join(later, "rank", "left").select((F.lit(n - 1) - F.col("rank")).alias("back"), F.coalesce("n", F.lit(0)).alias("n"))
    summed = global_scan(rows, F.col("n"), ["back"], "s")
    return summed.agg(F.max(F.col("s") / (F.col("back") + 1))).first()[0] or 0.0


def densest_greedy_pp(vertices: DataFrame, edges: DataFrame, times: int = 3) -> float:
    """Charikar's greedy again and again: a vertex's load, the edges charged to it so far, adds to its degree in the next order.
    The order of a turn is by load and degree at its start, then id."""
    load = cut(vertices.select("id", F.lit(0).cast("long").alias("load")))
    best = densest_charikar(vertices, edges)
    d = cut(degrees(vertices, edges).select("id", F.col("out_degree").alias("d")))
    for _ in range(times):
        order = cut(dense_index(d.join(load, "id").select("id", (F.col("d") + F.col("load")).alias("k")), ["k", "id"], "rank").select("id", "rank"))
        best = max(best, densest_charikar(vertices, edges, order))
        a, b = order.select(F.col("id").alias("src"), F.col("rank").alias("a")), order.select(F.col("id").alias("dst"), F.col("rank").alias("b"))
        charged = edges.join(a, "src").join(b, "dst").filter("a < b").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
        load = cut(load.join(charged, "id", "left").select("id", (F.col("load") + F.coalesce("n", F.lit(0))).alias("load")))
    return best


def cliques(vertices: DataFrame, edges: DataFrame, k: int, ranks: DataFrame | None = None) -> DataFrame:
    """(v1 .. vk): each clique once. Edges are oriented by rank (by default degree, id), which bounds the fan-out; a partial clique
    carries its common later neighbours as an array, so no pair is tried that is not an edge."""
    ranks = cut(ranks if ranks is not None else degree_rank(vertices, edges))
    o = cut(orient(edges, ranks))
    later = cut(o.groupBy("src").agg(F.collect_set("dst").alias("c")))
    found = later.select(F.col("src").alias("v1"), "c")
    for i in range(2, k):
        grown = found.select(*[f"v{j}" for j in range(1, i)], "c", F.explode("c").alias(f"v{i}"))
        found = grown.join(later.select(F.col("src").alias(f"v{i}"), F.col("c").alias("n")), f"v{i}").select(*[f"v{j}" for j in range(1, i + 1)], F.array_intersect("c", "n").alias("c")).filter(F.size("c") >= k - i)
    return found.select(*[f"v{j}" for j in range(1, k)], F.explode("c").alias(f"v{k}"))


def triangles(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v1, v2, v3), each triangle once."""
    return cliques(vertices, edges, 3)


def clique_counts(vertices: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(id, cliques) for every vertex."""
    each = cliques(vertices, edges, k).select(F.explode(F.array(*[f"v{j}" for j in range(1, k + 1)])).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return vertices.select("id").join(each, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("cliques"))


def clique_core_numbers(vertices: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """(id, core): as core numbers, with the number of k-cliques of a vertex for its degree."""
    names = [f"v{j}" for j in range(1, k + 1)]
    left, all_ = cut(vertices.select("id")), cut(cliques(vertices, edges, k))
    done, level = left.select("id", F.lit(0).cast("long").alias("core")).limit(0), 0
    while True:
        each = all_.select(F.explode(F.array(*names)).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
        now = cut(left.join(each, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")))
        least = now.agg(F.min("n")).first()[0]
        if least is None:
            return done
        level = max(level, least)
        gone = cut(now.filter(F.col("n") <= level).select("id"))
        done = cut(done.union(gone.select("id", F.lit(level).cast("long").alias("core"))))
        left = cut(left.join(gone, "id", "left_anti"))
        for name in names:
            all_ = all_.join(gone.withColumnRenamed("id", name), name, "left_anti").select(*names)
        all_ = cut(all_)


def clique_peeling_density(vertices: DataFrame, edges: DataFrame, k: int = 3, epsilon: float = 0.1) -> float:
    """The greatest number of k-cliques over vertices when each round removes those with at most k (1 + epsilon) that density."""
    names = [f"v{j}" for j in range(1, k + 1)]
    left, all_, best = cut(vertices.select("id")), cut(cliques(vertices, edges, k)), 0.0
    while True:
        n, c = left.count(), all_.count()
        if not n or not c:
            return best
        density = c / n
        best = max(best, density)
        each = all_.select(F.explode(F.array(*names)).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
        gone = cut(left.join(each, "id", "left").filter(F.coalesce("n", F.lit(0)) <= k * (1 + epsilon) * density).select("id"))
        left = cut(left.join(gone, "id", "left_anti"))
        for name in names:
            all_ = all_.join(gone.withColumnRenamed("id", name), name, "left_anti").select(*names)
        all_ = cut(all_)


def approximate_clique_count(vertices: DataFrame, edges: DataFrame, k: int, colours: int = 2, seed: int = 0) -> int:
    """Cliques of one colour, times colours ** (k - 1)."""
    from .graph import colour_sparsify

    return cliques(vertices, colour_sparsify(edges, colours, seed), k).count() * colours ** (k - 1)


def five_cycles(vertices: DataFrame, edges: DataFrame) -> int:
    """The number of simple cycles of five vertices. Each is counted at its vertex of greatest rank: two two-step paths from it
    over lower vertices meet in an edge, and the ends differ."""
    ranks = cut(degree_rank(vertices, edges))
    a, b = ranks.select(F.col("id").alias("src"), F.col("rank").alias("s")), ranks.select(F.col("id").alias("dst"), F.col("rank").alias("d"))
    e = cut(edges.select("src", "dst").join(a, "src").join(b, "dst").select("s", "d"))
    down = e.filter("d < s")
    path = cut(down.select(F.col("s").alias("top"), F.col("d").alias("x")).join(e.select(F.col("s").alias("x"), F.col("d").alias("y")), "x").filter("y < top").select("top", "x", "y"))
    left = path.join(e.select(F.col("s").alias("y"), F.col("d").alias("z")), "y").filter("z < top and z <> x")
    right = path.select("top", F.col("x").alias("x2"), F.col("y").alias("z"))
    return left.join(right, ["top", "z"]).filter("x < x2 and y <> x2").count()
