"""Components, forests, strong components, clusterings by distance. Labels are least ids, so results do not depend on scheduling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import cut, less, propagate, until_stable
from .graph import first_of


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the least id of the component.

    A round hooks each label to the least label among its members' neighbours and then jumps over one pointer, so the number of
    rounds grows with the logarithm of the diameter rather than with it."""
    edges = cut(edges.select("src", "dst").repartition("src"))
    state = vertices.select("id", F.col("id").alias("label"), F.lit(True).alias("active"))

    def step(s: DataFrame) -> DataFrame:
        seen = s.select(F.col("id").alias("src"), F.col("label").alias("m")).join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.min("m").alias("m"))
        low = s.join(seen, "id", "left").select("id", "label", F.least("label", "m").alias("m"))
        hook = low.groupBy("label").agg(F.min("m").alias("hook"))
        jump = hook.join(hook.select(F.col("label").alias("hook"), F.col("hook").alias("up")), "hook", "left").select("label", F.least("hook", F.coalesce("up", "hook")).alias("new"))
        joined = s.join(jump, "label", "left")
        return joined.select("id", F.coalesce("new", "label").alias("label"), (F.coalesce("new", "label") < F.col("label")).alias("active"))

    return until_stable(state, step).select("id", "label")


def label_propagation_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) by plain exchange of least labels along edges: as many rounds as the diameter."""
    state = vertices.select("id", F.col("id").alias("value"), F.lit(True).alias("active"))
    return propagate(state, edges.select("src", "dst"), F.col("value"), F.min, less).select("id", F.col("value").alias("label"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def components_of_predicate(vertices: DataFrame, edges: DataFrame, keep) -> DataFrame:
    """Components over the edges that satisfy keep."""
    return connected_components(vertices, edges.filter(keep))


def spanning_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent, child): a breadth-first tree of each component from its least vertex; a child's parent is the least possible."""
    labels = connected_components(vertices, edges)
    state = labels.select("id", F.when(F.col("id") == F.col("label"), 0).cast("long").alias("value"), (F.col("id") == F.col("label")).alias("active"))
    level = cut(propagate(state, edges.select("src", "dst"), F.col("value") + 1, F.min, less).select("id", F.col("value").alias("level")))
    a, b = level.select(F.col("id").alias("src"), F.col("level").alias("a")), level.select(F.col("id").alias("dst"), F.col("level").alias("b"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").filter("a + 1 = b").groupBy(F.col("dst").alias("child")).agg(F.min("src").alias("parent")).select("parent", "child")


def minimum_spanning_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w) with src < dst, by Boruvka rounds; equal weights are ordered by the ends. Edges within a component are dropped
    between rounds.

    A round hooks each component to the other end of its least edge. As no two edges are equal, the only cycles are pairs that hook
    to each other by one edge; the lesser of the two becomes a root, which takes no edge. Jumping over pointers then leads to roots."""
    a, b = vertices.select(F.col("id").alias("src")), vertices.select(F.col("id").alias("dst"))
    known = edges.filter("src < dst").join(a, "src", "left_semi").join(b, "dst", "left_semi")
    left = cut(known.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("w", "src", "dst").alias("k")))
    forest = left.limit(0).select("k.src", "k.dst", "k.w")

    def jump(s: DataFrame) -> DataFrame:
        over = s.select(F.col("c").alias("up"), F.col("up").alias("next"))
        return s.join(over, "up").select("c", F.col("next").alias("up"), "k", (F.col("next") != F.col("up")).alias("active"))

    while left.limit(1).count():
        both = left.select(F.col("a").alias("c"), F.col("b").alias("up"), "k").union(left.select("b", "a", "k"))
        hooks = cut(both.groupBy("c").agg(F.min(F.struct("k", "up")).alias("m")).select("c", "m.up", "m.k"))
        back = hooks.select(F.col("c").alias("up"), F.col("up").alias("back"))
        root = (F.col("back") == F.col("c")) & (F.col("c") < F.col("up"))
        state = hooks.join(back, "up").select("c", F.when(root, F.col("c")).otherwise(F.col("up")).alias("up"), "k", F.lit(True).alias("active"))
        state = until_stable(state, jump)
        forest = forest.union(state.filter("c <> up").select("k.src", "k.dst", "k.w"))
        a, b = state.select(F.col("c").alias("a"), F.col("up").alias("x")), state.select(F.col("c").alias("b"), F.col("up").alias("y"))
        left = cut(left.join(a, "a").join(b, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"), "k"))
    return forest


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the least id of the strong component.

    Vertices without in- or out-edges are components of their own and go first, again and again. In what is left, the least id
    that reaches a vertex colours it; what reaches the colour's own vertex within the colour is its component, and goes."""
    left, e = cut(vertices.select("id")), cut(edges.select("src", "dst"))
    done = vertices.select("id", F.col("id").alias("label")).limit(0)
    while True:
        while True:
            ends = e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            trimmed = cut(left.join(ends, "id", "left_anti"))
            if trimmed.limit(1).count() == 0:
                break
            done = done.union(trimmed.select("id", F.col("id").alias("label")))
            left = cut(left.join(trimmed, "id", "left_anti"))
            gone = trimmed.withColumnRenamed("id", "x")
            e = cut(e.join(gone, e["src"] == gone["x"], "left_anti").join(gone, e["dst"] == gone["x"], "left_anti"))
        if left.limit(1).count() == 0:
            return cut(done)
        colour = cut(propagate(left.select("id", F.col("id").alias("value"), F.lit(True).alias("active")), e, F.col("value"), F.min, less).select("id", F.col("value").alias("colour")))
        a, b = colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), colour.select(F.col("id").alias("dst"), F.col("colour").alias("b"))
        same = cut(e.join(a, "src").join(b, "dst").filter("a = b").select("src", "dst"))
        root = F.col("id") == F.col("colour")
        start = colour.select("id", F.when(root, F.col("colour")).alias("value"), root.alias("active"))
        back = propagate(start, same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), F.col("value"), F.min, less)
        found = cut(back.filter("value is not null").select("id", F.col("value").alias("label")))
        done = cut(done.union(found))
        left = cut(left.join(found, "id", "left_anti"))
        gone = found.select(F.col("id").alias("x"))
        e = cut(same.join(gone, same["src"] == gone["x"], "left_anti").join(gone, same["dst"] == gone["x"], "left_anti"))


def low_diameter_decomposition(vertices: DataFrame, edges: DataFrame, beta: float = 0.2, seed: int = 1) -> DataFrame:
    """(id, label, start): each vertex starts a search at round floor(max shift - shift), its shift drawn from an exponential
    distribution of rate beta by a hash of the id; the search that comes first (then the least centre) takes a vertex."""
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    shifts = cut(vertices.select("id", (-F.log(u) / beta).alias("shift")))
    top = shifts.agg(F.max("shift")).first()[0] or 0.0
    start = F.floor(F.lit(top) - F.col("shift")).cast("long")
    state = shifts.select("id", F.struct(start.alias("at"), F.col("id").alias("centre")).alias("value"), F.lit(True).alias("active"))
    message = F.struct((F.col("value.at") + 1).alias("at"), F.col("value.centre").alias("centre"))
    found = propagate(state, edges.select("src", "dst"), message, F.min, less)
    return found.select("id", F.col("value.centre").alias("label"), F.col("value.at").alias("at"))


def spanner(vertices: DataFrame, edges: DataFrame, k: int = 4, seed: int = 1) -> DataFrame:
    """(src, dst), src < dst: the trees of a decomposition with beta = ln n / 2k, and one edge of each pair of adjacent clusters."""
    import math

    n = max(2, vertices.count())
    ldd = cut(low_diameter_decomposition(vertices, edges, math.log(n) / (2 * k), seed))
    a = ldd.select(F.col("id").alias("src"), F.col("label").alias("a"), F.col("at").alias("ta"))
    b = ldd.select(F.col("id").alias("dst"), F.col("label").alias("b"), F.col("at").alias("tb"))
    e = cut(edges.select("src", "dst").join(a, "src").join(b, "dst"))
    tree = first_of(e.filter("a = b and ta + 1 = tb"), ["dst"], [F.col("src")], 1).select("src", "dst")
    between = e.filter("a < b").groupBy("a", "b").agg(F.min(F.struct("src", "dst")).alias("e")).select("e.src", "e.dst")
    both = tree.union(between)
    return both.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def biconnected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, label) for each undirected edge, src < dst: edges with one label lie on a common cycle, or are a bridge.

    Tarjan-Vishkin on a breadth-first forest: preorder numbers and subtree sizes by levels, then for each subtree the least and
    greatest preorder number that its vertices' non-tree edges reach. A tree edge joins its parent's tree edge unless the
    subtree keeps to the parent's own subtree; the ends of a non-tree edge are joined when neither is an ancestor of the other."""
    forest = cut(spanning_forest(vertices, edges))
    level = forest.select(F.col("child").alias("id"))
    roots = vertices.select("id").join(level, "id", "left_anti")
    depth = cut(roots.select("id", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth")))
    d, all_ = 0, depth
    while True:
        d += 1
        depth = cut(depth.select(F.col("id").alias("parent")).join(forest, "parent").select(F.col("child").alias("id"), "parent", F.lit(d).alias("depth")))
        if depth.limit(1).count() == 0:
            break
        all_ = cut(all_.unionByName(depth))
    sizes = cut(all_.filter(F.col("depth") == d - 1).select("id", F.lit(1).cast("long").alias("size")))
    for k in range(d - 2, -1, -1):
        below = all_.filter(F.col("depth") == k + 1).join(sizes, "id").groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("s"))
        sizes = cut(sizes.union(all_.filter(F.col("depth") == k).select("id").join(below, "id", "left").select("id", (F.coalesce("s", F.lit(0)) + 1).alias("size"))))
    from pyspark.sql import Window

    from ..plans.loops import global_scan

    pre = cut(global_scan(roots.join(sizes, "id"), F.col("size"), ["id"], "pre", inclusive=False).select("id", "pre"))
    for k in range(1, d):
        before = Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        here = all_.filter(F.col("depth") == k).join(sizes, "id").join(pre.select(F.col("id").alias("parent"), F.col("pre").alias("p")), "parent")
        pre = cut(pre.union(here.select("id", (F.col("p") + 1 + F.coalesce(F.sum("size").over(before), F.lit(0))).alias("pre"))))
    tree = all_.join(sizes, "id").join(pre, "id")
    tree = cut(tree)
    t = forest.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    one = cut(edges.select("src", "dst").join(t.union(t.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), ["src", "dst"], "left_anti"))
    reach = one.join(pre.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("pre").alias("l"), F.max("pre").alias("h"))
    own = tree.join(reach, "id", "left").select("id", "parent", "depth", F.least("pre", "l").alias("low"), F.greatest("pre", "h").alias("high"))
    own = cut(own)
    marks = cut(own.filter(F.col("depth") == d - 1).select("id", "low", "high"))
    for k in range(d - 2, -1, -1):
        below = own.filter(F.col("depth") == k + 1).select("id", "parent").join(marks, "id").groupBy(F.col("parent").alias("id")).agg(F.min("low").alias("l"), F.max("high").alias("h"))
        marks = cut(marks.union(own.filter(F.col("depth") == k).join(below, "id", "left").select("id", F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high"))))
    info = cut(tree.select("id", "parent", "pre", "size").join(marks, "id"))
    up = info.select(F.col("id").alias("parent"), F.col("pre").alias("pp"), F.col("size").alias("ps"), F.col("parent").alias("grand"))
    joins = info.join(up, "parent").filter(F.col("grand").isNotNull() & ((F.col("low") < F.col("pp")) | (F.col("high") >= F.col("pp") + F.col("ps")))).select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    a = info.select(F.col("id").alias("src"), F.col("pre").alias("ap"), F.col("size").alias("as_"))
    b = info.select(F.col("id").alias("dst"), F.col("pre").alias("bp"), F.col("size").alias("bs"))
    cross = one.join(a, "src").join(b, "dst").filter("bp >= ap + as_").select("src", "dst")
    links = joins.union(cross)
    labels = connected_components(info.select("id"), links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    e = edges.filter("src < dst").select("src", "dst").join(a, "src").join(b, "dst")
    # an edge belongs to the tree edge above its later end in preorder
    return e.select("src", "dst", F.when(F.col("ap") > F.col("bp"), F.col("src")).otherwise(F.col("dst")).alias("id")).join(labels, "id").select("src", "dst", "label")
