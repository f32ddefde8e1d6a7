"""Potentials and forces of point sources (id, x, y, z, q): direct sums, and a multipole tree code on octree cells."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import morton
from ..plans.loops import cut

OUT = "id long, p double, fx double, fy double, fz double"


def bounding_box(bodies: DataFrame) -> DataFrame:
    return bodies.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)])


def direct_sum(bodies: DataFrame, targets: DataFrame | None = None, block: int = 4096) -> DataFrame:
    """(id, p, fx, fy, fz): sum q / r and -sum q d / r**3 over sources at another place; targets (default: all) go in blocks of
    bounded size to all sources, whose tasks send back a partial sum for each target."""
    targets = bodies if targets is None else targets
    parts, held = [], []

    def add(rows):
        shared = bodies.sparkSession.sparkContext.broadcast(np.asarray(rows, float))

        def f(batches, s=shared):
            t = s.value
            total = np.zeros((len(t), 4))
            for b in batches:
                x, q = b[["x", "y", "z"]].to_numpy(float), b["q"].to_numpy(float)
                for k in range(0, len(x), 1024):
                    d = t[:, None, 1:4] - x[None, k : k + 1024]
                    r2 = (d * d).sum(2)
                    inv = np.where(r2 > 0, 1 / np.sqrt(np.where(r2 > 0, r2, 1)), 0)
                    w = q[None, k : k + 1024] * inv
                    total[:, 0] += w.sum(1)
                    total[:, 1:] -= np.einsum("ij,ijk->ik", w * inv * inv, d)
            yield pd.DataFrame({"id": t[:, 0].astype(int), "p": total[:, 0], "fx": total[:, 1], "fy": total[:, 2], "fz": total[:, 3]})

        parts.append(bodies.select("x", "y", "z", "q").mapInPandas(f, OUT))

    for r in targets.select("id", "x", "y", "z").toLocalIterator():
        held.append(tuple(r))
        if len(held) == block:
            add(held)
            held = []
    if held:
        add(held)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("p", "fx", "fy", "fz")])


def octree(bodies: DataFrame, most: int = 64, deepest: int = 10) -> DataFrame:
    """(id, x, y, z, q, level, key): each body's leaf, the first cell on its way down that holds at most `most` bodies. One
    aggregation a level, on those bodies that are still in larger cells."""
    box = bounding_box(bodies).first()
    low = [box[f"min_{c}"] for c in "xyz"]
    size = max(box[f"max_{c}"] - box[f"min_{c}"] for c in "xyz") * (1 + 1e-9) or 1.0
    wide = 1 << deepest
    cells = [F.least(F.floor((F.col(c) - low[i]) / size * wide), F.lit(wide - 1)) for i, c in enumerate("xyz")]
    left = cut(bodies.select("id", "x", "y", "z", "q", morton(*cells, deepest).alias("full")))
    done = None
    for level in range(deepest + 1):
        key = F.shiftright("full", 3 * (deepest - level))
        counts = left.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
        marked = cut(left.withColumn("key", key).join(counts, "key"))
        here = marked.filter((F.col("n") <= most) | F.lit(level == deepest)).select("id", "x", "y", "z", "q", F.lit(level).alias("level"), "key")
        done = here if done is None else done.union(here)
        left = marked.filter((F.col("n") > most) & F.lit(level < deepest)).select("id", "x", "y", "z", "q", "full")
    return cut(done)


def _powers(p: int) -> list[tuple[int, int, int]]:
    return [(a, b, n - a - b) for n in range(p + 1) for a in range(n + 1) for b in range(n + 1 - a)]


def multipole_sum(bodies: DataFrame, theta: float = 0.5, order: int = 4, most: int = 64) -> DataFrame:
    """(id, p, fx, fy, fz) by a tree code: Cartesian moments of leaves, added up to their parents a level at a time, and for each leaf
    the cells that are far from it by their moments, the near leaves body by body.

    Pairs of cells start at the roots and are refined a level at a time: a pair whose radii are below theta times the distance of
    its centres is far; a pair of leaves is near; otherwise the larger cell is replaced by its children. Cells travel, never bodies
    to all bodies."""
    tree = octree(bodies, most)
    powers = _powers(order)
    centre = tree.groupBy("level", "key").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c{c}") for c in "xyz"])
    body = tree.join(centre.select("level", "key", "cx", "cy", "cz"), ["level", "key"])
    d = [F.col(c) - F.col(f"c{c}") for c in "xyz"]

    def term(a, b, c):
        e = F.col("q")
        for v, n in zip(d, (a, b, c)):
            for _ in range(n):
                e = e * v
        return e / float(math.factorial(a) * math.factorial(b) * math.factorial(c))

    leaves = cut(body.groupBy("level", "key").agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.first("cz").alias("cz"), F.count("*").alias("n"), F.max(F.sqrt(d[0] ** 2 + d[1] ** 2 + d[2] ** 2)).alias("r"), F.array(*[F.sum(term(*p)) for p in powers]).alias("m")))
    leaves = leaves.withColumn("leaf", F.lit(True))
    deepest = leaves.agg(F.max("level")).first()[0] or 0
    cols = ["level", "key", "cx", "cy", "cz", "n", "r", "m", "leaf"]
    cells, below = leaves.select(*cols), leaves.filter(F.col("level") == deepest).select(*cols)
    index = {p: i for i, p in enumerate(powers)}

    def lift(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(float)
        x = pdf[["cx", "cy", "cz"]].to_numpy(float)
        c = (x * n[:, None]).sum(0) / n.sum()
        total = np.zeros(len(powers))
        for i in range(len(pdf)):
            s, m = x[i] - c, np.asarray(pdf["m"].iloc[i])
            for (a, b, e), k in index.items():
                for a2 in range(a + 1):
                    for b2 in range(b + 1):
                        for e2 in range(e + 1):
                            total[k] += m[index[(a2, b2, e2)]] * s[0] ** (a - a2) * s[1] ** (b - b2) * s[2] ** (e - e2) / (math.factorial(a - a2) * math.factorial(b - b2) * math.factorial(e - e2))
        r = (np.sqrt(((x - c) ** 2).sum(1)) + pdf["r"].to_numpy(float)).max()
        return pd.DataFrame([(int(pdf["level"].iloc[0]) - 1, int(pdf["key"].iloc[0]) >> 3, *c, int(n.sum()), r, total.tolist(), False)], columns=cols)

    kind = "level int, key long, cx double, cy double, cz double, n long, r double, m array<double>, leaf boolean"
    for level in range(deepest, 0, -1):
        up = cut(below.groupBy(F.shiftright("key", 3).alias("up")).applyInPandas(lift, kind))  # at most eight cells a group
        cells = cells.union(up)
        below = up.union(leaves.filter(F.col("level") == level - 1).select(*cols))
    cells = cut(cells)
    a_side = cells.select(*[F.col(c).alias(f"a_{c}") for c in ("level", "key", "cx", "cy", "cz", "r", "leaf")])
    b_side = cells.select(*[F.col(c).alias(f"b_{c}") for c in ("level", "key", "cx", "cy", "cz", "r", "leaf", "m")])
    b_plain = b_side.drop("b_m")
    pairs = cut(a_side.filter("a_level = 0").join(b_plain.filter("b_level = 0"), F.lit(True)))  # the root with itself
    far, near = [], []
    gap = F.sqrt(sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in ("cx", "cy", "cz")), F.lit(0.0)))
    while pairs.limit(1).count():
        accept = (F.col("a_r") + F.col("b_r")) < theta * gap
        both = F.col("a_leaf") & F.col("b_leaf")
        far.append(pairs.filter(accept))
        near.append(pairs.filter(~accept & both))
        rest = pairs.filter(~accept & ~both)
        split_a = ~F.col("a_leaf") & (F.col("b_leaf") | (F.col("a_r") >= F.col("b_r")))
        a_next = a_side.withColumn("up_level", F.col("a_level") - 1).withColumn("up", F.shiftright("a_key", 3))
        b_next = b_plain.withColumn("up_level", F.col("b_level") - 1).withColumn("up", F.shiftright("b_key", 3))
        ra = rest.filter(split_a)
        one = ra.select(*[c for c in ra.columns if c.startswith("b_")], F.col("a_level").alias("up_level"), F.col("a_key").alias("up")).join(a_next, ["up_level", "up"]).select(*pairs.columns)
        rb = rest.filter(~split_a)
        two = rb.select(*[c for c in rb.columns if c.startswith("a_")], F.col("b_level").alias("up_level"), F.col("b_key").alias("up")).join(b_next, ["up_level", "up"]).select(*pairs.columns)
        pairs = cut(one.union(two))
    union = lambda fs: fs[0] if len(fs) == 1 else fs[0].union(union(fs[1:]))
    far_, near_ = cut(union(far)), cut(union(near))
    # a far cell acts on all leaves below its partner
    widen = F.transform(F.sequence(F.lit(0), F.col("level")), lambda k: F.struct((F.col("level") - k).alias("a_level"), F.shiftrightunsigned(F.col("key"), 0).alias("key"), k.alias("k")))
    targets = tree.select("id", "x", "y", "z", "level", "key", F.explode(widen).alias("s")).select("id", "x", "y", "z", F.col("s.a_level").alias("a_level"), F.expr("shiftright(s.key, 3 * s.k)").alias("a_key"))
    acting = far_.select("a_level", "a_key", "b_level", "b_key").join(cells.select(F.col("level").alias("b_level"), F.col("key").alias("b_key"), "cx", "cy", "cz", "m"), ["b_level", "b_key"])
    rows = targets.join(acting, ["a_level", "a_key"]).select("id", "x", "y", "z", "cx", "cy", "cz", "m")

    def evaluate(batches):
        for b in batches:
            if not len(b):
                continue
            s = b[["x", "y", "z"]].to_numpy(float) - b[["cx", "cy", "cz"]].to_numpy(float)
            m = np.stack(b["m"].to_numpy())
            t = derivatives(s, order + 1)
            out = np.zeros((len(b), 4))
            for p, k in index.items():
                sign = (-1) ** sum(p)
                out[:, 0] += sign * m[:, k] * t[p]
                for axis in range(3):
                    up = tuple(p[i] + (i == axis) for i in range(3))
                    out[:, 1 + axis] += sign * m[:, k] * t[up]
            yield pd.DataFrame({"id": b["id"], "p": out[:, 0], "fx": out[:, 1], "fy": out[:, 2], "fz": out[:, 3]})

    close = near_.select(F.col("a_level").alias("level"), F.col("a_key").alias("key"), "b_level", "b_key").join(tree.select("id", "x", "y", "z", "level", "key"), ["level", "key"]).select("id", "x", "y", "z", "b_level", "b_key")
    close = close.join(tree.select(F.col("level").alias("b_level"), F.col("key").alias("b_key"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), "q"), ["b_level", "b_key"])
    dx = [F.col(c) - F.col(f"s{c}") for c in "xyz"]
    r2 = dx[0] ** 2 + dx[1] ** 2 + dx[2] ** 2
    some = close.filter(r2 > 0)
    inv = F.lit(1.0) / F.sqrt(r2)
    local = some.groupBy("id").agg(F.sum(F.col("q") * inv).alias("p"), *[F.sum(-F.col("q") * v * inv * inv * inv).alias(n) for v, n in zip(dx, ("fx", "fy", "fz"))])
    both = rows.mapInPandas(evaluate, OUT).unionByName(local)
    return both.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("p", "fx", "fy", "fz")])


def derivatives(s: np.ndarray, order: int) -> dict[tuple[int, int, int], np.ndarray]:
    """Partial derivatives of 1/r at s, up to the order, by the recurrence on r**2."""
    r2 = (s * s).sum(1)
    t = {(0, 0, 0): 1 / np.sqrt(r2)}
    for n in range(1, order + 1):
        for a in range(n + 1):
            for b in range(n + 1 - a):
                p = (a, b, n - a - b)
                total = np.zeros(len(s))
                for axis in range(3):
                    k = p[axis]
                    if k >= 1:
                        q = tuple(p[i] - (i == axis) for i in range(3))
                        total -= (2 * n - 1) / n * k * s[:, axis] * t[q]
                    if k >= 2:
                        q = tuple(p[i] - 2 * (i == axis) for i in range(3))
                        total -= (n - 1) / n * k * (k - 1) * t[q]
                t[p] = total / r2
    return t
