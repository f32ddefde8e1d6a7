"""Textbook algorithms: geometry, learning, numbers, flows. What is small by nature runs on the driver and says so."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import cut


def kmeans(points: DataFrame, k: int, rounds: int = 20, seed: int = 1) -> DataFrame:
    """(cluster, size, centre) after Lloyd's rounds from k-means++ centres drawn by a seeded hash; stops when no centre moves. The
    driver holds k centres; each task sends partial sums."""
    spark = points.sparkSession
    p = cut(points.select("id", "vec"))
    centres = np.asarray([p.orderBy(F.xxhash64("id", F.lit(seed)), "id").select("vec").first()[0]])
    random = np.random.default_rng(seed)

    def nearest(c):
        def f(batches):
            for b in batches:
                if len(b):
                    x = np.stack(b["vec"].to_numpy()).astype(float)
                    d = ((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T).clip(0)
                    yield pd.DataFrame({"id": b["id"], "vec": list(x), "c": d.argmin(1), "d": d.min(1)})

        return p.mapInPandas(f, "id long, vec array<double>, c int, d double")

    while len(centres) < k:
        key = -F.log(F.lit(1.0) - (F.pmod(F.xxhash64("id", F.lit(int(random.integers(1 << 30)))), F.lit(1 << 52)) + 0.5) / float(1 << 52)) / F.col("d")
        row = nearest(centres).filter("d > 0").orderBy(key, "id").select("vec").first()
        if row is None:
            break
        centres = np.concatenate([centres, [row[0]]])
    for _ in range(rounds):
        dim = centres.shape[1]
        sums = nearest(centres).groupBy("c").agg(F.count("*").alias("n"), *[F.sum(F.col("vec")[i]).alias(f"s{i}") for i in range(dim)]).collect()
        new = centres.copy()
        for r in sums:
            new[r["c"]] = [r[f"s{i}"] / r["n"] for i in range(dim)]
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    size = nearest(centres).groupBy(F.col("c").alias("cluster")).agg(F.count("*").alias("size"))
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>")
    return named.join(size, "cluster", "left").select("cluster", F.coalesce("size", F.lit(0).cast("long")).alias("size"), "centre")


def lasso(rows: DataFrame, features: list[str], label: str, strength: float, rounds: int = 200) -> dict[str, float]:
    """Coefficients that minimise the mean squared error / 2 plus strength times the sum of their sizes, by coordinate descent on the
    Gram matrix: one aggregation over the rows, the rest is as small as the features squared."""
    cols = [*features, label]
    aggs = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    r = rows.agg(F.count("*").alias("n"), *aggs).first()
    n, m = r["n"], len(features)
    if not n:
        return dict.fromkeys(features, 0.0)
    g = np.array([[r[f"{min(i, j)}_{max(i, j)}"] / n for j in range(m + 1)] for i in range(m + 1)])
    w = np.zeros(m)
    for _ in range(rounds):
        for j in range(m):
            if g[j, j] > 0:
                rho = g[j, m] - g[j, :m] @ w + g[j, j] * w[j]
                w[j] = math.copysign(max(abs(rho) - strength, 0), rho) / g[j, j]
    return dict(zip(features, w.tolist()))


def decision_tree(rows: DataFrame, features: list[str], label: str, depth: int = 3, cuts: int = 32) -> list[dict]:
    """A C4.5 tree on numeric features as a list of nodes: the split of greatest gain ratio among quantile cuts, a level at a time; one
    aggregation a level counts labels on both sides of every cut."""
    bounds = {f: sorted(set(q)) for f, q in zip(features, rows.approxQuantile(features, [i / cuts for i in range(1, cuts)], 0.001))}
    data = cut(rows.select(*features, F.col(label).alias("y")).withColumn("node", F.lit(1)))
    nodes: list[dict] = []

    def entropy(c: dict) -> float:
        t = sum(c.values())
        return -sum(v / t * math.log2(v / t) for v in c.values() if v) if t else 0.0

    for level in range(depth + 1):
        total: dict[int, dict] = {}
        for r in data.groupBy("node", "y").agg(F.count("*").alias("n")).collect():
            total.setdefault(r["node"], {})[r["y"]] = r["n"]
        below: dict = {}
        options = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(float(b)).alias("b"), (F.col(f) <= F.lit(float(b))).alias("low")) for f in features for b in bounds[f]])
        if level < depth:
            for r in data.select("node", "y", F.explode(options).alias("o")).filter("o.low").groupBy("node", "y", "o.f", "o.b").agg(F.count("*").alias("n")).collect():
                below.setdefault((r["node"], r["f"], r["b"]), {})[r["y"]] = r["n"]
        move = F.lit(None).cast("int")
        for node, c in sorted(total.items()):
            best = None
            for (at, f, b), low in below.items():
                if at != node:
                    continue
                high = {y: c[y] - low.get(y, 0) for y in c}
                n, nl = sum(c.values()), sum(low.values())
                if 0 < nl < n:
                    gain = entropy(c) - nl / n * entropy(low) - (n - nl) / n * entropy(high)
                    ratio = gain / entropy({0: nl, 1: n - nl})
                    if gain > 1e-12 and (best is None or (ratio, f, -b) > best[0]):
                        best = ((ratio, f, -b), f, b)
            nodes.append({"node": node, "label": max(c, key=lambda y: (c[y], str(y))), "rows": sum(c.values()), "feature": best and best[1], "cut": best and best[2]})
            if best:
                move = F.when(F.col("node") == node, F.when(F.col(best[1]) <= best[2], 2 * node).otherwise(2 * node + 1)).otherwise(move)
        data = cut(data.withColumn("node", move).filter("node is not null"))
    return nodes


def upper_hull(points: DataFrame) -> DataFrame:
    """(id, x, y) of the corners of the upper hull, strict turns: tasks send their own hulls, whose hull is the answer."""

    def hull(rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for p in sorted(set(rows), key=lambda r: (r[1], -r[2], r[0])):
            if out and out[-1][1] == p[1]:
                continue
            while len(out) > 1 and (out[-1][1] - out[-2][1]) * (p[2] - out[-2][2]) - (out[-1][2] - out[-2][2]) * (p[1] - out[-2][1]) >= 0:
                out.pop()
            out.append(p)
        return out

    def f(batches):
        held: list[tuple] = []
        for b in batches:
            held = hull([*held, *b.itertuples(index=False, name=None)])
        yield pd.DataFrame(held, columns=["id", "x", "y"])

    kind = "id long, x double, y double"
    own = points.select("id", "x", "y").mapInPandas(f, kind)
    return own.coalesce(1).mapInPandas(f, kind)


def rectangle_overlaps(boxes: DataFrame, cell: float) -> DataFrame:
    """(a, b), a < b, of boxes (id, x1, y1, x2, y2) whose open insides meet. A box goes to all grid cells it touches; a pair counts in
    the cell of its common corner only."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor(F.col(hi) / cell).cast("long"))
    cells = boxes.withColumn("i", F.explode(span("x1", "x2"))).withColumn("j", F.explode(span("y1", "y2")))
    a, b = [cells.select("i", "j", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "x1", "y1", "x2", "y2")]) for s in "ab"]
    j = a.join(b, ["i", "j"]).filter("a_id < b_id and a_x1 < b_x2 and b_x1 < a_x2 and a_y1 < b_y2 and b_y1 < a_y2")
    home = (F.floor(F.greatest("a_x1", "b_x1") / cell) == F.col("i")) & (F.floor(F.greatest("a_y1", "b_y1") / cell) == F.col("j"))
    return j.filter(home).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def first_hits(rays: DataFrame, triangles: DataFrame) -> DataFrame:
    """(ray, triangle, t): the first triangle (id, ax .. cz) that each ray (id, ox .. dz) meets. Triangles go to the rays' tasks in
    blocks of bounded size."""
    parts, held = [], []
    names = [f"{p}{c}" for p in "abc" for c in "xyz"]

    def add(rows):
        shared = rays.sparkSession.sparkContext.broadcast((np.asarray([r[0] for r in rows]), np.asarray([r[1:] for r in rows], float)))

        def f(batches, s=shared):
            ids, t = s.value
            a, e1, e2 = t[:, :3], t[:, 3:6] - t[:, :3], t[:, 6:] - t[:, :3]
            for b in batches:
                for i, o, d in zip(b["id"], b[["ox", "oy", "oz"]].to_numpy(float), b[["dx", "dy", "dz"]].to_numpy(float)):
                    p = np.cross(d, e2)
                    det = (e1 * p).sum(1)
                    inv = np.where(det != 0, 1 / np.where(det != 0, det, 1), 0)
                    u = ((o - a) * p).sum(1) * inv
                    q = np.cross(o - a, e1)
                    v, w = (q @ d) * inv, (e2 * q).sum(1) * inv
                    ok = (det != 0) & (u >= 0) & (v >= 0) & (u + v <= 1) & (w > 1e-9)
                    if ok.any():
                        at = np.flatnonzero(ok)
                        at = at[np.lexsort((ids[at], w[at]))[0]]
                        yield pd.DataFrame({"ray": [i], "triangle": [ids[at]], "t": [w[at]]})

        parts.append(rays.mapInPandas(f, "ray long, triangle long, t double"))

    for r in triangles.select("id", *names).toLocalIterator():
        held.append(tuple(r))
        if len(held) == 4096:
            add(held)
            held = []
    add(held or [(0, *[0.0] * 9)])
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("ray").agg(F.min(F.struct("t", "triangle")).alias("m")).select("ray", "m.triangle", "m.t")


def linear_program_2d(constraints: list[tuple[float, float, float]], objective: tuple[float, float], bound: float = 1e6) -> tuple[float, float] | None:
    """The point of greatest objective with a x + b y <= c for all, within +-bound; None if there is none. Driver-side, incremental."""
    lines = [(1, 0, bound), (-1, 0, bound), (0, 1, bound), (0, -1, bound)]
    x = (math.copysign(bound, objective[0]), math.copysign(bound, objective[1]))
    for a, b, c in constraints:
        if a * x[0] + b * x[1] > c + 1e-12:
            n = a * a + b * b
            p, d = (a * c / n, b * c / n), (-b, a)
            lo, hi = -math.inf, math.inf
            for e, f, g in lines:
                den, num = e * d[0] + f * d[1], g - e * p[0] - f * p[1]
                if abs(den) < 1e-15:
                    if num < -1e-9:
                        return None
                elif den > 0:
                    hi = min(hi, num / den)
                else:
                    lo = max(lo, num / den)
            if lo > hi + 1e-9:
                return None
            t = hi if objective[0] * d[0] + objective[1] * d[1] > 0 else lo
            x = (p[0] + t * d[0], p[1] + t * d[1])
        lines.append((a, b, c))
    return x


def max_flow(edges: DataFrame, source: int, sink: int) -> int:
    """The value of a greatest flow over (src, dst, w), whole w. Driver-side, by shortest augmenting paths: for graphs that fit it."""
    left: dict[int, dict[int, int]] = {}
    for r in edges.select("src", "dst", "w").toLocalIterator():
        left.setdefault(r[0], {})[r[1]] = left.get(r[0], {}).get(r[1], 0) + int(r[2])
        left.setdefault(r[1], {}).setdefault(r[0], 0)
    total = 0
    while True:
        back, queue = {source: source}, deque([source])
        while queue and sink not in back:
            u = queue.popleft()
            for v, c in left.get(u, {}).items():
                if c > 0 and v not in back:
                    back[v] = u
                    queue.append(v)
        if sink not in back:
            return total
        path, v = [], sink
        while v != source:
            path.append((back[v], v))
            v = back[v]
        flow = min(left[a][b] for a, b in path)
        for a, b in path:
            left[a][b] -= flow
            left[b][a] += flow
        total += flow


def big_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """(idx, digit): the sum of two numbers of (idx, digit) rows, lowest digit first, base 2**32. A carry passes a digit only where
    the sum is all ones, so it is the last generated one before: a running maximum tells."""
    from .sequence import scan_max

    base = 1 << 32
    j = a.join(b.select("idx", F.col("digit").alias("other")), "idx", "full").select("idx", (F.coalesce("digit", F.lit(0)) + F.coalesce("other", F.lit(0))).alias("s"))
    n = j.agg(F.max("idx")).first()[0]
    j = cut(j.union(j.sparkSession.createDataFrame([(n + 1, 0)], "idx long, s long")))
    event = F.when(F.col("s") >= base, F.col("idx") * 2 + 1).when(F.col("s") == base - 1, F.lit(-1)).otherwise(F.col("idx") * 2)
    last = scan_max(j.select((F.col("idx") + 1).alias("idx"), event.alias("value"))).select("idx", (F.col("scan") % 2 == 1).alias("carry"))
    out = j.join(last, "idx", "left").select("idx", F.pmod(F.col("s") + F.coalesce(F.col("carry"), F.lit(False)).cast("long"), F.lit(base)).alias("digit"))
    top = out.filter("digit <> 0").agg(F.max("idx")).first()[0] or 0
    return out.filter(F.col("idx") <= top)


def karatsuba(x: int, y: int, least: int = 1 << 64) -> int:
    """The product of whole numbers, by three products of halves. Driver-side."""
    if abs(x) < least or abs(y) < least:
        return x * y
    n = max(x.bit_length(), y.bit_length()) // 2
    (a, b), (c, d) = divmod(x, 1 << n), divmod(y, 1 << n)
    high, low = karatsuba(a, c, least), karatsuba(b, d, least)
    return (high << 2 * n) + ((karatsuba(a + b, c + d, least) - high - low) << n) + low


def fourier(seq: DataFrame) -> DataFrame:
    """(key, idx, re, im): the discrete Fourier transform of the values of each key in order of idx; a key's values fit a task."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.fft.fft(pdf.sort_values("idx")["value"].to_numpy(float))
        return pd.DataFrame({"key": pdf["key"].iloc[0], "idx": np.arange(len(out)), "re": out.real, "im": out.imag})

    return seq.groupBy("key").applyInPandas(f, "key long, idx long, re double, im double")
