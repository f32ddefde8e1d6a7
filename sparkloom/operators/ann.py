"""Vector search over points (id, vec): exact, and by hyperplanes, cluster trees and navigable graphs.

Graph indexes are built for each partition of the points ("shard"): a search asks every shard and merges, so building is parallel
and needs no shared memory, and a lost shard is rebuilt alone. Queries are collected in blocks of a bounded size."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distances

#: Queries that go to every task at a time, and rows of a shard.
BLOCK, SHARD = 4096, 50_000
NEAR = "qid long, id long, distance double"


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, vecs = [], []
    for r in queries.select("id", "vec").toLocalIterator():
        ids.append(r[0])
        vecs.append(r[1])
        if len(ids) == BLOCK:
            yield np.asarray(ids), np.asarray(vecs, float)
            ids, vecs = [], []
    if ids:
        yield np.asarray(ids), np.asarray(vecs, float)


def _merge(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _ask(points: DataFrame, queries: DataFrame, answer: Callable) -> DataFrame:
    """answer(query ids, query vectors, batches of pandas (id, vec)) for each block of queries over all partitions."""
    parts = []
    for ids, vecs in _blocks(queries):
        shared = points.sparkSession.sparkContext.broadcast((ids, vecs))
        parts.append(points.select("id", "vec").mapInPandas(lambda it, s=shared: answer(*s.value, it), NEAR))
    out = parts[0] if parts else points.sparkSession.createDataFrame([], NEAR)
    for p in parts[1:]:
        out = out.union(p)
    return out


def exact_knn(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False) -> DataFrame:
    """(qid, id, distance, rank): the k nearest of each query, ties by id. Each batch keeps k for each query."""

    def answer(qids, qvecs, batches):
        for b in batches:
            if not len(b):
                continue
            d = distances(qvecs, np.stack(b["vec"].to_numpy()).astype(float), metric)
            ids = b["id"].to_numpy()
            if exclude_self:
                d[qids[:, None] == ids[None]] = np.inf
            for i in range(len(qids)):
                at = np.lexsort((ids, d[i]))[:k]
                at = at[np.isfinite(d[i][at])]
                yield pd.DataFrame({"qid": qids[i], "id": ids[at], "distance": d[i][at]})

    return _merge(_ask(points, queries, answer), k)


def range_search(points: DataFrame, queries: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """(qid, id, distance) of all points at distance at most radius."""

    def answer(qids, qvecs, batches):
        for b in batches:
            if len(b):
                d = distances(qvecs, np.stack(b["vec"].to_numpy()).astype(float), metric)
                i, j = np.nonzero(d <= radius)
                yield pd.DataFrame({"qid": qids[i], "id": b["id"].to_numpy()[j], "distance": d[i, j]})

    return _ask(points, queries, answer)


def lsh_search(points: DataFrame, queries: DataFrame, k: int, tables: int = 20, bits: int = 6, seed: int = 1) -> DataFrame:
    """(qid, id, distance, rank) among the points that share the signature of a query in a table: signs of products with seeded
    Gaussian hyperplanes. Signatures join by hash; only candidates' vectors travel."""
    first = points.select("vec").first()
    dim = len(first[0]) if first else 1
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim))

    def sign(batches):
        for b in batches:
            if len(b):
                s = (np.einsum("nd,tbd->ntb", np.stack(b["vec"].to_numpy()).astype(float), planes) > 0) @ (1 << np.arange(bits))
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), tables), "t": np.tile(np.arange(tables), len(b)), "sig": s.ravel()})

    p = points.select("id", "vec").mapInPandas(sign, "id long, t int, sig long")
    q = queries.select("id", "vec").mapInPandas(sign, "id long, t int, sig long").withColumnRenamed("id", "qid")
    pairs = p.join(q, ["t", "sig"]).select("qid", "id").distinct()
    from ..functions.vectors import squared_l2

    with_vecs = pairs.join(points.select("id", F.col("vec").alias("a")), "id").join(queries.select(F.col("id").alias("qid"), F.col("vec").alias("b")), "qid")
    return _merge(with_vecs.select("qid", "id", squared_l2(F.col("a"), F.col("b")).alias("distance")), k)


# graphs of one shard, in numpy


def beam_search(vecs: np.ndarray, graph: list, query: np.ndarray, starts: list[int], beam: int, metric: str = "l2", limit: int | None = None, cut_: float | None = None, k: int = 10):
    """(frontier, visited): lists of (distance, place), by distance. Expands the nearest unvisited of the `beam` best; stops after
    `limit` visits; with cut_, keeps those within cut_ times the k-th distance."""
    d = distances(query[None], vecs[starts], metric)[0]
    seen = set(starts)
    front = sorted(zip(d.tolist(), starts))[:beam]
    visited: list[tuple[float, int]] = []
    done: set[int] = set()
    while limit is None or len(visited) < limit:
        now = next((x for x in front if x[1] not in done), None)
        if now is None:
            break
        done.add(now[1])
        visited.append(now)
        new = [j for j in graph[now[1]] if j not in seen]
        seen.update(new)
        if new:
            front = heapq.nsmallest(beam, [*front, *zip(distances(query[None], vecs[new], metric)[0].tolist(), new)])
            if cut_ is not None and len(front) > k:
                front = [x for x in front if x[0] <= cut_ * front[k - 1][0]]
    return front, sorted(visited)


def robust_prune(vecs: np.ndarray, p: int, candidates: list[int], degree: int, alpha: float, metric: str = "l2") -> list[int]:
    """Neighbours of p: the nearest candidate, then without those that alpha times are nearer to it than to p, and so on."""
    c = np.asarray(sorted(set(candidates) - {p}), int)
    if not len(c):
        return []
    d = distances(vecs[p][None], vecs[c], metric)[0]
    order = np.lexsort((c, d))
    c, d = c[order], d[order]
    out: list[int] = []
    alive = np.ones(len(c), bool)
    for i in range(len(c)):
        if alive[i]:
            out.append(int(c[i]))
            if len(out) == degree:
                break
            alive &= alpha * distances(vecs[c[i]][None], vecs[c], metric)[0] > d
            alive[: i + 1] = False
    return out


def build_vamana(vecs: np.ndarray, degree: int = 24, beam: int = 48, alpha: float = 1.2, passes: int = 1, metric: str = "l2") -> tuple[list, int]:
    """(graph, medoid): points are inserted one by one, each linked to the pruned points that a search for it visits."""
    n = len(vecs)
    medoid = int(distances(vecs.mean(0)[None], vecs, metric)[0].argmin()) if n else 0
    graph: list[list[int]] = [[] for _ in range(n)]
    for turn in range(passes):
        a = alpha if turn == passes - 1 else 1.0
        for p in range(n):
            if p == medoid and turn == 0:
                continue
            _, visited = beam_search(vecs, graph, vecs[p], [medoid], beam, metric)
            graph[p] = robust_prune(vecs, p, [j for _, j in visited] + graph[p], degree, a, metric)
            for j in graph[p]:
                if p not in graph[j]:
                    graph[j] = graph[j] + [p] if len(graph[j]) < degree else robust_prune(vecs, j, graph[j] + [p], degree, a, metric)
    return graph, medoid


def delete_points(vecs: np.ndarray, graph: list, medoid: int, gone: set[int], degree: int, alpha: float = 1.2) -> list:
    """The graph without `gone` (the medoid stays): neighbours of deleted neighbours become candidates."""
    gone = gone - {medoid}
    out = []
    for p, near in enumerate(graph):
        if p in gone:
            out.append([])
        elif gone & set(near):
            out.append(robust_prune(vecs, p, [j for j in near if j not in gone] + [h for j in near if j in gone for h in graph[j] if h not in gone], degree, alpha))
        else:
            out.append(near)
    return out


def build_hcnng(vecs: np.ndarray, trees: int = 8, leaf: int = 60, degree: int = 3, near: int = 10, seed: int = 1) -> tuple[list, int]:
    """(graph, start): the union over random cluster trees of degree-bounded spanning trees of the leaves' nearest-neighbour edges."""
    random = np.random.default_rng(seed)
    links: list[set[int]] = [set() for _ in range(len(vecs))]

    def leaf_edges(at: np.ndarray) -> None:
        d = distances(vecs[at], vecs[at])
        np.fill_diagonal(d, np.inf)
        m = min(near, len(at) - 1)
        edges = sorted({(float(d[i, j]), min(i, int(j)), max(i, int(j))) for i in range(len(at)) for j in np.argsort(d[i], kind="stable")[:m]})
        root, used = list(range(len(at))), [0] * len(at)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for _, i, j in edges:
            if used[i] < degree and used[j] < degree and find(i) != find(j):
                root[find(i)] = find(j)
                used[i] += 1
                used[j] += 1
                links[at[i]].add(int(at[j]))
                links[at[j]].add(int(at[i]))

    def split(at: np.ndarray) -> None:
        stack = [at]
        while stack:
            at = stack.pop()
            if len(at) <= max(leaf, near + 1):
                if len(at) > 1:
                    leaf_edges(at)
                continue
            a, b = vecs[random.choice(at, 2, replace=False)]
            left = distances(a[None], vecs[at])[0] <= distances(b[None], vecs[at])[0]
            if left.all() or not left.any():
                left = np.arange(len(at)) < len(at) // 2
            stack += [at[left], at[~left]]

    for _ in range(trees):
        split(np.arange(len(vecs)))
    return [sorted(s) for s in links], 0


def build_nn_descent(vecs: np.ndarray, k: int = 16, delta: float = 0.001, alpha: float = 1.2, seed: int = 1) -> tuple[list, int]:
    """(graph, start): neighbours of neighbours are tried until less than delta of the edges change, then both directions, pruned."""
    n = len(vecs)
    if n < 2:
        return [[] for _ in range(n)], 0
    k = min(k, n - 1)
    random = np.random.default_rng(seed)
    near = np.stack([np.setdiff1d(random.choice(n, min(n, k + 1), replace=False), [i])[:k] for i in range(n)])
    for _ in range(max(10, int(np.log2(n)))):
        back: list[list[int]] = [[] for _ in range(n)]
        for i in range(n):
            for j in near[i]:
                if len(back[j]) < k:
                    back[j].append(i)
        new = near.copy()
        for i in range(n):
            about = np.unique(np.concatenate([near[i], back[i]]).astype(int))
            c = np.setdiff1d(np.unique(np.concatenate([near[about].ravel(), about])), [i])
            d = distances(vecs[i][None], vecs[c])[0]
            new[i] = c[np.lexsort((c, d))[:k]]
        changed = sum(len(np.setdiff1d(new[i], near[i])) for i in range(n))
        near = new
        if changed < delta * n * k:
            break
    both: list[set[int]] = [set(map(int, x)) for x in near]
    for i in range(n):
        for j in near[i]:
            both[j].add(i)
    return [robust_prune(vecs, i, list(s), 2 * k, alpha) for i, s in enumerate(both)], 0


def build_hnsw(vecs: np.ndarray, m: int = 12, ef: int = 48, level_scale: float = 0.36, alpha: float = 1.0, metric: str = "l2", seed: int = 1) -> tuple[list, int]:
    """(layers, entry): layers[l][i] are the neighbours of i in layer l; a point's level is floor(-ln U * level_scale)."""
    n = len(vecs)
    u = np.random.default_rng(seed).random(n)
    levels = np.floor(-np.log(1 - u) * level_scale).astype(int) if n else np.zeros(0, int)
    layers: list[list[list[int]]] = [[[] for _ in range(n)] for _ in range(int(levels.max()) + 1 if n else 1)]
    entry = 0
    for p in range(1, n):
        at = [entry]
        for layer in range(int(levels[entry]), -1, -1):
            wide = layer <= levels[p]
            front, _ = beam_search(vecs, layers[layer], vecs[p], at, ef if wide else 1, metric)
            if wide:
                most = 2 * m if layer == 0 else m
                chosen = robust_prune(vecs, p, [j for _, j in front], m, alpha, metric)
                layers[layer][p] = chosen
                for j in chosen:
                    own = layers[layer][j] + [p]
                    layers[layer][j] = own if len(own) <= most else robust_prune(vecs, j, own, most, alpha, metric)
            at = [j for _, j in front]
        if levels[p] > levels[entry]:
            entry = p
    return layers, entry


def search_hnsw(vecs: np.ndarray, layers: list, entry: int, query: np.ndarray, ef: int, metric: str = "l2"):
    at = [entry]
    for layer in range(len(layers) - 1, 0, -1):
        at = [j for _, j in beam_search(vecs, layers[layer], query, at, 1, metric)[0]]
    return beam_search(vecs, layers[0], query, at, ef, metric)[0]


BUILDERS: dict[str, Callable] = {"vamana": build_vamana, "hcnng": build_hcnng, "nn_descent": build_nn_descent, "hnsw": build_hnsw}


def _shards(batches, most: int = SHARD):
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= most:
            yield pd.concat(held)
            held, n = [], 0
    if n:
        yield pd.concat(held)


def graph_search(points: DataFrame, queries: DataFrame, k: int, method: str, beam: int = 64, metric: str = "l2", radius: float | None = None, **options) -> DataFrame:
    """(qid, id, distance, rank): each shard builds its graph by `method` (vamana, hcnng, nn_descent, hnsw) and is searched; with
    radius, every visited point within it instead of the k nearest."""
    build = BUILDERS[method]

    def answer(qids, qvecs, batches):
        for shard in _shards(batches):
            shard = shard.sort_values("id")
            ids, vecs = shard["id"].to_numpy(), np.stack(shard["vec"].to_numpy()).astype(float)
            graph, start = build(vecs, **options)
            starts = np.unique(np.concatenate([[start], np.random.default_rng(42).integers(0, len(vecs), 4)])).tolist()
            for qid, v in zip(qids, qvecs):
                if method == "hnsw":
                    front = search_hnsw(vecs, graph, start, v, beam, metric)
                else:
                    front, visited = beam_search(vecs, graph, v, starts, beam, metric)
                    front = [x for x in visited if x[0] <= radius] if radius is not None else front
                best = front if radius is not None else front[:k]
                yield pd.DataFrame({"qid": qid, "id": ids[[j for _, j in best]], "distance": [d for d, _ in best]})

    found = _ask(points, queries, answer)
    return found if radius is not None else _merge(found, k)


def graph_edges(points: DataFrame, method: str, **options) -> DataFrame:
    """(id, nbr, pos): the index graph as rows, to be written as Parquet; for hnsw its lowest layer."""
    build = BUILDERS[method]

    def f(batches):
        for shard in _shards(batches):
            shard = shard.sort_values("id")
            ids = shard["id"].to_numpy()
            graph, _ = build(np.stack(shard["vec"].to_numpy()).astype(float), **options)
            graph = graph[0] if method == "hnsw" else graph
            yield pd.DataFrame([(ids[i], ids[j], n) for i, near in enumerate(graph) for n, j in enumerate(near)], columns=["id", "nbr", "pos"])

    return points.select("id", "vec").mapInPandas(f, "id long, nbr long, pos int")


def recall(found: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """One row: the share of the r nearest that were found; points that tie with the r-th count as found, at most r a query."""
    edge = truth.filter(F.col("rank") == r).select("qid", F.col("distance").alias("edge"))
    near = truth.join(edge, "qid").filter("distance <= edge").select("qid", "id")
    hits = found.filter(F.col("rank") <= r).join(near, ["qid", "id"]).groupBy("qid").agg(F.least(F.count("*"), F.lit(r)).alias("n"))
    return edge.join(hits, "qid", "left").agg((F.sum(F.coalesce("n", F.lit(0))) / (F.count("*") * r)).alias("recall"))


def range_recall(found: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: queries with and without results, and the share of true pairs found."""
    t = truth.groupBy("qid").agg(F.count("*").alias("t"))
    n = found.groupBy("qid").agg(F.count("*").alias("f"))
    j = queries.select(F.col("id").alias("qid")).join(t, "qid", "left").join(n, "qid", "left")
    return j.agg(F.count("t").alias("nonzero"), F.count(F.when(F.col("t").isNull(), 1)).alias("zero"), (F.sum(F.coalesce("f", F.lit(0))) / F.sum("t")).alias("recall"))


def sweep(points: DataFrame, queries: DataFrame, truth: DataFrame, method: str, beams: list[int], r: int = 10) -> DataFrame:
    """(beam, recall) for each width."""
    rows = [(b, float(recall(graph_search(points, queries, r, method, b), truth, r).first()[0])) for b in beams]
    return points.sparkSession.createDataFrame(rows, "beam int, recall double")


def best_by_bucket(results: DataFrame, edges: list[float]) -> DataFrame:
    """(low, high, qps): the greatest qps of (recall, qps) rows in each recall bucket."""
    buckets = results.sparkSession.createDataFrame(list(zip(edges, edges[1:])), "low double, high double")
    j = results.join(F.broadcast(buckets), (F.col("recall") >= F.col("low")) & (F.col("recall") <= F.col("high")))
    return j.groupBy("low", "high").agg(F.max("qps").alias("qps"))


def degree_statistics(edges: DataFrame) -> DataFrame:
    """One row of (id, nbr) edges: average and greatest degree."""
    return edges.groupBy("id").agg(F.count("*").alias("d")).agg(F.avg("d").alias("average"), F.max("d").alias("most"))


def knn_graph(points: DataFrame, k: int) -> DataFrame:
    """(id, nbr, distance, rank): the exact k nearest other points of every point, block by block of queries."""
    near = exact_knn(points, points, k, exclude_self=True)
    return near.select(F.col("qid").alias("id"), F.col("id").alias("nbr"), "distance", "rank")


def pairs_within(points: DataFrame, radius: float, dims: list[str]) -> DataFrame:
    """(a, b), a < b, of points (id and numeric dims) nearer than radius: each point goes to its grid cell and, as a query, to that
    cell and one of each two opposite ones around, so only near pairs meet, and once.

    Cells are a trifle wider than radius, so rounding parts no pair. The join is never broadcast: sizes foretold from files know
    nothing of the copies, and millions of rows would pass through the driver."""
    cell = [F.floor(F.col(d) / (radius * (1 + 1e-9))).cast("long") for d in dims]
    names = [f"cell_{d}" for d in dims]
    half = [s for s in itertools.product((-1, 0, 1), repeat=len(dims)) if s >= (0,) * len(dims)]
    around = F.explode(F.array(*[F.struct(*[(c + F.lit(x)).alias(n) for c, x, n in zip(cell, s, names)], F.lit(any(s)).alias("other")) for s in half]))
    left = points.select(F.col("id").alias("i"), *[F.col(d).alias(f"a_{d}") for d in dims], *[c.alias(n) for c, n in zip(cell, names)])
    right = points.select(F.col("id").alias("j"), *[F.col(d).alias(f"b_{d}") for d in dims], around.alias("at")).select("j", *[f"b_{d}" for d in dims], "at.*")
    apart = sum(((F.col(f"a_{d}") - F.col(f"b_{d}")) ** 2 for d in dims), F.lit(0.0))
    met = right.join(left.hint("merge"), names).filter((F.col("other") & (F.col("i") != F.col("j"))) | (F.col("i") < F.col("j"))).filter(apart < radius * radius)
    return met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
