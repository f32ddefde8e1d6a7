"""Graph operators on small graphs with known results."""

import itertools
import random

import pytest

from sparkloom.operators import clustering, components, covering, graph, ranking, substructure, traversal

G1 = [(0, 1), (2, 3), (3, 4), (3, 5), (4, 5), (5, 6)]
G2 = [*itertools.combinations(range(5), 2), (5, 6), (5, 7), (6, 7), (6, 9), (7, 8), (7, 9), (8, 9), (8, 10)]
G3 = [(0, 1), (1, 2), (1, 3), (2, 3), (2, 4), (2, 5), (3, 4)]
G4 = [(0, 1), (3, 4), (4, 5)]
G5 = [(0, 1), (1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 6), (5, 7), (6, 7), (7, 8)]
G6 = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 7), (4, 5), (4, 6), (5, 6), (7, 8), (7, 9), (8, 9)]


@pytest.fixture(scope="module")
def make(spark):
    def f(edges, n):
        e = spark.createDataFrame(edges, "src long, dst long") if edges else spark.createDataFrame([], "src long, dst long")
        return spark.range(n), graph.from_edges(e, symmetric=True)

    return f


def column(df, key="id"):
    rows = df.collect()
    value = next(c for c in df.columns if c != key)
    return {r[key]: r[value] for r in rows}


def test_edgeless(make):
    g = make([], 3)
    assert column(traversal.bfs_levels(*g, 1)) == {0: None, 1: 0, 2: None}
    assert column(components.connected_components(*g)) == {0: 0, 1: 1, 2: 2}
    assert column(substructure.core_numbers(*g).select("id", "core")) == {0: 0, 1: 0, 2: 0}
    assert all(column(covering.independent_set(*g)).values())
    assert covering.maximal_matching(g[1]).count() == 0
    assert substructure.cliques(*make([], 10), 4).count() == 0


def test_two_components(make):
    g = make(G1, 7)
    parents = {r.id: r.parent for r in traversal.bfs_parents(*g, 2).collect()}
    assert parents == {0: None, 1: None, 2: 2, 3: 2, 4: 3, 5: 3, 6: 5}
    assert column(components.connected_components(*g)) == {0: 0, 1: 0, **dict.fromkeys(range(2, 7), 2)}
    assert column(components.label_propagation_components(*g)) == column(components.connected_components(*g))
    h = make(G1, 8)
    assert column(substructure.core_numbers(*h).select("id", "core")) == dict(enumerate([1, 1, 1, 2, 2, 2, 1, 0]))
    chosen = {i for i, c in column(covering.independent_set(*h)).items() if c}
    assert chosen == {0, 2, 4, 6, 7}
    used = [x for r in covering.maximal_matching(g[1]).collect() for x in (r.src, r.dst)]
    assert len(used) == len(set(used)) and all(a in used or b in used for a, b in G1)
    assert components.spanning_forest(*g).count() == 5
    dense = substructure.densest_charikar(*g)
    assert dense >= 2.0


def test_cliques_and_cycles(make):
    g = make(G2, 11)
    assert substructure.triangles(*g).count() == 13
    assert substructure.cliques(*g, 4).count() == 5
    assert substructure.cliques(*g, 5).count() == 1
    adj = {i: set() for i in range(11)}
    for a, b in G2:
        adj[a].add(b)
        adj[b].add(a)
    n = sum(1 for p in itertools.permutations(range(11), 5) if all(p[(i + 1) % 5] in adj[p[i]] for i in range(5)))
    assert substructure.five_cycles(*g) == n // 10
    assert sum(column(substructure.clique_counts(*g, 3)).values()) == 39
    core = column(substructure.clique_core_numbers(*g, 3))
    assert core[0] == 6 and core[10] == 0
    assert substructure.clique_peeling_density(*g, 3) >= 10 / 5 * 0.9
    for order in (substructure.degeneracy_order, substructure.goodrich_pszona_order, substructure.barenboim_elkin_order):
        assert sorted(column(order(*g)).values()) == list(range(11))


@pytest.mark.parametrize("mu,eps,groups", [(2, 0.5, [{0, 1, 2, 3, 4, 5}]), (2, 0.7, [{0, 1, 2, 3, 4}]), (2, 0.73, [{1, 2, 3, 4}]), (2, 0.88, [{2, 3}]), (2, 0.95, []), (4, 0.7, [{1, 2, 3, 4}])])
def test_scan(make, mu, eps, groups):
    v, e = make(G3, 6)
    s = clustering.similarities(v, e)
    got = {}
    c = clustering.scan_clusters(v, s, mu, eps)
    for i, k in column(c).items():
        if k is not None:
            got.setdefault(k, set()).add(i)
    assert sorted(got.values(), key=min) == groups
    inside = set().union(*groups) if groups else set()
    assert {r.id for r in clustering.hubs_and_outliers(e, c).collect()} == set(range(6)) - inside


def test_scan_measures(make):
    v, e = make(G3, 6)
    cosine = {(r.src, r.dst): r.similarity for r in clustering.similarities(v, e).collect()}
    jaccard = {(r.src, r.dst): r.similarity for r in clustering.similarities(v, e, "jaccard").collect()}
    want = {(0, 1): (2 / 8**0.5, 0.5), (1, 2): (3 / 20**0.5, 0.5), (1, 3): (3 / 16**0.5, 0.6), (2, 3): (4 / 20**0.5, 0.8), (2, 4): (3 / 15**0.5, 0.6), (2, 5): (2 / 10**0.5, 0.4), (3, 4): (3 / 12**0.5, 0.75)}
    for k, (c, j) in want.items():
        assert cosine[k] == pytest.approx(c) and jaccard[k] == pytest.approx(j)
    rough = {(r.src, r.dst): r.similarity for r in clustering.approximate_similarities(v, e, samples=400).collect()}
    assert all(abs(rough[k] - j) < 0.12 for k, (_, j) in want.items())
    v5, e5 = make(G5, 9)
    m = {}
    for r in clustering.scan_memberships(v5, clustering.similarities(v5, e5), 4, 0.5).collect():
        m.setdefault(r.cluster, set()).add(r.id)
    assert sorted(m.values(), key=min) == [{0, 1, 2, 3, 4}, {4, 5, 6, 7, 8}]
    v4, e4 = make(G4, 6)
    assert {i for i, k in column(clustering.scan_clusters(v4, clustering.similarities(v4, e4), 3, 0.8)).items() if k is not None} == {3, 4, 5}


def test_modularity(make, spark):
    v, e = make(G6, 10)
    labels = [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    c = spark.createDataFrame(list(enumerate(labels)), "id long, cluster long")
    assert clustering.modularity(v, e, c) == pytest.approx(0.48958333)
    alone = spark.createDataFrame([(i, None if i in (3, 5, 6) else k) for i, k in enumerate(labels)], "id long, cluster long")
    assert clustering.modularity(v, e, alone) == pytest.approx(0.28472222)
    assert clustering.modularity(*make([], 10), c) == 0


def random_graph(spark, n, m, seed, weights=None):
    r = random.Random(seed)
    e = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
    rows = [(a, b, r.randrange(1, 9)) for a, b in e if a != b]
    return spark.range(n), spark.createDataFrame(rows, "src long, dst long, w long"), rows


def test_paths(spark):
    v, e, rows = random_graph(spark, 30, 90, 4)
    best, wide = {0: 0}, {0: (1 << 31) - 1}
    for _ in range(40):
        for a, b, w in rows:
            if a in best and best[a] + w < best.get(b, 1 << 60):
                best[b] = best[a] + w
            if min(wide.get(a, 0), w) > wide.get(b, 0):
                wide[b] = min(wide[a], w)
    want = {i: best.get(i) for i in range(30)}
    for delta in (None, 1.0, 4.0):
        assert column(traversal.shortest_paths(v, e, 0, delta)) == want
    assert column(traversal.widest_paths(v, e, 0)) == {i: wide.get(i, 0) for i in range(30)}
    bad = spark.createDataFrame([(0, 1, -2), (1, 0, 1)], "src long, dst long, w long")
    with pytest.raises(ValueError):
        traversal.shortest_paths(spark.range(2), bad, 0)


def test_strong_and_biconnected(spark, make):
    v, e, rows = random_graph(spark, 40, 70, 8)
    reach = {i: {i} for i in range(40)}
    for _ in range(40):
        for a, b, _w in rows:
            for i in reach:
                if a in reach[i]:
                    reach[i].add(b)
    want = {i: min(j for j in range(40) if j in reach[i] and i in reach[j]) for i in range(40)}
    assert column(components.strong_components(v, e)) == want
    # blocks: edges are together when no single vertex parts them
    g = make([(a, b) for a, b, _ in rows[:45]], 40)
    edges = sorted({(min(a, b), max(a, b)) for a, b, _ in rows[:45]})
    label = {x: i for i, x in enumerate(edges)}
    changed = True

    def parted(x, y):
        for cut_ in {*x, *y}:
            left, seen = [next(u for u in x if u != cut_)], set()
            while left:
                u = left.pop()
                if u in seen or u == cut_:
                    continue
                seen.add(u)
                left += [b if a == u else a for a, b in edges if u in (a, b)]
            if not any(u in seen for u in y if u != cut_):
                return True
        return False

    together = {frozenset((x, y)) for x in edges for y in edges if x != y and not parted(x, y) and x != y}
    got = {(r.src, r.dst): r.label for r in components.biconnected_components(*g).collect()}
    assert set(got) == set(edges) and changed and label
    for x, y in itertools.combinations(edges, 2):
        shares = len({*x, *y}) < 4
        if shares:
            assert (got[x] == got[y]) == (frozenset((x, y)) in together and cycle_joins(edges, x, y)), (x, y)


def cycle_joins(edges, x, y):
    """Adjacent edges lie on a common cycle: their other ends meet without their common one."""
    (common,) = set(x) & set(y)
    (a,), (b,) = set(x) - {common}, set(y) - {common}
    left, seen = [a], set()
    while left:
        u = left.pop()
        if u in seen or u == common:
            continue
        seen.add(u)
        left += [q if p == u else p for p, q in edges if u in (p, q)]
    return b in seen


def test_forests_and_spanner(spark, make):
    v, e, rows = random_graph(spark, 30, 80, 6)
    sym = graph.from_edges(e, symmetric=True)
    edges = sorted({(r.w, r.src, r.dst) for r in sym.collect() if r.src < r.dst})
    root = list(range(30))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = set()
    for w, a, b in edges:
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, w))
    assert {tuple(r) for r in components.minimum_spanning_forest(v, sym).collect()} == want
    ldd = column(components.low_diameter_decomposition(v, sym).select("id", "label"))
    assert set(ldd) == set(range(30)) and all(ldd[c] == c for c in ldd.values())
    s = components.spanner(v, sym, 3)
    both = s.union(s.select("dst", "src")).toDF("src", "dst")
    assert column(components.connected_components(v, both)) == column(components.connected_components(v, sym))
    assert s.join(sym, ["src", "dst"], "left_anti").count() == 0


def test_covers(spark, make):
    v, e = make(G2, 11)
    for options in ({}, {"log_degrees": True, "seed": 2}):
        colours = covering.colouring(v, e, **options)
        assert covering.colouring_conflicts(e, colours).count() == 0
        assert max(column(colours).values()) <= 5 and colours.count() == 11
    m = spark.createDataFrame([(s, x) for s in range(12) for x in range(s, 40, 7 - s % 5)], "src long, dst long")
    cover = {r.src for r in covering.set_cover(m).collect()}
    rows = m.collect()
    assert {r.dst for r in rows if r.src in cover} == {r.dst for r in rows} and len(cover) < 12
    chosen = {i for i, c in column(covering.independent_set(v, e, covering.hash_priority(3))).items() if c}
    assert not any(a in chosen and b in chosen for a, b in G2) and all(i in chosen or any(i in x and (set(x) & chosen) for x in G2) for i in range(11))


def test_ranks(spark, make):
    v, e, rows = random_graph(spark, 25, 90, 2)
    out = {i: sum(a == i for a, _, _ in rows) for i in range(25)}
    p = {i: 1 / 25 for i in range(25)}
    for _ in range(200):
        p = {i: 0.15 / 25 + 0.85 * sum(p[a] / out[a] for a, b, _ in rows if b == i) for i in range(25)}
    got = column(ranking.pagerank(v, e, tolerance=1e-9))
    assert all(abs(got[i] - p[i]) < 1e-7 for i in p)
    near = column(ranking.pagerank_delta(v, e, threshold=1e-6, tolerance=1e-8))
    assert all(abs(near[i] - p[i]) < 1e-3 for i in p)
    assert ranking.cosimrank(v, e, 1, 1, most=3) > 1


def test_frontiers_and_shapes(spark, make):
    v, e = make(G1, 7)
    f = spark.createDataFrame([(3,), (0,)], "id long")
    assert column(graph.edge_map(f, e)) == {1: 0, 2: 3, 4: 3, 5: 3}
    left, degree = graph.pack_edges(e, graph.F.col("dst") > graph.F.col("src"))
    assert left.count() == 6 and column(degree) == {0: 1, 2: 1, 3: 2, 4: 1, 5: 1}
    names = v.select("id", (v.id % 2).alias("name"))
    assert {tuple(r) for r in graph.contract(e, names).collect()} == {(0, 1), (1, 0)}
    assert graph.from_edges(spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "src long, dst long")).count() == 1
    le = traversal.least_element_lists(v, e)
    assert {tuple(r) for r in le.filter("id = 6").collect()} == {(6, 2, 3), (6, 3, 2), (6, 5, 1), (6, 6, 0)}


def size_digits(df):
    """Binary digits of the size that Spark foretells for a plan."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()


def test_loops_keep_sizes_short(make):
    v, e = make([(i, i + 1) for i in range(19)], 20)
    chosen = covering.independent_set(v, e)
    assert column(chosen) == {i: i % 2 == 0 for i in range(20)}
    assert size_digits(chosen) < 200


def test_spanning_rounds_keep_sizes_short(spark, make):
    weights = [(i, i + 1, (i + 1) & -(i + 1)) for i in range(15)]
    e = graph.from_edges(spark.createDataFrame(weights, "src long, dst long, w long"), symmetric=True)
    forest = components.minimum_spanning_forest(spark.range(16), e)
    assert sorted(tuple(r) for r in forest.collect()) == weights
    assert size_digits(forest) < 200


def test_spanning_rounds_write_little(spark, monkeypatch):
    rows = [(a, b, w) for a, b, w in [(0, 1, 2), (0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, None), (4, 5, 7), (5, 3, 7), (5, 9, 0)]] + [(10 + i, 11 + i, 1) for i in range(30)]
    e = spark.createDataFrame([x for a, b, w in rows for x in ((a, b, w), (b, a, w))], "src long, dst long, w long")
    v = spark.createDataFrame([(i,) for i in [*range(9), *range(10, 41)]], "id long")
    kind, written = type(e), []
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, f=kind.checkpoint, **b: written.append(0) or f(self, *a, **b))
    forest = components.minimum_spanning_forest(v, e)
    want = [(0, 1, 1), (0, 2, 1), (3, 4, None), (3, 5, 7)] + [(10 + i, 11 + i, 1) for i in range(30)]
    assert sorted(tuple(r) for r in forest.collect()) == want
    assert len(written) <= 16
