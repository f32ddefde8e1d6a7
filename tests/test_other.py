"""Sequences, sorting, sources, vector search, grids, trees, particles, strings, textbook algorithms, streaming."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ann, heat, nbody, sequence, sorting, strings, textbook, tree_search
from sparkloom.sources import binary, generators, text
from sparkloom.streaming.incremental import IncrementalComponents


def seq(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "idx long, value long").repartition(3)


def listed(df, column="value"):
    return [r[column] for r in df.orderBy("idx").collect()]


def test_counting_sort_keeps_every_row(spark):
    s = spark.createDataFrame([(0, 900), (1, 149), (2, None), (3, 150), (4, -3), (5, 0), (6, 900)], "idx long, value long").repartition(3)
    assert listed(sorting.counting_sort(s, 150)) == [-3, 0, 149, 150, 900, 900, None]
    assert listed(sorting.sort(s)) == [-3, 0, 149, 150, 900, 900, None]


def test_sequences(spark):
    v = [5, 3, 3, 9, 1, 1, 7, 3]
    s = seq(spark, v)
    assert listed(sequence.scan(s), "scan") == [0, 5, 8, 11, 20, 21, 22, 29]
    assert listed(sequence.scan(s, True), "scan")[-1] == sum(v)
    assert listed(sequence.scan_max(s), "scan") == [5, 5, 5, 9, 9, 9, 9, 9]
    assert listed(sorting.sort(s)) == sorted(v)
    assert listed(sequence.rank(s), "rank") == [5, 2, 3, 7, 0, 1, 6, 4]
    assert listed(sequence.unique(s)) == [5, 3, 9, 1, 7, 3]
    assert listed(sequence.reverse(s)) == v[::-1] and listed(sequence.rotate(s, 3)) == v[3:] + v[:3]
    assert listed(sequence.partition(s, F.col("value") > 3)) == [5, 9, 7, 3, 3, 1, 1, 3]
    assert listed(sequence.pack(s, F.col("value") == 3)) == [3, 3, 3]
    assert {r.idx for r in sequence.search(s, [3, 9]).collect()} == {2}
    assert sequence.is_sorted(s).first().until == 1 and sequence.is_sorted(sorting.sort(s)).first().sorted
    assert sequence.kth_smallest(s, 3).first().value == 3
    assert sorting.verify(s, sorting.sort(s)).first().differ == 0
    assert sorted(listed(sequence.shuffle(s, 5))) == sorted(v)
    x = spark.createDataFrame([(i, float(a)) for i, a in enumerate([1, -3, 4, -1, 2, -6, 3])], "idx long, value double")
    assert sequence.max_contiguous_sum(x).first().best == 5.0
    assert {r.prime for r in sequence.primes(spark, 50).collect()} == {p for p in range(2, 51) if all(p % q for q in range(2, p))}
    assert sequence.cycle_count(seq(spark, [1, 2, 0, 3, 5, 4])) == 3
    assert [r.part for r in sequence.split_at(s, F.col("value") == 3).orderBy("idx").collect()] == [0, 0, 1, 2, 2, 2, 2, 2]
    empty = seq(spark, v).limit(0)
    assert sequence.scan(empty).count() == 0 and sorting.sort(empty).count() == 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# comment\n3 6\n0 2\n5 0\n5 1\n2 5\n0 1\n5 2\n5 2\n4 4\n")
    e = text.read_edge_list(spark, str(tmp_path / "e.txt"))
    assert {tuple(r) for r in e.collect()} == {(3, 6), (0, 2), (5, 0), (5, 1), (2, 5), (0, 1), (5, 2)}
    (tmp_path / "a.txt").write_text("\n".join(map(str, ["WeightedAdjacencyGraph", 3, 4, 0, 2, 2, 1, 2, 0, 1, 7, 8, 9, 10])) + "\n")
    v, w = text.read_adjacency(spark, str(tmp_path / "a.txt"))
    assert v.count() == 3 and {tuple(r) for r in w.select("src", "dst", "w").collect()} == {(0, 1, 7.0), (0, 2, 8.0), (2, 0, 9.0), (2, 1, 10.0)}
    text.write_adjacency(spark.range(7), e, str(tmp_path / "out"))
    lines = [x for p in sorted((tmp_path / "out").glob("part*")) for x in p.read_text().split("\n") if x]
    (tmp_path / "b.txt").write_text("\n".join(lines) + "\n")
    _, again = text.read_adjacency(spark, str(tmp_path / "b.txt"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in e.collect()}
    (tmp_path / "bad.txt").write_text("AdjacencyGraph\n2\n3\n0\n1\n1\n")
    with pytest.raises(ValueError):
        text.read_adjacency(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "s.txt").write_text("sequenceInt\n4\n5\n")
    assert listed(text.read_sequence(spark, str(tmp_path / "s.txt"), "long")) == [4, 5]


def test_binary_sources(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "CHUNK", 64)
    x = np.random.default_rng(1).normal(size=(37, 5)).astype("<f4")
    (tmp_path / "x.fbin").write_bytes(np.asarray([37, 5], "<i4").tobytes() + x.tobytes())
    p = binary.read_vectors(spark, str(tmp_path / "x.fbin"), "fbin")
    assert np.array_equal(np.asarray([r.vec for r in p.orderBy("id").collect()], "f4"), x)
    binary.convert_vectors(spark, str(tmp_path / "x.fbin"), "fbin", str(tmp_path / "y.fbin"), "fbin", first=10)
    assert (tmp_path / "y.fbin").read_bytes() == np.asarray([10, 5], "<i4").tobytes() + x[:10].tobytes()
    (tmp_path / "x.fvecs").write_bytes(b"".join(np.asarray([5], "<i4").tobytes() + r.tobytes() for r in x))
    assert binary.read_prefixed_vectors(spark, str(tmp_path / "x.fvecs"), "fvecs").count() == 37
    (tmp_path / "t.ibin").write_bytes(np.asarray([2, 3, 5, 6, 7, 8, 9, 10], "<i4").tobytes() + np.arange(6, dtype="<f4").tobytes())
    assert {tuple(r) for r in binary.read_ground_truth(spark, str(tmp_path / "t.ibin")).collect()} == {(i // 3, i % 3 + 1, 5 + i, float(i)) for i in range(6)}
    (tmp_path / "r").write_bytes(np.asarray([3, 4, 1, 0, 3, 9, 8, 7, 6], "<i4").tobytes())
    assert {tuple(r) for r in binary.read_range_truth(spark, str(tmp_path / "r")).collect()} == {(0, 9), (2, 8), (2, 7), (2, 6)}
    (tmp_path / "e").write_bytes(np.arange(40, dtype="<u4").tobytes())
    assert {tuple(r) for r in binary.read_binary_edges(spark, str(tmp_path / "e")).collect()} == {(2 * i, 2 * i + 1) for i in range(20)}
    offsets, dst = [0, 0, 3, 3, 40, 40, 41], list(range(41))
    (tmp_path / "csr").write_bytes(np.asarray([6, 41, 0, *offsets], "<i8").tobytes() + np.asarray(dst, "<u4").tobytes())
    want = {(s, d) for s in range(6) for d in dst[offsets[s] : offsets[s + 1]]}
    assert {tuple(r) for r in binary.read_binary_csr(spark, str(tmp_path / "csr")).collect()} == want


def test_generators(spark):
    e = generators.rmat(spark, 6, 500, seed=2)
    assert e.agg(F.max("src"), F.max("dst")).first()[0] < 64 and {tuple(r) for r in e.collect()} == {tuple(r) for r in generators.rmat(spark, 6, 500, seed=2).collect()}
    p = generators.preferential_attachment(spark, 200, 3)
    assert p.filter("dst >= src").count() == 0 and 560 <= p.count() <= 597
    for kind in ("cube", "sphere", "plummer"):
        assert abs(generators.particles(spark, 300, kind).agg(F.sum("q")).first()[0]) < 1e-9
    assert generators.random_sequence(spark, 100, most=9).filter("value < 0 or value > 9").count() == 0


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(3).normal(size=(600, 8))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(2), x


def test_vector_search(cloud):
    points, x = cloud
    q = points.filter("id % 20 = 0")
    truth = ann.exact_knn(points, q, 10).cache()
    d = ((x[::20, None] - x[None]) ** 2).sum(2)
    want = {(20 * i, int(j)) for i in range(30) for j in np.argsort(d[i])[:10]}
    assert {(r.qid, r.id) for r in truth.collect()} == want
    for method in ("vamana", "hcnng", "nn_descent", "hnsw"):
        assert ann.recall(ann.graph_search(points, q, 10, method, 80), truth, 10).first()[0] >= 0.9, method
    assert ann.recall(ann.lsh_search(points, q, 10, 30, 4), truth, 10).first()[0] >= 0.9
    near = ann.range_search(points, q, 4.0)
    assert {(r.qid, r.id) for r in near.collect()} == {(20 * i, j) for i, j in zip(*np.nonzero(d <= 4.0))}
    assert ann.range_recall(near, near, q).first().recall == 1.0
    graph, medoid = ann.build_vamana(x[:100])
    left = ann.delete_points(x[:100], graph, medoid, {1, 2, 3}, 24)
    assert not any(j in (1, 2, 3) for near_ in left for j in near_)
    assert ann.knn_graph(points.limit(50), 3).count() == 150


def test_pairs_within(spark):
    r = random.Random(2)
    p = [(i, r.random(), r.random(), r.random()) for i in range(120)]
    df = spark.createDataFrame(p, "id long, x double, y double, z double")
    want = {(a[0], b[0]) for a in p for b in p if a[0] < b[0] and sum((s - t) ** 2 for s, t in zip(a[1:], b[1:])) < 0.04}
    assert {tuple(x) for x in ann.pairs_within(df, 0.2, ["x", "y", "z"]).collect()} == want


def test_heat(spark):
    e = heat.heat_errors(heat.heat(spark, 15, 17, 6), 15, 17).first()
    assert e.max_abs < 1e-5 and e.max_rel < 1e-3


def test_trees(spark):
    import hashlib

    def brute(state, h, depth):
        u = (int.from_bytes(state[16:], "big") & 0x7FFFFFFF) / 2**31
        n = min(int(math.log(1 - u) / math.log(0.8)), 100) if h < depth else 0
        parts = [brute(hashlib.sha1(state + i.to_bytes(4, "big")).digest(), h + 1, depth) for i in range(n)]
        return (max([h, *(p[0] for p in parts)]), 1 + sum(p[1] for p in parts), (n == 0) + sum(p[2] for p in parts))

    want = brute(tree_search.root_state(19), 0, 6)
    for levels in (2, 4):
        assert tuple(tree_search.tree_search(spark, depth=6, levels=levels).first()) == want
    assert tuple(tree_search.traverse(tree_search.stored_tree(spark, depth=4)).first()) == brute(tree_search.root_state(19), 0, 4)
    assert tuple(tree_search.tree_search(spark, "balanced", b0=3, depth=4, levels=2).first()) == (4, 121, 81)


def test_particles(spark):
    b = generators.particles(spark, 400, "cube", 3)
    exact, fast = nbody.direct_sum(b).toPandas().sort_values("id"), nbody.multipole_sum(b, 0.5, 4, 16).toPandas().sort_values("id")
    for c, most in (("p", 5e-4), ("fx", 5e-3)):
        x, y = exact[c].to_numpy(), fast[c].to_numpy()
        assert math.sqrt(((x - y) ** 2).sum() / (x**2).sum()) < most
    assert nbody.octree(b, 16).groupBy("level", "key").count().agg(F.max("count")).first()[0] <= 16


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            old, row[j] = row[j], old if c == d else 1 + min(row[j], row[j - 1])
    return row[-1]


def test_strings(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "kitten", "sitting"), (3, "", "xy"), (4, None, "x")], "id long, a string, b string")
    got = {r.id: r.d for r in df.select("id", strings.insert_delete_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {1: 2, 2: 5, 3: 2, 4: None}
    t = spark.createDataFrame([(1, "abababa"), (2, "x"), (3, None)], "id long, t string")
    assert {tuple(r) for r in strings.matches(t, "id", "t", "aba").collect()} == {(1, 0), (1, 2), (1, 4)}
    word = "mississippi"
    sa = {r["rank"]: r["at"] for r in strings.suffix_array(spark, word).collect()}
    assert [sa[i] for i in range(len(word))] == sorted(range(len(word)), key=lambda i: word[i:])
    assert tuple(strings.longest_repeated_substring(spark, word).first()) == (4, 1, 4)
    assert strings.bw_encode(spark, "banana") == "annb\0aa"
    texts = {7: "mississippi", 8: "aaaa", 9: "x", 10: "", 11: None, 12: "\U0001f600b\n\U0001f600b", 13: "abc"}
    many = spark.createDataFrame(list(texts.items()), "n long, t string")
    got = {i: [] for i, t in texts.items() if t}
    for x in strings.suffix_arrays(many, "n", "t").orderBy("id", "rank").collect():
        got[x["id"]].append(x["at"])
    assert got == {i: sorted(range(len(t)), key=lambda k: [ord(c) for c in t[k:]]) for i, t in texts.items() if t}
    best = {tuple(x) for x in strings.longest_repeated_substrings(many, "n", "t").collect()}
    assert best == {(7, 4, 1, 4), (8, 3, 0, 1), (9, 0, None, None), (12, 2, 0, 3), (13, 0, None, None)}
    r, pairs = random.Random(2), []
    for i in range(60):
        pairs.append((i, "".join(r.choices("abcd", k=r.randrange(90))), "".join(r.choices("abcd", k=r.randrange(90)))))
    least = spark.createDataFrame(pairs, "id long, a string, b string").select("id", strings.insert_delete_distance(F.col("a"), F.col("b")).alias("d"))
    assert {x.id: x.d for x in least.collect()} == {i: plain_distance(a, b) for i, a, b in pairs}
    assert strings.huffman_lengths({"a": 5, "b": 2, "c": 1}) == {"a": 1, "b": 2, "c": 2}
    s = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate([3, 1, 2, 0, 5])], "key long, idx long, value double")
    assert {r.idx: r.parent for r in strings.nearest_smaller(s).collect()} == {0: 1, 1: 3, 2: 1, 3: None, 4: 3}


def test_textbook(spark):
    r = random.Random(4)
    p = [(i, r.random(), r.random()) for i in range(60)]
    hull = {x.id for x in textbook.upper_hull(spark.createDataFrame(p, "id long, x double, y double").repartition(4)).collect()}
    for i, x, y in p:
        above = all(not any((b[1] - a[1]) * (y - a[2]) - (b[2] - a[2]) * (x - a[1]) < 0 for b in p if b[1] > x) for a in p if a[1] < x)
        assert (i in hull) == above or min(q[1] for q in p) == x or max(q[1] for q in p) == x
    box = [(i, x, y, x + r.random() / 5, y + r.random() / 5) for i, x, y in p]
    want = {(a[0], b[0]) for a in box for b in box if a[0] < b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]}
    assert {tuple(x) for x in textbook.rectangle_overlaps(spark.createDataFrame(box, "id long, x1 double, y1 double, x2 double, y2 double"), 0.1).collect()} == want
    flow = spark.createDataFrame([(0, 1, 3), (0, 2, 2), (1, 2, 5), (1, 3, 2), (2, 3, 3)], "src long, dst long, w long")
    assert textbook.max_flow(flow, 0, 3) == 5
    assert textbook.linear_program_2d([(1, 0, 4), (0, 1, 3), (1, 1, 5)], (2, 1)) == pytest.approx((4, 1))
    a, b = r.getrandbits(4000), r.getrandbits(4000)
    assert textbook.karatsuba(a, b) == a * b
    digits = lambda n: spark.createDataFrame([(i, (n >> 32 * i) & 0xFFFFFFFF) for i in range((n.bit_length() + 31) // 32)], "idx long, digit long")
    x, y = (1 << 200) - 1, r.getrandbits(150) | 1
    assert sum(row.digit << 32 * row.idx for row in textbook.big_add(digits(x), digits(y)).collect()) == x + y
    rows = spark.createDataFrame([(float(i), float(i % 7), 3.0 * i + 1) for i in range(200)], "a double, b double, y double")
    w = textbook.lasso(rows.selectExpr("a - 99.5 as a", "b - 3 as b", "y - 299.5 as y"), ["a", "b"], "y", 0.01)
    assert abs(w["a"] - 3) < 0.01 and abs(w["b"]) < 0.2
    nodes = textbook.decision_tree(rows.selectExpr("a", "b", "cast(a > 100 as int) as y"), ["a", "b"], "y", 1)
    assert nodes[0]["feature"] == "a" and {n["label"] for n in nodes[1:]} == {0, 1}
    pts = spark.createDataFrame([(i, [float(i % 3) * 10 + r.random(), r.random()]) for i in range(90)], "id long, vec array<double>")
    assert sorted(x["size"] for x in textbook.kmeans(pts, 3).collect()) == [30, 30, 30]


def test_incremental_components(spark, tmp_path):
    c = IncrementalComponents(spark)
    one = spark.createDataFrame([("insert", 1, 2), ("insert", 3, 4), ("query", 1, 4)], "kind string, src long, dst long")
    assert [r.connected for r in c.apply(one).collect()] == [False]
    two = spark.createDataFrame([("insert", 2, 3), ("query", 1, 4), ("query", 1, 9)], "kind string, src long, dst long")
    assert {(r.dst, r.connected) for r in c.apply(two).collect()} == {(4, True), (9, False)}
    one.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(one.schema).parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(IncrementalComponents(spark).sink(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_pairs_within_never_pass_through_the_driver(spark):
    random.seed(5)
    p = [(i, random.uniform(-1, 1), random.choice([-0.5, 0.0, 0.25]), random.uniform(0, 0.5)) for i in range(150)]
    df = spark.createDataFrame([*p, *[(i + 150, *q) for i, *q in p[:5]]], "id long, x double, y double, z double")
    rows = [tuple(r) for r in df.collect()]
    near = lambda r, n: sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and sum((s - t) ** 2 for s, t in zip(a[1 : n + 1], b[1 : n + 1])) < r * r)
    for radius, dims in ((0.25, ["x", "y", "z"]), (0.3, ["x", "y"]), (0.01, ["x"])):
        found = ann.pairs_within(df, radius, dims)
        assert sorted(tuple(r) for r in found.collect()) == near(radius, len(dims))
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
